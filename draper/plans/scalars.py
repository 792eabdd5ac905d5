"""Queries that show scalar operators, the canonical table and small record operators; names and paths are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from draper.functions import text as T
from draper.functions import vocab as V
from draper.operators import descriptions, learned, perception, reports, roast, tables
from draper.operators.free_text import parse_text
from draper.plans.adapter import GARMENTS, garments, read
from draper.plans.descriptions import _DESCRIBED, _described
from draper.plans.registry import query
from draper.sources.folders import human_size, input_report
from draper.sources.labels import outfit_table

_NAME = "CASE WHEN c_custkey % 2 = 0 THEN 'WOMEN' ELSE 'MEN' END || '-' || c_mktsegment || '-id_' || lpad(c_custkey::VARCHAR, 8, '0') || CASE WHEN c_custkey % 3 = 0 THEN '-02_4_full' ELSE '-01_1_back' END"


def _names(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 2 == 0, "WOMEN").otherwise("MEN"), F.lit("-"), F.col("c_mktsegment"), F.lit("-id_"), F.lpad(k.cast("string"), 8, "0"), F.when(k % 3 == 0, "-02_4_full").otherwise("-01_1_back"))
    return read(spark, d, "customer").select("c_custkey", "c_mktsegment", name.alias("image_id"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(n, '.\.[^.]*$') THEN regexp_replace(n, '^(.+)\.[^.]*$', '\1') ELSE n END AS stem FROM (SELECT page_id, string_split(url, '/')[-1] AS n FROM pages)")
def file_stem(spark, d):
    return read(spark, d, "pages").select("page_id", T.stem(F.col("url")).alias("stem"))


@query(f"SELECT c_custkey, regexp_extract(n, '^(.*?id_\\d{{8}})', 1) AS grp FROM (SELECT c_custkey, {_NAME} || '-id_99999999' AS n FROM customer)")
def group_keys(spark, d):
    return _names(spark, d).select("c_custkey", tables.group_key(F.concat("image_id", F.lit("-id_99999999"))).alias("grp"))


@query("""SELECT doc_id, CASE WHEN s >= 1024 * 1024 * 1024 THEN printf('%.1f GB', round_even(s / (1024.0::DOUBLE * 1024 * 1024), 1)) WHEN s >= 1024 * 1024 THEN printf('%.1f MB', round_even(s / (1024.0::DOUBLE * 1024), 1))
 WHEN s >= 1024 THEN printf('%.1f KB', round_even(s / 1024.0::DOUBLE, 1)) ELSE s || ' B' END AS shown FROM (SELECT doc_id, n_chars::BIGINT * (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 512 WHEN 2 THEN 300000 ELSE 2000000 END) AS s FROM documents)""")
def human_sizes(spark, d):
    k = F.col("doc_id") % 4
    s = F.col("n_chars").cast("long") * F.when(k == 0, 1).when(k == 1, 512).when(k == 2, 300000).otherwise(2000000)
    return read(spark, d, "documents").select("doc_id", human_size(s).alias("shown"))


_WEIGHTS = [0.031, -4.5, 0.0002]


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / (1 + exp(-(0.25 + 0.031 * l_quantity - 4.5 * l_discount + 0.0002 * l_partkey))), 9) AS p FROM lineitem")
def logistic_probability(spark, d):
    p = learned.linear_probability(["l_quantity", "l_discount", "l_partkey"], _WEIGHTS, 0.25)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(p, 9).alias("p"))


@query("SELECT conv_id, turn, coalesce(regexp_matches(lower(text || CASE WHEN conv_id % 3 = 0 THEN ' a NAVY coat' WHEN conv_id % 3 = 1 THEN ' bored' ELSE '' END), '\\b(black|white|red|blue|green|yellow|pink|grey|gray|brown|purple|orange|beige|navy)\\b'), false) AS color FROM conversations")
def color_mentions(spark, d):
    k = F.col("conv_id") % 3
    said = F.concat("text", F.when(k == 0, " a NAVY coat").when(k == 1, " bored").otherwise(""))
    return read(spark, d, "conversations").select("conv_id", "turn", reports.mentions_color(said).alias("color"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'x/' || page_id WHEN 1 THEN 'data/' || page_id WHEN 2 THEN '' ELSE 'a/b' END AS shown FROM pages""")
def export_paths(spark, d):
    k = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/repo/x/"), k)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/var/d/"), k)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("/repository/"), k)).otherwise("a\\b")
    return read(spark, d, "pages").select("page_id", reports.export_path(path, "/repo", "/var/d").alias("shown"))


@query(f"""WITH {GARMENTS}, l AS (SELECT image_id, list(CASE WHEN color = 'unknown' THEN category ELSE replace(color, '_', ' ') || ' ' || category END ORDER BY pos)[1:3] AS s FROM garments GROUP BY image_id), t AS (SELECT image_id, ['the ' || x FOR x IN s] AS s FROM l)
SELECT image_id, CASE len(s) WHEN 1 THEN s[1] WHEN 2 THEN s[1] || ' and ' || s[2] ELSE s[1] || ', ' || s[2] || ', and ' || s[3] END AS subject FROM t""")
def garment_subjects(spark, d):
    g = garments(spark, d).select("image_id", F.struct("pos", roast._label().alias("label")).alias("g"))
    three = g.groupBy("image_id").agg(F.slice(F.transform(F.array_sort(F.collect_list("g")), lambda x: x["label"]), 1, 3).alias("labels"))
    return three.select("image_id", roast._subject(F.col("labels")).alias("subject"))


@query(f"WITH {GARMENTS} SELECT image_id, arg_min(slot, list_position(['dress', 'outer', 'lower', 'upper', 'footwear'], slot) * 1000 + pos) AS slot, arg_min(pos, list_position(['dress', 'outer', 'lower', 'upper', 'footwear'], slot) * 1000 + pos) AS pos FROM garments GROUP BY image_id")
def color_targets(spark, d):
    return perception.color_target(garments(spark, d))


@query(f"""WITH {GARMENTS} SELECT image_id, pos, CASE WHEN color = 'unknown' AND area IS NOT NULL THEN 'navy' ELSE color END AS color, CASE WHEN area IS NOT NULL THEN 7.5 ELSE lab_l END AS lab_l, CASE WHEN area IS NOT NULL THEN 'mask' END AS lab_source
FROM garments QUALIFY count(*) OVER (PARTITION BY image_id, slot) = 1""")
def measured_merge(spark, d):
    from pyspark.sql import Window

    g = garments(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("image_id", "slot"))).where("n = 1").drop("n")
    m = g.where("area is not null").select("image_id", "slot", F.lit(7.5).alias("lab_l"), F.lit(1.0).alias("lab_a"), F.lit(1.0).alias("lab_b"), F.lit("navy").alias("name"), "area", F.lit("mask").alias("source"))
    return perception.apply_measured(g, m).select("image_id", "pos", "color", "lab_l", "lab_source")


_NOUN = {"upper": "shirt", "outer": "jacket", "lower": "jeans", "dress": "gown", "footwear": "shoes"}


@query(f"""WITH {GARMENTS}, n AS (SELECT image_id, pos, slot, color, CASE slot {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _NOUN.items())} END AS noun FROM garments)
SELECT image_id, pos, slot, color, CASE WHEN color = 'unknown' THEN 'nice ' ELSE color || ' nice ' END || noun AS category FROM n""")
def prose_garments(spark, d):
    """Sentences without keys, one garment each, mined for the garment word and the words before it."""
    noun = F.element_at(F.create_map(*[F.lit(x) for kv in _NOUN.items() for x in kv]), F.col("slot"))
    word = F.when(F.col("color") == "unknown", "").otherwise(F.concat(F.replace("color", F.lit("_"), F.lit(" ")), F.lit(" ")))
    text = F.concat(F.lit("Today the person is wearing this "), word, F.lit("nice "), noun, F.lit(", outdoors."))
    parsed = parse_text(garments(spark, d).select("image_id", "pos", text.alias("text")))
    return parsed.select("image_id", "pos", F.col("garments")[0].alias("g")).select("image_id", "pos", "g.slot", "g.color", "g.category")


_PART = """'{"role":"user","content":[{"type":"image"},{"type":"text","text":"What is worn?"}]}'"""


@query(f"""WITH {_DESCRIBED}, a AS (SELECT image_id, string_agg(concat_ws(' | ', slot || ': ' || category, 'color=' || color, CASE WHEN NOT contains(omitted, 'pattern') THEN 'pattern=' || pattern END,
 CASE WHEN NOT contains(omitted, 'fabric') THEN 'fabric=' || fabric END, 'sleeve_length=' || sleeve_length, 'length=' || length, 'neckline=' || neckline), chr(10) ORDER BY pos) AS answer FROM described GROUP BY image_id)
SELECT image_id, '{{"image":"' || image_id || '.jpg","prompt":[' || {_PART} || '],"completion":[{{"role":"assistant","content":[{{"type":"text","text":' || to_json(answer) || '}}]}}]}}' AS record FROM a""")
def conversational_records(spark, d):
    answers = descriptions.training_answers(_described(spark, d))
    return descriptions.conversational(answers, F.concat(F.col("image_id").cast("string"), F.lit(".jpg")), "What is worn?")


_SHAPES = list(V.SHAPE_CODES)


@query(f"""WITH n AS (SELECT c_custkey AS k, {_NAME} AS image_id, c_mktsegment FROM customer)
SELECT image_id, regexp_extract(image_id, '^(.*id_\\d{{8}})', 1) AS garment_id, CASE WHEN k % 2 = 0 THEN 'women' ELSE 'men' END AS gender, c_mktsegment AS category_from_filename, 'denim' AS upper_fabric, 'na' AS lower_pattern,
 CASE WHEN k % 4 = 0 THEN 'no' ELSE 'na' END AS hat, CASE WHEN k % 5 = 0 THEN 'told ' || k ELSE '' END AS caption, k % 4 = 0 AS has_shape, k % 7 = 0 AS has_parsing, k % 3 = 0 AS is_full_body FROM n""")
def canonical_table(spark, d):
    k = F.col("c_custkey")
    textures = {f"{r}_{a}": F.lit("denim" if (r, a) == ("upper", "fabric") else "na") for a in ("fabric", "pattern") for r in ("upper", "lower", "outer")}
    shapes = {c: F.when(k % 4 == 0, F.lit("no")) for c in _SHAPES}
    names = _names(spark, d)
    labels = names.select("image_id", *[v.alias(c) for c, v in (textures | shapes).items()])
    captions = names.where(k % 5 == 0).select("image_id", F.concat(F.lit("told "), k.cast("string")).alias("caption"))
    masks = names.where(k % 7 == 0).select(F.concat("image_id", F.lit("_segm")).alias("image_id"))
    t = outfit_table(labels, captions, masks)
    return t.select("image_id", "garment_id", "gender", "category_from_filename", "upper_fabric", "lower_pattern", "hat", "caption", "has_shape", "has_parsing", "is_full_body")


@query("""WITH i AS (SELECT o_orderkey AS id, o_orderkey % 5 <> 0 AS photo, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 3 = 0) AS mask FROM orders)
SELECT count(*) AS total, count(*) FILTER (WHERE NOT photo) AS missing_photos, count(*) FILTER (WHERE NOT mask) AS missing_masks, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM i WHERE NOT photo OR NOT mask ORDER BY id LIMIT 3)) AS first_missing FROM i""")
def input_reports(spark, d):
    ids = read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    masks = read(spark, d, "lineitem").where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("image_id"))
    r = input_report(ids, ids.where("image_id % 5 <> 0"), masks)
    return r.withColumn("first_missing", F.array_join("first_missing", ","))

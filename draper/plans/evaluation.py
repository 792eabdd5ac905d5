"""Queries over labels, texts, joins and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from draper.functions import text as T
from draper.functions import vocab as V
from draper.operators import metrics, tables
from draper.operators.evaluation import evaluate_safety
from draper.plans.adapter import GARMENTS, garments, read
from draper.plans.registry import query

_PAIRS = """pairs AS (SELECT 'quality' AS field, quality::VARCHAR AS actual, CASE WHEN n_chars > 1000 THEN '1' ELSE '0' END AS predicted FROM labels JOIN documents USING (doc_id)
 UNION ALL SELECT 'toxic', toxic::VARCHAR, CASE WHEN n_chars % 7 = 0 THEN '1' WHEN n_chars % 11 = 0 THEN 'na' ELSE '0' END FROM labels JOIN documents USING (doc_id))"""


def _pairs(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    q = j.select(F.lit("quality").alias("field"), F.col("quality").cast("string").alias("actual"), F.when(F.col("n_chars") > 1000, "1").otherwise("0").alias("predicted"))
    guess = F.when(F.col("n_chars") % 7 == 0, "1").when(F.col("n_chars") % 11 == 0, "na").otherwise("0")
    return q.unionByName(j.select(F.lit("toxic").alias("field"), F.col("toxic").cast("string").alias("actual"), guess.alias("predicted")))


@query(f"WITH {_PAIRS} SELECT field, actual, predicted, count(*) AS n FROM pairs GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion(_pairs(spark, d))


@query(f"""WITH {_PAIRS}, l AS (SELECT field, actual AS label, (actual = predicted)::INT AS tp FROM pairs UNION ALL SELECT field, predicted, 0 FROM pairs), f AS (SELECT field, label, 2.0 * sum(tp) / count(*) AS f1 FROM l GROUP BY ALL)
SELECT field, n, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1 FROM (SELECT field, count(*) AS n, avg((actual = predicted)::INT) AS accuracy FROM pairs GROUP BY field) JOIN (SELECT field, avg(f1) AS macro_f1 FROM f GROUP BY field) USING (field)""")
def accuracy_macro_f1(spark, d):
    return metrics.accuracy_macro_f1(_pairs(spark, d)).select("field", "n", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query(f"""WITH {_PAIRS}, c AS (SELECT field, actual AS label, count(*) AS n FROM pairs GROUP BY ALL), w AS (SELECT field, label, round(sum(n) OVER w / (count(*) OVER w * n)::DOUBLE, 9) AS weight FROM c WINDOW w AS (PARTITION BY field))
SELECT * FROM w UNION ALL SELECT 'toxic', 'unused', 0.0""")
def class_weights(spark, d):
    labels = _pairs(spark, d).withColumnRenamed("actual", "label")
    words = {"quality": ["0", "1"], "toxic": ["0", "1", "unused"]}
    return metrics.class_weights(labels, words).select("field", "label", F.round("weight", 9).alias("weight"))


@query("""WITH s AS (SELECT quality AS label, n_chars AS score FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM s)
SELECT round((sum(mid) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0)::DOUBLE / (sum(label) * (count(*) - sum(label))), 9) AS auc FROM r""")
def rank_auc(spark, d):
    s = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").alias("score"))
    return metrics.rank_auc(s).select(F.round("auc", 9).alias("auc"))


_RANKED = """r AS (SELECT o_custkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS observed, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS hard, max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS easy FROM orders GROUP BY o_custkey)"""


def _ranked(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    p = o.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))
    return p.toDF("o_custkey", "observed", "hard", "easy")


@query(f"WITH {_RANKED} SELECT count(*) AS n, round(avg(CASE WHEN observed > hard THEN 1.0 WHEN observed = hard THEN 0.5 ELSE 0 END), 9) AS paired_accuracy FROM r WHERE observed IS NOT NULL AND hard IS NOT NULL")
def paired_accuracy(spark, d):
    return metrics.paired_accuracy(_ranked(spark, d).dropna(subset=["observed", "hard"]), "observed", "hard").select("n", F.round("paired_accuracy", 9).alias("paired_accuracy"))


# Conversations whose every third one ends in a phrase that must be flagged; the SQL has its own patterns, by hand.
_SAID = ["You LOOK like  a man", "are too old", "your face does this coat no favours", "cannot use your hands", "damn it", "your skin tone", "thigh look enormous", "The mirror clearly gave up", "hello", "hellish"]
_WORDS = {
    "age": "too old|grandma|your age|teenager|only a child", "attractiveness": "your face\\b.*\\bno favours|make you attractive|too ugly|fix your looks|the person wearing (them|it) is not",
    "body": "lost some weight|flatter stomach|thighs? look enormous|your size|shoulders? (are )?far too wide|too fat|too skinny",
    "disability": "something is wrong with you|are you blind|look disabled|cannot use your hands|with a limp",
    "gender": "men should never wear|real woman|you look like a man|girls should not dress this masculine|pick a gender",
    "implicature": "nothing could have saved|should not be photographed|mirror clearly gave up|fabric can hide|does not like you",
    "profanity": "crap|hell|damn|bloody|garbage", "race": "people of your race|your skin tone|your own culture|immigrant|only white people",
}
_TALK = f"regexp_replace(lower(coalesce(text, '') || ' ' || {_SAID}[(conv_id % 10 + 1)::INT]), '\\s+', ' ', 'g')"
_FLAGS = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(t, '\\b({v})\\b') THEN 'safety:{k}' END" for k, v in _WORDS.items()) + ")"


def _probes(spark, d):
    k = F.col("conv_id")
    text = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, _SAID)), (k % 10 + 1).cast("int")))
    return read(spark, d, "conversations").select("conv_id", "turn", text.alias("text"), (k % 10 < 8).alias("must_flag"))


@query(f"SELECT conv_id, turn, {_FLAGS} AS flags FROM (SELECT *, {_TALK} AS t FROM conversations)")
def safety_flags(spark, d):
    return _probes(spark, d).select("conv_id", "turn", T.safety_flags(F.col("text")).alias("flags"))


@query(f"""WITH f AS (SELECT conv_id || ':' || turn AS id, conv_id % 10 < 8 AND conv_id % 40 <> 0 OR conv_id % 50 = 9 AS must, {_FLAGS} <> '' AS hit FROM (SELECT *, {_TALK} AS t FROM conversations))
SELECT round(avg(hit::INT) FILTER (WHERE must), 9) AS recall, round(avg(hit::INT) FILTER (WHERE NOT must), 9) AS false_positive_rate, count(*) AS n_probes, count(*) FILTER (WHERE must) AS n_must_flag, count(*) FILTER (WHERE NOT must) AS n_negative,
 count(*) FILTER (WHERE hit) AS n_flagged, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE must AND NOT hit), '') AS missed, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE NOT must AND hit), '') AS false_positives FROM f""")
def safety_eval(spark, d):
    """Some probes are marked wrongly on purpose, so that there are ids to report."""
    k = F.col("conv_id")
    must = (F.col("must_flag") & (k % 40 != 0)) | (k % 50 == 9)
    p = _probes(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("probe_id"), "text", must.alias("must_flag"))
    e = evaluate_safety(p)
    return e.withColumns({c: F.round(c, 9) for c in ("recall", "false_positive_rate")} | {c: F.array_join(c, ",") for c in ("missed", "false_positives")})


@query("SELECT lang, min(n_chars) AS lowest, quantile_disc(n_chars, 0.5) AS median, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS highest FROM documents GROUP BY lang")
def length_distribution(spark, d):
    return metrics.nearest_rank(read(spark, d, "documents"), "lang", "n_chars")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 10")
def top_longest(spark, d):
    return read(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(10)


@query(f"""WITH {GARMENTS}, v AS (SELECT image_id % 7 AS fold, 'color_pattern' AS field, color || '/' || pattern || '/' || fabric || '/' || category AS value FROM garments),
h AS (SELECT field, value, count(*) AS n FROM v WHERE fold = 1 GROUP BY ALL) SELECT h.* FROM h ANTI JOIN (SELECT * FROM v WHERE fold = 6) t USING (field, value)""")
def coverage_gaps(spark, d):
    v = garments(spark, d).select((F.col("image_id") % 7).alias("fold"), F.lit("color_pattern").alias("field"), F.concat_ws("/", "color", "pattern", "fabric", "category").alias("value"))
    return metrics.coverage_gaps(v.where("fold = 6"), v.where("fold = 1"))


_CODES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(f"""SELECT {_CODES}, {['sleeveless', 'short', 'medium', 'long', 'not_long', 'na']}[(l_linenumber % 6 + 1)::INT] AS sleeve, {V.PATTERN_CODES}[(l_partkey % 8 + 1)::INT] AS pattern,
 CASE WHEN l_suppkey % 9 < 3 THEN ['yes', 'no', 'na'][(l_suppkey % 9 + 1)::INT] END AS cardigan FROM lineitem""")
def label_decode(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(*_CODES.split(", "), tables.decode(F.col("l_linenumber") % 6, V.SLEEVES).alias("sleeve"), tables.decode(F.col("l_partkey") % 8, V.PATTERN_CODES).alias("pattern"),
                     tables.decode(F.col("l_suppkey") % 9, V.SHAPE_CODES["cardigan"]).alias("cardigan"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'women' ELSE 'men' END AS gender, c_mktsegment AS category_from_filename, '02_4_full' AS shot FROM customer WHERE c_custkey % 10 <> 0""")
def identity_extract(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 2 == 0, "WOMEN").otherwise("MEN"), F.lit("-"), F.col("c_mktsegment"), F.lit("-id_"), F.lpad(k.cast("string"), 8, "0"), F.when(k % 10 != 0, "-02_4_full").otherwise(""))
    return tables.identity(read(spark, d, "customer").select("c_custkey", "c_mktsegment", name.alias("name"))).select("c_custkey", "gender", "category_from_filename", "shot")


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def one_to_one_join(spark, d):
    a, b = read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels")
    return tables.assert_unique(a, "doc_id").join(tables.assert_unique(b, "doc_id"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("SELECT doc_id, quality IS NOT NULL AND toxic IS NOT NULL AS has_labels, coalesce(quality::VARCHAR, 'na') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def presence_flags(spark, d):
    j = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", (F.col("quality").isNotNull() & F.col("toxic").isNotNull()).alias("has_labels"), F.coalesce(F.col("quality").cast("string"), F.lit("na")).alias("quality"))


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_parsing FROM orders")
def mark_join(spark, d):
    keys = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("there", F.lit(True))
    return read(spark, d, "orders").select("o_orderkey").join(keys, "o_orderkey", "left").select("o_orderkey", F.col("there").isNotNull().alias("has_parsing"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_holdout(spark, d):
    return read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_missing(spark, d):
    return read(spark, d, "orders").select("o_orderkey").join(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""SELECT k, 'left' AS only_in FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey * 2 FROM orders) UNION ALL SELECT k, 'right' FROM (SELECT o_custkey * 2 AS k FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def symmetric_coverage(spark, d):
    return tables.symmetric_gaps(read(spark, d, "customer").select(F.col("c_custkey").alias("k")), read(spark, d, "orders").select((F.col("o_custkey") * 2).alias("k")), "k")


_REGION = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE WHEN l_returnflag = 'N' THEN 'na' ELSE l_returnflag END AS u, CASE WHEN l_linestatus = 'F' THEN 'na' WHEN l_partkey % 3 = 0 THEN 'A' ELSE l_linestatus END AS w FROM lineitem),
k AS (SELECT *, CASE WHEN u = 'na' AND w = 'na' THEN 'both_na' WHEN w = 'na' THEN 'upper_only' WHEN u = 'na' THEN 'lower_only' WHEN u = w THEN 'same' ELSE 'conflict' END AS kind FROM r)"""


def _region(spark, d):
    li = read(spark, d, "lineitem")
    u = F.when(F.col("l_returnflag") == "N", "na").otherwise(F.col("l_returnflag"))
    w = F.when(F.col("l_linestatus") == "F", "na").when(F.col("l_partkey") % 3 == 0, "A").otherwise(F.col("l_linestatus"))
    value, kind = tables.reconcile(u, w)
    return li.select(*_CODES.split(", "), value.alias("value"), kind.alias("kind"))


@query(f"WITH {_REGION} SELECT {_CODES}, kind, CASE kind WHEN 'upper_only' THEN u WHEN 'lower_only' THEN w WHEN 'same' THEN u ELSE 'na' END AS value FROM k")
def regional_resolve(spark, d):
    return _region(spark, d)


@query(f"WITH {_REGION} SELECT l_linenumber, count(*) FILTER (WHERE kind = 'both_na') AS both_na, count(*) FILTER (WHERE kind = 'upper_only') AS upper_only, count(*) FILTER (WHERE kind = 'lower_only') AS lower_only, count(*) FILTER (WHERE kind = 'same') AS same, count(*) FILTER (WHERE kind = 'conflict') AS conflict FROM k GROUP BY l_linenumber")
def regional_audit(spark, d):
    kinds = ["both_na", "upper_only", "lower_only", "same", "conflict"]
    return _region(spark, d).groupBy("l_linenumber").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def resume_dedup(spark, d):
    from draper.streaming.resume import latest

    return latest(read(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


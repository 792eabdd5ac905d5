"""Queries over masks and classifier heads; a mask's class counts come from lineitem, head scores from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from draper.functions import vocab as V
from draper.operators import palette as P
from draper.operators import perception as op
from draper.plans.adapter import read, tasks
from draper.plans.registry import query

_COUNTS = "counts AS (SELECT l_orderkey AS image_id, (l_partkey % 24)::INT AS class_id, l_quantity::BIGINT AS n FROM lineitem)"
_SLOTS = "[" + ", ".join(f"'{s}'" for s in V.SLOTS) + "]"
_SLOT = "CASE class_id " + " ".join(f"WHEN {c} THEN '{s}'" for c, s in op.CLASS_SLOT.items()) + " END"
_SKELETON = f"""{_COUNTS}, kept AS (SELECT image_id, {_SLOT} AS slot, class_id, sum(n)::BIGINT AS n FROM counts WHERE n > 0 GROUP BY ALL),
slots AS (SELECT image_id, slot, arg_max(class_id, n * 100 - class_id) AS class_id, sum(n)::BIGINT AS n FROM kept WHERE slot IS NOT NULL GROUP BY ALL),
skeleton AS (SELECT image_id, slot, row_number() OVER (PARTITION BY image_id ORDER BY list_position({_SLOTS}, slot)) - 1 AS pos, class_id, n,
 n / sum(n) OVER (PARTITION BY image_id) AS area FROM slots)"""


def _skeleton(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return op.mask_skeleton(lines.select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 24).cast("int").alias("class_id"), F.col("l_quantity").cast("long").alias("n")))


@query(f"WITH {_SKELETON} SELECT image_id, slot, pos, class_id, n, round(area, 9) AS area FROM skeleton")
def mask_skeleton(spark, d):
    return _skeleton(spark, d).withColumn("area", F.round("area", 9))


_STARTS = {h: sum(len(v) for v in list(op.HEAD_VALUES.values())[:i]) for i, h in enumerate(op.HEAD_VALUES)}


def _heads(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    parts = F.array(*[F.struct(F.lit(h).alias("head"), F.slice("embedding", at + 1, len(op.HEAD_VALUES[h])).cast("array<double>").alias("scores")) for h, at in _STARTS.items()])
    return op.decode_heads(v.select(F.col("vec_id").alias("image_id"), F.explode(parts).alias("p")).select("image_id", "p.*"))


_HEADS = "heads AS (" + " UNION ALL ".join(
    f"SELECT vec_id AS image_id, '{h}' AS head, [{', '.join(repr(v) for v in op.HEAD_VALUES[h])}][list_position(s, list_max(s))] AS label, 1 / list_sum([exp(x - list_max(s)) FOR x IN s]) AS probability"
    f" FROM (SELECT vec_id, embedding[{at + 1}:{at + len(op.HEAD_VALUES[h])}]::DOUBLE[] AS s FROM embeddings)" for h, at in _STARTS.items()
) + ")"


@query(f"WITH {_HEADS} SELECT image_id, head, label, round(probability, 6) AS probability FROM heads")
def head_decode(spark, d):
    return _heads(spark, d).withColumn("probability", F.round("probability", 6))


def _projection_sql() -> str:
    slots = " UNION ALL ".join(f"SELECT '{h}' AS head, '{f}' AS field, '{s}' AS slot, {i} AS nth" for h, (f, among) in V.HEADS.items() for i, s in enumerate(among))
    label = lambda f: f"max(label) FILTER (WHERE field = '{f}')"
    category = "CASE k.slot " + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in V.MASK_CATEGORY.items()) + " ELSE k.slot END"
    return f"""WITH {_SKELETON}, {_HEADS}, takes AS ({slots}),
given AS (SELECT image_id, slot, field, label, probability FROM takes JOIN skeleton USING (slot) JOIN heads USING (image_id, head) QUALIFY row_number() OVER (PARTITION BY image_id, head ORDER BY nth) = 1)
SELECT k.image_id, k.pos, k.slot, {category} AS category, coalesce({label('fabric')}, 'na') AS fabric, coalesce({label('pattern')}, 'na') AS pattern, {label('sleeve_length')} AS sleeve_length,
 {label('length')} AS length, {label('neckline')} AS neckline, round(coalesce(avg(probability), 0), 6)::DOUBLE AS confidence, round(any_value(k.area), 9) AS area
FROM skeleton k LEFT JOIN given g ON k.image_id = g.image_id AND k.slot = g.slot GROUP BY k.image_id, k.pos, k.slot"""


@query(_projection_sql())
def head_projection(spark, d):
    return op.project_heads(_skeleton(spark, d), _heads(spark, d)).withColumns({"confidence": F.round("confidence", 6), "area": F.round("area", 9)})


@query(f"""WITH {_HEADS}, f AS (SELECT image_id, split_part(head, '_', 2) AS field, label, probability FROM heads WHERE label <> 'na' AND (head LIKE '%\\_fabric' ESCAPE '\\' OR head LIKE '%\\_pattern' ESCAPE '\\')
 QUALIFY row_number() OVER (PARTITION BY image_id, split_part(head, '_', 2) ORDER BY list_position(['upper', 'lower', 'outer'], split_part(head, '_', 1))) = 1)
SELECT image_id, 0 AS pos, 'other' AS slot, 'unknown' AS category, coalesce(max(label) FILTER (WHERE field = 'fabric'), 'na') AS fabric, coalesce(max(label) FILTER (WHERE field = 'pattern'), 'na') AS pattern,
 round(coalesce(avg(probability), 0), 6)::DOUBLE AS confidence FROM (SELECT DISTINCT vec_id AS image_id FROM embeddings) LEFT JOIN f USING (image_id) GROUP BY image_id""")
def head_fallback(spark, d):
    return op.fallback_garments(_heads(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query()
def palette(spark, d):
    """Dominant colours per slot of small rasters, a pixel per ordered unit; no SQL, as it clusters."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    n, p = F.col("l_quantity").cast("int"), F.col("l_partkey")
    byte = lambda c: F.unhex(F.lpad(F.hex(c % 256), 2, "0"))
    pixel = F.concat(*[F.decode(byte(p * m), "ISO-8859-1") for m in (37, 91, 53)])
    run = F.struct("l_linenumber", "l_partkey", F.repeat(pixel, n).alias("rgb"), F.repeat(F.decode(byte(p % 24), "ISO-8859-1"), n).alias("mask"))
    wide = tasks(lines)
    runs = lines.repartition(wide, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    joined = [F.encode(F.array_join(F.col(f"runs.{f}"), ""), "ISO-8859-1").alias(f) for f in ("rgb", "mask")]
    found = P.measure(runs.select(F.col("l_orderkey").alias("image_id"), *joined), tasks=wide)
    return found.withColumns({c: F.round(c, 6) for c in ("lab_l", "lab_a", "lab_b", "share", "area")})

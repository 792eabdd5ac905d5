"""Ground-truth descriptions and training answers; labels come from orders, mask slots from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from draper.functions import vocab as V
from draper.operators import descriptions as op
from draper.plans.adapter import _list, _pick, read
from draper.plans.perception import _SKELETON, _skeleton
from draper.plans.registry import query

#: Column -> its vocabulary, and the divisor of the order key that picks an entry.
_LABELS = {
    "upper_fabric": (V.FABRICS, 1), "lower_fabric": (V.FABRICS, 8), "outer_fabric": (V.FABRICS, 64), "upper_pattern": (V.PATTERNS, 3), "lower_pattern": (V.PATTERNS, 5),
    "outer_pattern": (V.PATTERNS, 7), "sleeve_length": (V.SLEEVES, 2), "lower_length": (V.LENGTHS, 11), "neckline": (V.NECKLINES, 13),
}
_TABLE = "canon AS (SELECT o_orderkey AS image_id, o_orderkey % 3 <> 0 AS has_shape, " + ", ".join(
    f"{_list(v)}[((o_orderkey // {by}) % {len(v)} + 1)::INT] AS {c}" for c, (v, by) in _LABELS.items()) + " FROM orders)"
_BOTH = {a: f"CASE WHEN lower_{a} = 'na' THEN upper_{a} WHEN upper_{a} = 'na' THEN lower_{a} WHEN upper_{a} = lower_{a} THEN upper_{a} ELSE 'na' END" for a in ("fabric", "pattern")}
_TEXTURE = {a: f"CASE WHEN slot IN ('dress', 'romper') THEN {b} WHEN slot = 'upper' THEN upper_{a} WHEN slot = 'outer' THEN outer_{a} WHEN slot = 'lower' THEN lower_{a} ELSE 'na' END" for a, b in _BOTH.items()}
_OMIT = {a: f"slot NOT IN ('upper', 'outer', 'lower', 'dress', 'romper') OR (slot IN ('dress', 'romper') AND upper_{a} <> 'na' AND lower_{a} <> 'na' AND upper_{a} <> lower_{a})" for a in _BOTH}
_FIRST = lambda among: f"list_filter({among}, lambda s: list_contains(present, s))[1] = slot"
_DESCRIBED = f"""{_SKELETON}, {_TABLE}, bare AS (SELECT image_id, list_filter([CASE WHEN upper_fabric <> 'na' OR upper_pattern <> 'na' THEN 'upper' END,
 CASE WHEN outer_fabric <> 'na' OR outer_pattern <> 'na' THEN 'outer' END, CASE WHEN lower_fabric <> 'na' OR lower_pattern <> 'na' THEN 'lower' END], lambda s: s IS NOT NULL) AS s FROM canon ANTI JOIN skeleton USING (image_id)),
placed AS (SELECT image_id, slot, pos FROM skeleton UNION ALL SELECT image_id, unnest(s), generate_subscripts(s, 1) - 1 FROM bare),
joined AS (SELECT *, list(slot) OVER (PARTITION BY image_id) AS present FROM placed JOIN canon USING (image_id)),
described AS (SELECT image_id, pos, slot, CASE slot {' '.join(f"WHEN '{s}' THEN '{c}'" for s, c in V.MASK_CATEGORY.items())} ELSE slot END AS category, 'unknown' AS color,
 {_TEXTURE['pattern']} AS pattern, {_TEXTURE['fabric']} AS fabric, CASE WHEN has_shape AND {_FIRST(_list(op.SLEEVED))} THEN sleeve_length END AS sleeve_length,
 CASE WHEN has_shape AND {_FIRST(_list(op.HEMMED))} THEN lower_length END AS length, CASE WHEN has_shape AND {_FIRST(_list(op.SLEEVED))} THEN neckline END AS neckline,
 concat_ws(',', CASE WHEN {_OMIT['fabric']} THEN 'fabric' END, CASE WHEN {_OMIT['pattern']} THEN 'pattern' END) AS omitted FROM joined)"""


def _canon(spark, d):
    key = F.col("image_id")
    table = read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    return table.select("image_id", (key % 3 != 0).alias("has_shape"), *[_pick(v, F.floor(key / by) % len(v)).alias(c) for c, (v, by) in _LABELS.items()])


def _described(spark, d):
    return op.describe(_canon(spark, d), _skeleton(spark, d))


@query(f"WITH {_DESCRIBED} SELECT * FROM described")
def describe_images(spark, d):
    return _described(spark, d).withColumn("omitted", F.array_join("omitted", ","))


@query(f"""WITH {_DESCRIBED} SELECT image_id, string_agg(concat_ws(' | ', slot || ': ' || category, 'color=' || color, CASE WHEN NOT contains(omitted, 'pattern') THEN 'pattern=' || pattern END,
 CASE WHEN NOT contains(omitted, 'fabric') THEN 'fabric=' || fabric END, 'sleeve_length=' || sleeve_length, 'length=' || length, 'neckline=' || neckline), chr(10) ORDER BY pos) AS answer FROM described GROUP BY image_id""")
def training_answers(spark, d):
    return op.training_answers(_described(spark, d))

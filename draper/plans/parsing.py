"""Queries that read garments back from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from draper.functions.text import serialize_garment
from draper.operators.free_text import parse_text
from draper.plans.adapter import GARMENTS, garments
from draper.plans.registry import query

_FIELDS = ["color", "pattern", "fabric", "sleeve_length", "length", "neckline"]
_SHOWN = ["slot", "category", *_FIELDS]


@query(f"""WITH {GARMENTS}, firsts AS (SELECT * FROM garments QUALIFY row_number() OVER (PARTITION BY image_id, slot, category ORDER BY pos) = 1)
SELECT image_id, slot || '_' || (row_number() OVER (PARTITION BY image_id, slot ORDER BY pos) - 1) AS ref, {', '.join(_SHOWN)}, 1.0::DOUBLE AS confidence FROM firsts""")
def parse_keyed_text(spark, d):
    """Descriptions written out as keyed lines and parsed again: one garment for each slot and category."""
    lines = garments(spark, d).select("image_id", "pos", serialize_garment(_FIELDS).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    texts = lines.groupBy("image_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
    g = parse_text(texts).select("image_id", F.explode("garments").alias("g"))
    return g.select("image_id", "g.ref", *[f"g.{c}" for c in _SHOWN], "g.confidence")


@query(f"""WITH {GARMENTS} SELECT slot, replace(color, '_', ' ') AS word, color, pattern, fabric, count(*) AS n
FROM garments GROUP BY ALL""")
def parse_loose_lines(spark, d):
    """Slot lines without keys, as ``slot: item, colour, pattern pattern, fabric``: every garment's line is parsed."""
    word = F.replace("color", F.lit("_"), F.lit(" "))
    line = F.concat(F.lit("- **"), "slot", F.lit("**: item, "), word, F.lit(", "), F.replace("pattern", F.lit("_"), F.lit(" ")), F.lit(", "), "fabric")
    p = parse_text(garments(spark, d).select(word.alias("word"), line.alias("text"))).withColumn("g", F.col("garments")[0])
    return p.groupBy("g.slot", "word", "g.color", "g.pattern", "g.fabric").agg(F.count("*").alias("n"))

"""Audits of annotations and measured colours, as counts in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draper.functions import color
from draper.functions import vocab as V
from draper.operators.rules import usable_lab, with_refs
from draper.operators.tables import reconcile

ONE_PIECE, REGIONS = ["dress", "romper"], ["upper", "outer", "lower"]
#: Names that carry no hue, and the chroma from which such a name is suspicious. Fixed values.
ACHROMATIC, HIGH_CHROMA = ["black", "white", "gray", "beige"], 25.0


def ground_truth_audit(table: DataFrame, skeleton: DataFrame) -> DataFrame:
    """(section, slot, counter, n): slots that masks show, regions whose labels are both na, and what supports one-piece garments.

    table has the label columns and has_shape by image; skeleton a row for each (image, slot). An
    image of the skeleton that the table lacks fails.
    """
    fail = F.raise_error(F.concat(F.lit("no labels for "), F.col("image_id").cast("string"))).cast("boolean")
    j = skeleton.select("image_id", "slot").distinct().join(table.withColumn("_known", F.lit(True)), "image_id", "left")
    j = j.where(F.coalesce("_known", fail))
    one = lambda section, counter: F.struct(F.lit(section).alias("section"), (F.lit(counter) if isinstance(counter, str) else counter).alias("counter"))
    slot = F.col("slot")
    made = [one("presence", "images")]
    for r in REGIONS:
        made.append(F.when((slot == r) & (F.col(f"{r}_fabric") == "na") & (F.col(f"{r}_pattern") == "na"), one("texture", "both_na")))
    piece = slot.isin(ONE_PIECE)
    made.append(F.when(piece & F.col("has_shape"), one("one_piece", "shape_annotated")))
    for a in ("fabric", "pattern"):
        _, kind = reconcile(F.col(f"upper_{a}"), F.col(f"lower_{a}"))
        made.append(F.when(piece, one(f"one_piece_{a}", kind)))
    found = j.select("slot", F.explode(F.array_compact(F.array(*made))).alias("x")).groupBy("x.section", "slot", "x.counter").agg(F.count("*").alias("n"))
    every = table.sparkSession.createDataFrame([("presence", s, "images") for s in V.SLOTS], "section string, slot string, counter string")
    return every.join(found, ["section", "slot", "counter"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))


def _measured(g: DataFrame) -> DataFrame:
    m = g.where(usable_lab([F.col(f"lab_{c}") for c in "lab"]))
    hue = F.pmod(F.degrees(F.atan2("lab_b", "lab_a")), F.lit(360.0))
    return m.withColumns({"chroma": F.hypot("lab_a", "lab_b"), "hue_degrees": hue, "family": color.hue_family(hue), "plain": F.col("color").isin(ACHROMATIC)})


def chroma_families(g: DataFrame, threshold: float = HIGH_CHROMA) -> DataFrame:
    """(family, n, achromatic): measured garments of high chroma by the family of their hue, and those of them with an achromatic name."""
    if threshold <= 0:
        raise ValueError("the threshold is not positive")
    return _measured(g).where(F.col("chroma") >= threshold).groupBy("family").agg(F.count("*").alias("n"), F.count_if("plain").alias("achromatic"))


def suspicious_colors(g: DataFrame, most: int = 20, threshold: float = HIGH_CHROMA) -> DataFrame:
    """The garments of most chroma among those with an achromatic name: a top-k by (chroma, image, ref)."""
    if most < 1:
        raise ValueError("most is less than 1")
    s = _measured(with_refs(g)).where((F.col("chroma") >= threshold) & F.col("plain"))
    top = s.orderBy(F.desc("chroma"), "image_id", "ref").limit(most)
    return top.select("image_id", "ref", "slot", F.col("color").alias("assigned"), "family", *[F.round(c, 2).alias(c) for c in ("chroma", "hue_degrees", "lab_l", "lab_a", "lab_b")])


def sampled_ids(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """n ids with the least keyed hash, in order: the same for a seed whatever the partitions."""
    key = F.xxhash64(F.lit(seed), F.col("image_id").cast("string"))
    return ids.select("image_id").distinct().orderBy(key, "image_id").limit(n).orderBy("image_id")

"""From mask class counts and head scores to garments.

Inputs are long tables: (image_id, class_id, n) of a parsing mask and (image_id, head,
scores) of a classifier, so every step is an aggregate or an equi-join on image_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draper.functions import vocab as V
from draper.operators.rules import lookup

CLASS_SLOT = {c: slot for slot, classes in V.MASK_CLASSES.items() for c in classes}
HEAD_VALUES = {
    head: {"fabric": V.FABRICS, "pattern": V.PATTERN_CODES, "sleeve_length": V.SLEEVES, "length": V.LENGTHS, "neckline": V.NECKLINES}[field]
    for head, (field, _) in V.HEADS.items()
}
FIELDS = ["fabric", "pattern", "sleeve_length", "length", "neckline"]


def _order(slot: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, V.SLOTS)), slot) - 1


def mask_skeleton(counts: DataFrame) -> DataFrame:
    """image_id, slot, pos, class_id (most pixels, then the least class), n, area (of the garment pixels of the image).

    Classes of no slot and counts of 0 are background; an image with nothing else has no rows.
    """
    kept = counts.where(F.col("n") > 0).withColumn("slot", lookup(CLASS_SLOT, F.col("class_id").cast("int"))).where(F.col("slot").isNotNull())
    classes = kept.groupBy("image_id", "slot", "class_id").agg(F.sum("n").alias("n"))
    slots = classes.groupBy("image_id", "slot").agg(F.max_by("class_id", F.struct(F.col("n"), -F.col("class_id"))).alias("class_id"), F.sum("n").alias("n"))
    outfit = Window.partitionBy("image_id")
    pos = F.row_number().over(outfit.orderBy(_order(F.col("slot")))) - 1
    return slots.select("image_id", "slot", pos.alias("pos"), "class_id", "n", (F.col("n") / F.sum("n").over(outfit)).alias("area"))


def decode_heads(scores: DataFrame) -> DataFrame:
    """image_id, head, label of the first largest score, its softmax probability; a score that is not finite is an error."""
    finite = F.forall("scores", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    checked = F.when(finite, F.col("scores")).otherwise(F.raise_error(F.concat(F.lit("not a finite score: head "), "head")).cast("array<double>"))
    s = scores.withColumn("scores", checked.cast("array<double>")).withColumn("top", F.array_max("scores"))
    total = F.aggregate(F.transform("scores", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    names = F.try_element_at(F.create_map(*[x for h, v in HEAD_VALUES.items() for x in (F.lit(h), F.array(*map(F.lit, v)))]), F.col("head"))
    return s.select("image_id", "head", F.try_element_at(names, F.array_position("scores", F.col("top")).cast("int")).alias("label"), (1 / total).alias("probability"))


def project_heads(skeleton: DataFrame, heads: DataFrame) -> DataFrame:
    """Garments of masked images: the fields that heads give to slots, confidence the mean probability of those heads (0 for none)."""
    wide = heads.groupBy("image_id").agg(*[F.max(F.when(F.col("head") == h, F.struct("label", "probability"))).alias(h) for h in V.HEADS])
    present = F.collect_set("slot").over(Window.partitionBy("image_id"))
    g = skeleton.withColumn("_present", present).join(wide, "image_id", "left")
    takes = {}
    for head, (_, slots) in V.HEADS.items():
        first = F.filter(F.array(*map(F.lit, slots)), lambda s: F.array_contains("_present", s))
        takes[head] = F.when(F.col("slot") == F.try_element_at(first, F.lit(1)), F.col(head))
    out = {f: F.coalesce(*[takes[h]["label"] for h, (field, _) in V.HEADS.items() if field == f]) for f in FIELDS}
    for f in ("fabric", "pattern"):
        out[f] = F.coalesce(out[f], F.lit("na"))
    used = F.array_compact(F.array(*[t["probability"] for t in takes.values()]))
    mean = F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0), lambda a, x: a + x) / F.size(used)).otherwise(0.0)
    category = F.coalesce(lookup(V.MASK_CATEGORY, F.col("slot")), F.col("slot"))
    return g.select("image_id", "pos", "slot", category.alias("category"), *[c.alias(f) for f, c in out.items()], mean.alias("confidence"), "area")


def fallback_garments(heads: DataFrame) -> DataFrame:
    """One garment for each image without a mask: fabric and pattern of the first head that is not na (upper, lower, outer)."""
    wide = heads.groupBy("image_id").agg(*[F.max(F.when(F.col("head") == h, F.struct("label", "probability"))).alias(h) for h in V.HEADS])
    first = {}
    for field in ("fabric", "pattern"):
        first[field] = F.coalesce(*[F.when(F.col(f"{s}_{field}")["label"] != "na", F.col(f"{s}_{field}")) for s in ("upper", "lower", "outer")])
    sure = F.array_compact(F.array(*[c["probability"] for c in first.values()]))
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.size(sure)).otherwise(0.0)
    labels = [F.coalesce(c["label"], F.lit("na")).alias(f) for f, c in first.items()]
    return wide.select("image_id", F.lit(0).alias("pos"), F.lit("other").alias("slot"), F.lit("unknown").alias("category"), *labels, mean.alias("confidence"))


def apply_measured(g: DataFrame, measured: DataFrame) -> DataFrame:
    """Sets Lab, its source and area where (image_id, slot) was measured; the colour's name only where it was unknown."""
    m = measured.select("image_id", "slot", *[F.col(c).alias(f"_{c}") for c in ("lab_l", "lab_a", "lab_b", "name", "area", "source")])
    got = F.col("_lab_l").isNotNull()
    joined = g.join(m, ["image_id", "slot"], "left")
    keep = lambda c: F.col(c) if c in g.columns else F.lit(None)
    sets = {c: F.when(got, F.col(f"_{c}")).otherwise(keep(c)) for c in ("lab_l", "lab_a", "lab_b", "area")}
    sets["lab_source"] = F.when(got, F.col("_source")).otherwise(keep("lab_source"))
    sets["color"] = F.when(got & (keep("color").isNull() | (keep("color") == "unknown")), F.col("_name")).otherwise(F.coalesce(keep("color"), F.lit("unknown")))
    return joined.withColumns(sets).drop(*[f"_{c}" for c in ("lab_l", "lab_a", "lab_b", "name", "area", "source")])


def color_target(g: DataFrame) -> DataFrame:
    """The garment of each image that takes the colour of a whole image: by slot priority, then position."""
    rank = F.array_position(F.array(*map(F.lit, V.COLOR_PRIORITY)), F.col("slot"))
    return g.groupBy("image_id").agg(F.min_by(F.struct("slot", "pos"), F.struct(rank, "pos")).alias("t")).select("image_id", "t.slot", "t.pos")

"""Annotated images to garments, and garments to training examples.

The canonical table gives regional labels per image, a mask (or, without one, the texture
labels) the slots. An image that neither gives a slot has no garments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draper.functions import vocab as V
from draper.functions.text import serialize_garment
from draper.operators.rules import lookup
from draper.operators.tables import reconcile

SLEEVED, HEMMED = ["dress", "romper", "upper", "outer"], ["dress", "romper", "lower"]
REGIONS, ONE_PIECE = ["upper", "outer", "lower"], ["dress", "romper"]
FIELDS = ["color", "pattern", "fabric", "sleeve_length", "length", "neckline"]


def texture_slots(table: DataFrame) -> DataFrame:
    """(image_id, slot, pos) of the regions with a fabric or pattern, for images without a mask."""
    seen = F.array_compact(F.array(*[F.when((F.col(f"{s}_fabric") != "na") | (F.col(f"{s}_pattern") != "na"), s) for s in REGIONS]))
    return table.select("image_id", F.posexplode(seen).alias("pos", "slot")).select("image_id", "slot", "pos")


def texture_value(attribute: str) -> Column:
    """The regional label of a direct slot, both regions reconciled for one-piece slots, else na."""
    both, _ = reconcile(F.col(f"upper_{attribute}"), F.col(f"lower_{attribute}"))
    direct = F.when(F.col("slot").isin(ONE_PIECE), both)
    for s in REGIONS:
        direct = direct.when(F.col("slot") == s, F.col(f"{s}_{attribute}"))
    return direct.otherwise("na")


def describe(table: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Garments of every image, with ``omitted``: fields that no annotation supports and training must not see."""
    masked = skeleton.select("image_id", "slot", "pos")
    slots = masked.unionByName(texture_slots(table.join(masked, "image_id", "left_anti")))
    present = F.collect_set("slot").over(Window.partitionBy("image_id"))
    g = slots.join(table, "image_id").withColumn("_present", present)
    first = lambda among: F.try_element_at(F.filter(F.array(*map(F.lit, among)), lambda s: F.array_contains("_present", s)), F.lit(1))
    shape = lambda among, c: F.when(F.col("has_shape") & (F.col("slot") == first(among)), F.col(c))
    omitted = []
    for a in ("fabric", "pattern"):
        _, kind = reconcile(F.col(f"upper_{a}"), F.col(f"lower_{a}"))
        torn = F.col("slot").isin(ONE_PIECE) & (kind == "conflict")
        omitted.append(F.when(torn | ~F.col("slot").isin(*REGIONS, *ONE_PIECE), a))
    return g.select(
        "image_id", "pos", "slot", F.coalesce(lookup(V.MASK_CATEGORY, F.col("slot")), F.col("slot")).alias("category"), F.lit("unknown").alias("color"),
        texture_value("pattern").alias("pattern"), texture_value("fabric").alias("fabric"), shape(SLEEVED, "sleeve_length").alias("sleeve_length"),
        shape(HEMMED, "lower_length").alias("length"), shape(SLEEVED, "neckline").alias("neckline"), F.array_compact(F.array(*omitted)).alias("omitted"),
    )


def training_answers(g: DataFrame) -> DataFrame:
    """(image_id, answer): the keyed lines of an image's garments in order, without omitted fields."""
    shown = g.withColumns({a: F.when(~F.array_contains("omitted", a), F.col(a)) for a in ("fabric", "pattern")})
    lines = shown.select("image_id", F.struct("pos", serialize_garment(FIELDS).alias("line")).alias("l"))
    return lines.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list("l")).getField("line"), "\n").alias("answer"))


def conversational(answers: DataFrame, image: Column, prompt: str) -> DataFrame:
    """One JSON record for each example: the image and prompt of a user, the answer of an assistant."""
    part = lambda kind, text=None: F.struct(F.lit(kind).alias("type"), *([] if text is None else [text.alias("text")]))
    asks = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), part("text", F.lit(prompt))).alias("content")))
    tells = F.array(F.struct(F.lit("assistant").alias("role"), F.array(part("text", F.col("answer"))).alias("content")))
    return answers.select("image_id", F.to_json(F.struct(image.alias("image"), asks.alias("prompt"), tells.alias("completion"))).alias("record"))

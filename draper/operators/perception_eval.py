"""Predicted garments against annotations: comparisons by field, metrics, schema validity, raw heads.

The first garment of every slot is picked by one aggregate per image, so a comparison is a
row-wise expression over two structs and the labels' row, never a join of garments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draper.functions import vocab as V
from draper.operators.metrics import accuracy_macro_f1

ONE_PIECE = ["dress", "romper"]
#: Field -> label columns and the slots whose first present garment answers for them. Fixed values.
TEXTURE = {
    f: {f"upper_{f}": ["upper", *ONE_PIECE], f"lower_{f}": ["lower", *ONE_PIECE], f"outer_{f}": ["outer"]} for f in ("fabric", "pattern")
}
#: Field -> its label column and the slots that can answer. Fixed values.
SHAPE = {
    "sleeve_length": ("sleeve_length", ["dress", "romper", "upper", "outer"]), "length": ("lower_length", ["dress", "romper", "lower"]),
    "neckline": ("neckline", ["dress", "romper", "upper", "outer"]),
}
COLOURED = [s for s in V.SLOTS if s != "other"]
COMPARED = ["color", *TEXTURE, *SHAPE]
SHAPE_HEADS = [column for column, _ in SHAPE.values()]


def first_garments(g: DataFrame) -> DataFrame:
    """image_id and, for each slot, a struct of its first garment (null where it has none)."""
    one = F.struct("color", *TEXTURE, *SHAPE)
    return g.groupBy("image_id").agg(*[F.min_by(F.when(F.col("slot") == s, one), F.when(F.col("slot") == s, F.col("pos"))).alias(s) for s in COLOURED])


def nested(g: DataFrame, name: str) -> DataFrame:
    """image_id and a struct of the first garments of its slots."""
    return first_garments(g).select("image_id", F.struct(*COLOURED).alias(name))


def slot_value(garments: str, slots: list[str], field: str) -> Column:
    """The field of the first slot that is present, na if that has none or no slot is present."""
    at = [F.col(f"{garments}.{s}") for s in slots]
    return F.coalesce(*[F.when(x.isNotNull(), F.coalesce(x[field], F.lit("na"))) for x in at], F.lit("na"))


def shape_value(garments: str, slots: list[str], field: str) -> Column:
    """The field of the first slot that has one, na if none does."""
    return F.coalesce(*[F.col(f"{garments}.{s}")[field] for s in slots], F.lit("na"))


def fallbacks(g: DataFrame) -> DataFrame:
    """(image_id, fallback): true where the parser found no garment and made one up."""
    only = (F.col("slot") == "other") & (F.col("category") == "unknown") & (F.col("confidence") == 0)
    return g.groupBy("image_id").agg(((F.count("*") == 1) & F.coalesce(F.bool_and(only), F.lit(False))).alias("fallback"))


def covering(left: DataFrame, right: DataFrame, what: str) -> DataFrame:
    """The join by image_id, which fails when it is read if one side has an image that the other has not."""
    a, b = left.withColumn("_a", F.lit(True)), right.withColumn("_b", F.lit(True))
    fail = F.raise_error(F.concat(F.lit(f"{what} do not cover the images exactly: "), F.col("image_id").cast("string"))).cast("boolean")
    both = F.when(F.col("_a") & F.col("_b"), F.lit(True)).otherwise(fail)
    return a.join(b, "image_id", "full_outer").where(both).drop("_a", "_b")


def comparisons(labels: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(image_id, field, actual, predicted, supervised) of every comparison.

    Colours are compared in the slots that the truth has, textures by region, shapes once an
    image and unsupervised where the labels have no shape.
    """
    return compared(covering(covering(labels, nested(truth, "t"), "true garments"), nested(predicted, "p"), "predictions"))


def compared(j: DataFrame) -> DataFrame:
    """The comparisons of labels that were joined with the true garments (``nested`` as t) and the predicted ones (as p)."""
    row = lambda field, actual, guess, sure: F.struct(F.lit(field).alias("field"), actual.alias("actual"), guess.alias("predicted"), sure.alias("supervised"))
    made = [F.when(F.col(f"t.{s}").isNotNull(), row("color", F.coalesce(F.col(f"t.{s}.color"), F.lit("na")), slot_value("p", [s], "color"), F.lit(True))) for s in COLOURED]
    made += [row(f, F.col(c), slot_value("p", slots, f), F.lit(True)) for f, columns in TEXTURE.items() for c, slots in columns.items()]
    made += [row(f, F.col(c), shape_value("p", slots, f), F.col("has_shape")) for f, (c, slots) in SHAPE.items()]
    return j.select("image_id", F.explode(F.array_compact(F.array(*made))).alias("x")).select("image_id", "x.*")


def field_metrics(compared: DataFrame) -> DataFrame:
    """field, n, accuracy, macro_f1, excluded, undefined (the reason, where nothing could be compared)."""
    every = compared.sparkSession.createDataFrame([(f,) for f in COMPARED], "field string")
    c = compared.groupBy("field", "actual", "predicted").agg(F.count_if("supervised").alias("n"), F.count_if(~F.col("supervised")).alias("excluded"))
    # a pair counts for both of its labels, but its rows for the first only: one pass gives all figures
    right, none = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0), F.lit(0).cast("long")
    side = lambda label, *sums: F.struct(F.col(label).alias("label"), F.col("n").alias("seen"), *[x.alias(k) for k, x in zip(("right", "n", "excluded"), sums)])
    sides = c.select("field", F.explode(F.array(side("actual", right, F.col("n"), F.col("excluded")), side("predicted", none, none, none))).alias("x")).select("field", "x.*")
    by = sides.groupBy("field", "label").agg(*[F.sum(k).alias(k) for k in ("seen", "right", "n", "excluded")])
    measured = by.groupBy("field").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("right"), F.sum("n")).alias("accuracy"),
        F.avg(F.try_divide(2 * F.col("right"), F.col("seen"))).alias("macro_f1"), F.sum("excluded").alias("excluded"),
    )
    j = every.join(measured, "field", "left")
    return j.select(
        "field", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "accuracy", "macro_f1", F.coalesce("excluded", F.lit(0)).cast("long").alias("excluded"),
        F.when(F.coalesce("n", F.lit(0)) == 0, "no_supervised_rows").alias("undefined"),
    )


def schema_validity(predicted: DataFrame) -> DataFrame:
    """sample_size, valid_generations and their share: predictions that are no fallback."""
    f = fallbacks(predicted).agg(F.count("*").alias("sample_size"), F.count_if(~F.col("fallback")).alias("valid_generations"))
    return f.withColumn("schema_validity", F.coalesce(F.try_divide("valid_generations", "sample_size"), F.lit(0.0)))


def head_scores(labels: DataFrame, readouts: DataFrame) -> DataFrame:
    """head, n, accuracy, macro_f1, excluded of raw heads: (image_id, head, label) against the label column of the head's name.

    Shape heads are supervised only where the labels have a shape; a class that neither side uses doesn't count.
    """
    heads = [c for c in labels.columns if c in {*SHAPE_HEADS, *(c for columns in TEXTURE.values() for c in columns)}]
    actual = labels.unpivot(["image_id", "has_shape"], heads, "head", "actual")
    j = readouts.join(actual, ["image_id", "head"]).withColumn("supervised", ~F.col("head").isin(SHAPE_HEADS) | F.col("has_shape"))
    measured = accuracy_macro_f1(j.where("supervised").select(F.col("head").alias("field"), "actual", F.col("label").alias("predicted")))
    excluded = j.groupBy(F.col("head").alias("field")).agg(F.count_if(~F.col("supervised")).alias("excluded"))
    return excluded.join(measured, "field", "left").select(F.col("field").alias("head"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "accuracy", "macro_f1", "excluded")


def selection_score(scores: DataFrame) -> DataFrame:
    """The mean macro-F1 of the heads that were measured."""
    return scores.where("n > 0").agg(F.avg("macro_f1").alias("selection_score"), F.count("*").alias("heads"))


def encode_labels(table: DataFrame, vocabularies: dict[str, list[str]]) -> DataFrame:
    """Class numbers (from 0) of label columns, a value outside its vocabulary fails; shape heads are supervised where the image has a shape."""
    out = []
    for c, values in vocabularies.items():
        at = F.array_position(F.array(*map(F.lit, values)), F.col(c)).cast("int") - 1
        bad = F.raise_error(F.concat(F.lit(f"{c} has no class "), F.coalesce(F.col(c), F.lit("null")))).cast("int")
        out += [F.when(at >= 0, at).otherwise(bad).alias(c), (F.col("has_shape") if c in SHAPE_HEADS else F.lit(True)).alias(f"{c}_supervised")]
    return table.select("image_id", *out)


def untrained_heads(encoded: DataFrame, heads: list[str]) -> DataFrame:
    """Heads without a supervised row."""
    each = F.array(*[F.struct(F.lit(h).alias("head"), F.col(f"{h}_supervised").alias("sure")) for h in heads])
    rows = encoded.select(F.explode(each).alias("x")).groupBy("x.head").agg(F.count_if(F.col("x.sure")).alias("n"))
    return rows.where("n = 0").select("head")

"""Table building: checked joins, decoding, identity, splits, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draper.operators.ranking import numbered


#: An image's name: gender, category, product id and shot.
IDENTITY = r"^(([A-Za-z]+)-(.+)-id_\d{8})-(.+)$"


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, which fails when it is read if a key repeats: rows are numbered within their key, and a second one raises.

    Nothing runs while the plan is built; the window's shuffle is by the keys, so a join by them reuses it.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    told = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    fail = F.raise_error(F.concat(F.lit(f"{', '.join(keys)} is not unique: "), told)).cast("boolean")
    return df.withColumn("_nth", nth).where(F.when(F.col("_nth") > 1, fail).otherwise(F.lit(True))).drop("_nth")


def decode(code: Column, vocabulary: list[str]) -> Column:
    """Code -> vocabulary entry; null where it is no code of it."""
    n = code.try_cast("int")
    return F.when(n.between(0, len(vocabulary) - 1), F.element_at(F.array(*map(F.lit, vocabulary)), n + 1))


def reconcile(upper: Column, lower: Column) -> tuple[Column, Column]:
    """Regional labels -> (value, kind): a conflict and two missing labels give na."""
    na = F.lit("na")
    kind = (
        F.when((upper == na) & (lower == na), "both_na").when(lower == na, "upper_only").when(upper == na, "lower_only")
        .when(upper == lower, "same").otherwise("conflict")
    )
    value = F.when(lower == na, upper).when(upper == na, lower).when(upper == lower, upper).otherwise(na)
    return value, kind


def group_key(image_id: Column) -> Column:
    """The product group of an image: its id through the first id_ and eight digits; an id without them fails when it is read."""
    found = F.regexp_extract(image_id, r"^(.*?id_\d{8})", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no product id in "), F.coalesce(image_id, F.lit("null")))).cast("string"))


def identity(df: DataFrame, column: str = "name") -> DataFrame:
    """garment_id, gender, category, shot from file names; rows that don't match go."""
    part = lambda i: F.regexp_extract(column, IDENTITY, i)
    return df.where(F.col(column).rlike(IDENTITY)).select(
        "*", part(1).alias("garment_id"), F.lower(part(2)).alias("gender"), part(3).alias("category_from_filename"), part(4).alias("shot")
    )


def fold_split(groups: DataFrame, folds: int = 7, seed: int = 20260101) -> DataFrame:
    """(group, stratum, size) -> split: groups dealt in turn within a stratum by (size desc, keyed hash, group).

    Groups are numbered by ranges, so a stratum needs no task of its own; whole numbers are keyed by arithmetic, other groups by a hash.
    """
    integral = groups.schema["group"].dataType.typeName() in ("byte", "short", "integer", "long")
    key = (F.col("group") * 48271 + seed) if integral else F.xxhash64(F.lit(seed), "group")
    order = F.pmod(key, F.lit(2147483647)) - F.col("size").cast("long") * 2147483648
    dealt = numbered(groups.withColumn("_order", order), "stratum", "_order", "_nth", "_size", ("group",))
    fold = F.col("_nth") % folds
    return dealt.withColumn("split", F.when(fold == 0, "test").when(fold == 1, "val").otherwise("train")).drop("_order", "_nth", "_size")


def symmetric_gaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("right")))

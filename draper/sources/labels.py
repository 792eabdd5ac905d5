"""Label files, captions and images: readers with the checks that make bad input fail."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draper.functions import vocab as V
from draper.functions.text import stem
from draper.operators.tables import IDENTITY, assert_unique, decode

FABRIC = {f"{r}_fabric": V.FABRICS for r in ("upper", "lower", "outer")}
PATTERN = {f"{r}_pattern": V.PATTERN_CODES for r in ("upper", "lower", "outer")}
#: Fields of a line, the image's name included.
SHAPE_WIDTH, TEXTURE_WIDTH = len(V.SHAPE_CODES) + 1, len(FABRIC) + 1


def read_labels(spark: SparkSession, path: str, fields: dict[str, list[str]]) -> DataFrame:
    """image_id and one column for each field; a wrong width, code or a repeated id fails.

    Blank lines and a byte order mark are skipped; fields are split at any white space.
    """
    cells = F.split(F.trim(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\s+", " ")), " ")
    rows = spark.read.text(path).select(cells.alias("c"), "value").where(F.trim(F.regexp_replace("value", "[﻿\\s]+", "")) != "")
    out = [F.when(F.size("c") == len(fields) + 1, stem(F.col("c")[0])).otherwise(F.raise_error(F.concat(F.lit("wrong width: "), "value"))).alias("image_id")]
    for i, (name, words) in enumerate(fields.items()):
        value = decode(F.get("c", F.lit(i + 1)), words)
        out.append(F.coalesce(value, F.raise_error(F.concat(F.lit(f"bad {name}: "), "value")).cast("string")).alias(name))
    return assert_unique(rows.select(*out), "image_id")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, caption) of a JSON object name -> text, [text], or {caption|description|text: text}."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "raw"))
    lists = F.from_json("raw", "array<string>")
    record = F.from_json("raw", "caption string, description string, text string")
    whole = F.forall(lists, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    text = (
        F.when(F.col("raw").startswith("["), F.when(whole, F.array_join(F.transform(lists, lambda x: F.trim(x)), " ")))
        .when(F.col("raw").startswith("{"), F.coalesce(record["caption"], record["description"], record["text"]))
        .otherwise(F.col("raw"))
    )
    fail = F.raise_error(F.concat(F.lit("caption is not text: "), F.col("name"))).cast("string")
    return assert_unique(doc.select(stem(F.col("name")).alias("image_id"), F.coalesce(F.trim(text), fail).alias("caption")), "image_id")


def outfit_table(labels: DataFrame, captions: DataFrame, masks: DataFrame) -> DataFrame:
    """The 26-column table from the labels of an image a row: has_shape before the fill, captions, identity from names, mask mark.

    An id that repeats on any side fails when it is read; an image without a caption has an empty one.
    """
    from draper.operators.tables import identity

    columns = list(V.SHAPE_CODES)
    j = assert_unique(labels, "image_id").join(assert_unique(captions, "image_id"), "image_id", "left")
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    j = j.withColumn("has_shape", full).fillna("na", columns).fillna("", ["caption"])
    marked = masks.select(F.regexp_replace("image_id", "_segm$", "").alias("image_id")).distinct().withColumn("has_parsing", F.lit(True))
    j = identity(j.join(marked, "image_id", "left"), "image_id").withColumn("has_parsing", F.coalesce("has_parsing", F.lit(False)))
    return j.select(
        "image_id", "garment_id", "gender", "category_from_filename", *FABRIC, *PATTERN, *columns, "caption", "has_shape", "has_parsing",
        F.col("image_id").endswith("_full").alias("is_full_body"),
    )


def read_outfits(spark: SparkSession, path: str) -> DataFrame:
    """The canonical table; an id that repeats fails when it is read."""
    return assert_unique(spark.read.parquet(path), "image_id")


def write_outfits(table: DataFrame, path: str, limit: int | None = None) -> dict:
    """Writes the table in order of id, by a temporary folder that takes the name at the end; a failure leaves the old one.

    limit keeps the first ids only. Returns the number of rows and of captions; fails if no image has one.
    """
    spark = table.sparkSession
    ordered = table.orderBy("image_id") if limit is None else table.orderBy("image_id").limit(limit)
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        ordered.write.parquet(part)
        n, told = spark.read.parquet(part).agg(F.count("*"), F.count_if(F.col("caption") != "")).first()
        if n and not told:
            raise ValueError("no caption matches an image")
        fs.delete(fs_path(path), True)
        if not fs.rename(fs_path(part), fs_path(path)):
            raise OSError(f"could not rename to {path}")
    finally:
        fs.delete(fs_path(part), True)
    return {"rows": n, "captions": told}


def unmatched_names(names: DataFrame, column: str = "image_id") -> DataFrame:
    """One row: how many names carry no identity, which the table drops."""
    return names.agg(F.count_if(~F.coalesce(F.col(column).rlike(IDENTITY), F.lit(False))).alias("dropped"))

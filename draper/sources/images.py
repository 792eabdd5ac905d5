"""Photographs and parsing masks, decoded by the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draper.functions.text import stem

IN_MEMORY = "in_memory"


def image_identity(path: Column) -> Column:
    return F.coalesce(F.nullif(stem(path), F.lit("")), F.lit(IN_MEMORY))


def _channels(images: DataFrame, column: str, first_only: bool) -> Column:
    """Bytes in RGB order (the source's are BGR, BGRA or grey), or of the first channel only."""

    def reorder(data: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for raw, channels in zip(data, n):
            if channels < 1:  # a file that can't be decoded
                out.append(None)
                continue
            red = 2 if channels >= 3 else 0
            planes = [raw[red::channels]] if first_only else [raw[i::channels] for i in ((2, 1, 0) if channels >= 3 else (0, 0, 0))]
            flat = bytearray(len(planes) * len(planes[0]))
            for i, plane in enumerate(planes):
                flat[i :: len(planes)] = plane
            out.append(bytes(flat))
        return pd.Series(out)

    return F.pandas_udf(reorder, "binary")(F.col(f"{column}.data"), F.col(f"{column}.nChannels"))


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """image_id, width, height, rgb; null sizes and bytes where a file can't be decoded."""
    df = spark.read.format("image").option("dropInvalid", False).load(path)
    fine = F.col("image.width") > 0
    size = [F.when(fine, F.col(f"image.{c}")).alias(c) for c in ("width", "height")]
    return df.select(image_identity(F.col("image.origin")).alias("image_id"), *size, F.when(fine, _channels(df, "image", False)).alias("rgb"))


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """image_id, mask_width, mask_height, mask; of ``X_segm`` and ``X`` the former is taken."""
    df = spark.read.format("image").option("dropInvalid", True).load(path)
    name = image_identity(F.col("image.origin"))
    rows = df.select(
        F.regexp_replace(name, "_segm$", "").alias("image_id"), name.endswith("_segm").alias("suffixed"), F.col("image.width").alias("mask_width"),
        F.col("image.height").alias("mask_height"), _channels(df, "image", True).alias("mask"),
    )
    best = F.max_by(F.struct("mask_width", "mask_height", "mask"), "suffixed")
    return rows.groupBy("image_id").agg(best.alias("m")).select("image_id", "m.*")


def with_masks(photos: DataFrame, masks: DataFrame) -> DataFrame:
    """Photos with their mask, null where there is none or its size differs."""
    same = (F.col("mask_width") == F.col("width")) & (F.col("mask_height") == F.col("height"))
    return photos.join(masks, "image_id", "left").withColumn("mask", F.when(same, F.col("mask"))).drop("mask_width", "mask_height")


def mask_counts(masks: DataFrame) -> DataFrame:
    """(image_id, class_id, n) of mask pixels, counted inside each image."""

    def count(batches):
        for batch in batches:
            for image_id, mask in zip(batch["image_id"], batch["mask"]):
                n = np.bincount(np.frombuffer(mask, np.uint8))
                seen = np.flatnonzero(n)
                yield pd.DataFrame({"image_id": image_id, "class_id": seen, "n": n[seen]})

    return masks.select("image_id", "mask").mapInPandas(count, "image_id string, class_id int, n long")

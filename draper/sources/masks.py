"""Parsing masks read strictly: the class numbers that a PNG stores, whatever colours stand for them.

A palette's indexes and grey values are class numbers; of several channels the first counts.
Anything else, or bytes that break off, is a mask without classes and with a reason.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draper.functions.text import stem
from draper.sources.headers import with_sizes

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # of a PNG's colour types


def _paeth(row: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    out = row.astype(np.int64)
    above = up.astype(np.int64)
    for i in range(len(out)):
        a, b, c = (out[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        out[i] = (out[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return out.astype(np.uint8)


def _average(row: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    out = row.astype(np.int64)
    for i in range(len(out)):
        out[i] = (out[i] + ((out[i - step] if i >= step else 0) + int(up[i])) // 2) & 255
    return out.astype(np.uint8)


def class_numbers(content: bytes) -> np.ndarray:
    """height x width class numbers of a PNG; ValueError says what is wrong with it."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, head = 8, [], None
    while at + 12 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise ValueError(f"depth {depth}, colour type {colour}, interlace {interlaced} hold no class numbers")
    step = CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as x:
        raise ValueError(f"pixels can't be unpacked: {x}") from x
    if len(raw) != height * (width * step + 1):
        raise ValueError("too few or too many pixels")
    rows = raw.reshape(height, width * step + 1)
    out = np.zeros((height, width * step), np.uint8)
    up = np.zeros(width * step, np.uint8)
    for y in range(height):
        how, row = rows[y, 0], rows[y, 1:]
        if how == 0:
            up = row
        elif how == 1:
            up = np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)
        elif how == 2:
            up = row + up
        elif how == 3:
            up = _average(row, up, step)
        elif how == 4:
            up = _paeth(row, up, step)
        else:
            raise ValueError(f"row filter {how} is unknown")
        out[y] = up
    return out.reshape(height, width, step)[:, :, 0]


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for image_id, content in zip(batch["image_id"], batch["content"]):
            try:
                found = class_numbers(content)
                rows.append((image_id, found.shape[1], found.shape[0], found.tobytes(), None))
            except ValueError as x:
                rows.append((image_id, None, None, None, str(x)))
        yield pd.DataFrame(rows, columns=["image_id", "mask_width", "mask_height", "mask", "unread"]).astype({"mask_width": "Int32", "mask_height": "Int32"})


def mask_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path, width, height, reason) of each mask of a folder; of ``X_segm`` and ``X`` the former is the mask of X."""
    files = with_sizes(spark.read.format("binaryFile").load(path)).withColumn("name", stem(F.col("path")))
    named = files.select(F.regexp_replace("name", "_segm$", "").alias("image_id"), F.col("name").endswith("_segm").alias("own"), "path", "width", "height", "reason")
    return named.groupBy("image_id").agg(F.max_by(F.struct("path", "width", "height", "reason"), F.struct("own", "path")).alias("m")).select("image_id", "m.*")


def read_label_masks(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, mask_width, mask_height, mask, unread) of the masks that have a size; ``unread`` says why one has no class numbers."""
    whole = mask_sizes(spark, path).where("reason is null").select("image_id", "path")
    contents = spark.read.format("binaryFile").load(path).select("path", "content").join(whole, "path")
    return contents.select("image_id", "content").mapInPandas(_unpacked, "image_id string, mask_width int, mask_height int, mask binary, unread string")

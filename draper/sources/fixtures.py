"""Photographs and masks made from a table of shapes, for tests and trials.

A specification is a row for each image: width, height, a background and shapes in the order in which
they are painted, rectangles with a mask class and a colour. Images are exploded into bands
of rows, which are painted as strings of bytes by DataFrame functions; an image's bands meet
again only to be packed as a PNG. Shapes outside of the image are cut; a null or empty list of shapes leaves the background.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = "struct<x0:int,y0:int,x1:int,y1:int,class_id:int,r:int,g:int,b:int>"
SPEC = f"image_id string, width int, height int, r int, g int, b int, shapes array<{SHAPE}>"
BAND = 64


def _byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))


def _times(pixel: Column, n: Column) -> Column:
    """A binary repeated; hex digits carry it, as repeat takes strings."""
    return F.unhex(F.repeat(F.hex(pixel), n))


def _row(y: Column, start: Column, size: int, pixel) -> Column:
    """One row of bytes, a filter byte first: the background with the shapes that cross it laid over."""
    width = F.col("width")
    left, right = (lambda s: F.greatest(s["x0"], F.lit(0))), (lambda s: F.least(s["x1"], width))
    on = lambda s: (y >= s["y0"]) & (y < s["y1"]) & (left(s) < right(s))
    over = lambda row, s: F.overlay(row, _times(pixel(s), right(s) - left(s)), left(s) * size + 1)
    painted = F.aggregate(F.coalesce("shapes", F.array().cast(f"array<{SHAPE}>")), _times(start, width), lambda row, s: F.when(on(s), over(row, s)).otherwise(row))
    return F.concat(F.unhex(F.lit("00")), painted)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _packed(colour: int):
    """Rows of an image in order -> PNG bytes."""
    def pack(width: pd.Series, height: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([
            b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(b"".join(r))) + _chunk(b"IEND", b"")
            for w, h, r in zip(width, height, rows)
        ])

    return F.pandas_udf(pack, "binary")


def render(spec: DataFrame) -> DataFrame:
    """(image_id, photo, segm): PNG bytes of each image of a specification (SPEC), RGB and grey class numbers."""
    bands = spec.withColumn("band", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / BAND).cast("int"))))
    lines = F.sequence(F.col("band") * BAND, F.least(F.col("band") * BAND + BAND, F.col("height")) - 1)
    rgb = lambda s: F.concat(*[_byte(s[c]) for c in "rgb"])
    background = F.concat(*[_byte(F.col(c)) for c in "rgb"])
    painted = {
        "photo": F.transform(lines, lambda y: _row(y, background, 3, rgb)),
        "segm": F.transform(lines, lambda y: _row(y, F.unhex(F.lit("00")), 1, lambda s: _byte(s["class_id"]))),
    }
    made = bands.select("image_id", "width", "height", F.struct("band", *[c.alias(n) for n, c in painted.items()]).alias("band"))
    whole = made.groupBy("image_id", "width", "height").agg(F.array_sort(F.collect_list("band")).alias("bands"))
    rows = {n: F.flatten(F.transform("bands", lambda x: x[n])) for n in painted}
    return whole.select("image_id", _packed(2)("width", "height", rows["photo"]).alias("photo"), _packed(0)("width", "height", rows["segm"]).alias("segm"))


def write_files(images: DataFrame, photos: str, masks: str) -> None:
    """The images as files of two folders that every executor has mounted, each by its task."""
    def put(rows) -> None:
        import os

        for r in rows:
            for folder, name, body in ((photos, r["image_id"], r["photo"]), (masks, f"{r['image_id']}_segm", r["segm"])):
                os.makedirs(folder, exist_ok=True)
                part = f"{folder}/.{name}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(body)
                os.replace(part, f"{folder}/{name}.png")

    images.foreachPartition(put)

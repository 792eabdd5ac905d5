"""Sizes of PNG and JPEG files from their bytes, in DataFrame operations; no pixel is decoded.

A file is walked as the chain of its parts: chunks of a PNG to its IEND, each with the right
CRC-32; segments of a JPEG to its frame header. A file that breaks off, has a wrong checksum or is
something else gets null sizes and a reason, so it is a row and not an error. The first
``FEW`` parts are walked at once, longer chains by as many steps as the file has room for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draper.functions.text import stem

FEW = 64
#: Fixed values of the two formats.
PNG_START, JPEG_START = "89504E470D0A1A0A", "FFD8"
FRAMES = [f"C{n:X}" for n in range(16) if n not in (4, 8, 12)]
BARE = ["01", *(f"D{n}" for n in range(8))]
WALKING, FOUND, BAD = 0, 1, 2


def _number(content: Column, at: Column, size: int) -> Column:
    """Big-endian, null behind the end."""
    part = F.substring(content, at.cast("int"), F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def _state(at: Column, state: Column, width: Column, height: Column, reason: Column) -> Column:
    return F.struct(
        at.cast("long").alias("at"), state.cast("int").alias("state"), width.cast("long").alias("width"), height.cast("long").alias("height"),
        reason.cast("string").alias("reason"),
    )


def _png_step(content: Column, s: Column) -> Column:
    at, n = s["at"], _number(content, s["at"], 4)
    kind = F.decode(F.substring(content, (at + 4).cast("int"), F.lit(4)), "ISO-8859-1")
    body = F.substring(content, (at + 4).cast("int"), (n + 4).cast("int"))
    crc, first = _number(content, at + 8 + n, 4), at == 9
    bad = F.when(n.isNull() | (n > F.octet_length(content)) | crc.isNull(), "breaks off").when(F.crc32(body) != crc, "wrong checksum").when(
        (kind == "IHDR") != first, "header out of place").when(first & (n != 13), "header of a wrong size")
    width = F.when(first, _number(content, at + 8, 4)).otherwise(s["width"])
    height = F.when(first, _number(content, at + 12, 4)).otherwise(s["height"])
    state = F.when(bad.isNotNull(), BAD).when(kind == "IEND", FOUND).otherwise(WALKING)
    return _state(at + 12 + n, state, width, height, bad)


def _jpeg_step(content: Column, s: Column) -> Column:
    at = s["at"]
    lead, mark = (F.hex(F.substring(content, (at + i).cast("int"), F.lit(1))) for i in (0, 1))
    n = _number(content, at + 2, 2)
    frame = mark.isin(*FRAMES)
    height, width = _number(content, at + 5, 2), _number(content, at + 7, 2)
    bad = (
        F.when((lead == "") | (mark == ""), "breaks off").when(lead != "FF", "no marker").when(mark.isin("FF", *BARE), None)
        .when(mark.isin("D9", "DA"), "no frame header").when(n.isNull() | frame & width.isNull(), "breaks off").when(n < 2, "segment of a wrong size")
    )
    on = F.when(mark == "FF", 1).when(mark.isin(*BARE), 2).otherwise(n + 2)
    state = F.when(bad.isNotNull(), BAD).when(frame, FOUND).otherwise(WALKING)
    return _state(at + on, state, F.when(frame, width), F.when(frame, height), bad)


def with_sizes(files: DataFrame, content: str = "content") -> DataFrame:
    """files with width, height and reason (null if the sizes stand); a null content has no bytes."""
    data, none = F.coalesce(F.col(content), F.lit(b"")), F.lit(None)
    png, jpeg = F.hex(F.substring(data, 1, 8)) == PNG_START, F.hex(F.substring(data, 1, 2)) == JPEG_START
    begin = F.when(png, _state(F.lit(9), F.lit(WALKING), none, none, none)).when(jpeg, _state(F.lit(3), F.lit(WALKING), none, none, none)).otherwise(
        _state(F.lit(1), F.lit(BAD), none, none, F.when(F.octet_length(data) == 0, "empty").otherwise("neither PNG nor JPEG")))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["state"] != WALKING, s).when(png, _png_step(data, s)).otherwise(_jpeg_step(data, s))

    # a part has two bytes at least, so this many steps reach the end of any file
    room = F.floor(F.octet_length(data) / 2) + 1
    few = files.withColumn("_walk", F.aggregate(F.sequence(F.lit(1), F.lit(FEW)), begin, step))
    walked = few.withColumn("_walk", F.when(F.col("_walk.state") == WALKING, F.aggregate(F.sequence(F.lit(1).cast("long"), room), F.col("_walk"), step)).otherwise(F.col("_walk")))
    w = F.col("_walk")
    fine = (w["state"] == FOUND) & (w["width"] > 0) & (w["height"] > 0)
    reason = F.when(fine, None).when(w["state"] == FOUND, "no pixels").when(w["state"] == WALKING, "breaks off").otherwise(w["reason"])
    return walked.withColumns({
        "width": F.when(fine, w["width"]).cast("int"), "height": F.when(fine, w["height"]).cast("int"), "reason": reason,
    }).drop("_walk")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """image_id, path, length, width, height, reason of every file of a folder; broken files have a reason and no size."""
    files = spark.read.format("binaryFile").load(path)
    return with_sizes(files).select(stem(F.col("path")).alias("image_id"), "path", "length", "width", "height", "reason")

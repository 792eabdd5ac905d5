"""Digests of files and folders that a plain script can compute again: Merkle trees of SHA-256.

A leaf is ``sha256(00 || bytes)`` of a block of ``BLOCK`` bytes; a node is ``sha256(01 || left || right)``; an odd last
node goes up as it is; no bytes are one empty block. A folder's leaves are
``sha256(00 || path || 00 || root)`` of its files, path relative to it in UTF-8 and root as its 32 bytes. They are ordered by
the SHA-256 of their paths and grouped by its first three hex digits; each group is a tree, and
the groups' roots, in order, are the leaves of the folder's tree. So no order over all files has to be numbered: a
group holds one 4096th of them, and a task one file's blocks. Spark's own files (a leading _ or .) and empty files do not count.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, PREFIX = 1 << 20, 3
#: Levels of the highest tree in a row: 2 ** 31 nodes do not fit an array.
LEVELS = 31


def _sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def _byte(n: int) -> Column:
    return F.unhex(F.lit(f"{n:02x}"))


def tree_root(leaves: Column) -> Column:
    """The root over an array of digests, which has one at least."""
    def up(level: Column, _: Column) -> Column:
        places = F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1)
        pair = lambda i: F.coalesce(_sha(F.concat(_byte(1), F.get(level, i * 2), F.get(level, i * 2 + 1))), F.get(level, i * 2))
        return F.when(F.size(level) > 1, F.transform(places, pair)).otherwise(level)

    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), leaves, up), F.lit(0))


def content_root(content: Column, block: int = BLOCK) -> Column:
    """The digest of a binary column, block by block; a null has none."""
    last = F.greatest(F.ceil(F.octet_length(content) / block).cast("int") - 1, F.lit(0))
    leaf = lambda i: _sha(F.concat(_byte(0), F.substring(content, i * block + 1, F.lit(block))))
    return F.when(content.isNotNull(), tree_root(F.transform(F.sequence(F.lit(0), last), leaf)))


def file_digests(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """(path relative to the folder, length, sha256 in hex) of each file below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    at = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    root = "/" + folder.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    named = files.select(F.substring_index(at, root, -1).alias("path"), "length", F.lower(F.hex(content_root(F.col("content"), block))).alias("sha256"))
    return named.where(~F.split_part("path", F.lit("/"), F.lit(-1)).rlike(r"^[_.]"))


def folder_digest(files: DataFrame) -> DataFrame:
    """(n_files, n_bytes, sha256): one row over (path, length, sha256)."""
    name = F.sha2(F.col("path").cast("binary"), 256)
    leaf = _sha(F.concat(_byte(0), F.col("path").cast("binary"), _byte(0), F.unhex("sha256")))
    leaves = files.select(F.left(name, F.lit(PREFIX)).alias("group"), F.struct(name.alias("name"), leaf.alias("leaf")).alias("leaf"), "length")
    inside = lambda c, field: tree_root(F.transform(F.array_sort(F.collect_list(c)), lambda x: x[field]))
    groups = leaves.groupBy("group").agg(inside("leaf", "leaf").alias("root"), F.count("*").alias("n"), F.sum("length").alias("size"))
    whole = groups.agg(F.sum("n").alias("n_files"), F.sum("size").alias("n_bytes"), inside(F.struct("group", "root"), "root").alias("root"))
    return whole.select("n_files", "n_bytes", F.lower(F.hex("root")).alias("sha256"))


def plain_root(leaves: list[bytes]) -> bytes:
    """tree_root on the driver, for few leaves."""
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\1" + b"".join(leaves[i : i + 2])).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]

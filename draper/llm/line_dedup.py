"""Line dedup by pairwise alignment with patience diff.

What links documents is a run of neighbouring lines that reaches ``LEAST`` characters: the
shortest one that begins at a line and the shortest one that ends at it. A long line is
such a run alone; short lines link together. Each line of a block that two documents have
in common is in such a run inside the block, so runs find every block of ``LEAST``
characters. A run links each of its documents to the first (smallest id) that has it, so
it costs one pair for each document however frequent it is. Rare runs (at most ``RARE``
occurrences) link whole documents; of a frequent run only its own lines are sent, and a document is aligned
with the frequent runs of earlier documents laid end to end, so nobody's text is copied to
all that share a line of boilerplate with it.

Each pair is aligned on line hashes by patience diff: equal heads and tails, then
lines that are unique in both sides, by a longest increasing run, and between those again.
Blocks of aligned lines with ``LEAST`` characters or more in all are deleted from the later
document. The alignment reports the lines that the other side has and that it could not order (they repeat on a
side, or stand in another order); runs that hold such a line, or one of a shorter block, are looked
up among the other side's runs. So a line goes if and only if it is in
a block of ``LEAST`` characters or more that an earlier document has, wherever it is there,
and each time it occurs. ``n_aligned`` counts the deleted lines that the alignment decided.

Defined cases: null text has no lines and stays null; characters are counted without
spaces around a line, so blank lines count none but may be inside a block; rows that share
an id are not earlier than each other; a null id is later than all; an empty table gives an
empty result; other columns are kept as they are by ``dedup_lines_of``.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draper.llm.common import Scratch, free_name, settings

LEAST = 20
RARE = 1000
LAST = 2**63 - 1
BASE = 0x9E3779B97F4A7C15 & ~7 | 3


def patience(a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Aligned (place in a, place in b), both increasing; and the places in a that b has somewhere but that could not be ordered."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict[int, int] = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        other: dict[int, int] = {}
        for j in range(b0, b1):
            if b[j] in once:
                other[b[j]] = -1 if b[j] in other else j
        both = sorted((i, other[h]) for h, i in once.items() if i >= 0 and other.get(h, -1) >= 0)
        if not both:
            continue
        tails: list[int] = []  # ends of increasing runs, by length
        at: list[int] = []
        link: list[int] = []
        for k, (_, j) in enumerate(both):
            n = bisect_left(tails, j)
            link.append(at[n - 1] if n else -1)
            tails[n : n + 1] = [j]
            at[n : n + 1] = [k]
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(both[k])
            k = link[k]
        chain.reverse()
        i0, j0 = a0, b0
        for i, j in chain:
            found.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    aligned, there = {i for i, _ in found}, set(b)
    return sorted(found), [i for i, h in enumerate(a) if h in there and i not in aligned]


def common_blocks(a: list[int], sizes: list[int], b: list[int], least: int = LEAST) -> tuple[list[int], list[int]]:
    """Places in a of aligned runs (neighbours on both sides) of at least ``least`` characters; and those left to be looked up."""
    pairs, left = patience(a, b)
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*pairs, (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            (out if sum(sizes[x] for x in run) >= least else left).extend(run)
            run = []
        run.append(i)
        last = (i, j)
    return out, left


def minimal_runs(h: np.ndarray, n: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, line behind the last, hash) of the shortest runs of ``least`` characters that begin or end at a line.

    Lines lie flat, those of document k from offsets[k] to offsets[k + 1]; runs are in the order of documents.
    """
    sizes = np.diff(offsets)
    total = np.r_[0, np.cumsum(n, dtype=np.int64)]
    line = np.arange(len(h))
    ahead = np.searchsorted(total, total[:-1] + least, "left")
    back = np.searchsorted(total, total[1:] - least, "right") - 1
    forward = ahead <= np.repeat(offsets[1:], sizes)
    backward = back >= np.repeat(offsets[:-1], sizes)
    backward[backward] = ahead[back[backward]] != line[backward] + 1  # the same run from its other end
    start, stop = np.r_[line[forward], back[backward]], np.r_[ahead[forward], line[backward] + 1]
    order = np.argsort(start, kind="stable")
    start, stop = start[order], stop[order]
    # prefix sums of h * BASE ** place, modulo 2 ** 64
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(h), BASE, np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(len(h), pow(BASE, -1, 1 << 64), np.uint64)])
    prefix = np.r_[np.uint64(0), np.cumsum(h.astype(np.int64).view(np.uint64) * power[:-1], dtype=np.uint64)]
    value = (prefix[stop] - prefix[start]) * down[start]
    return start, stop, (value ^ (value >> np.uint64(29))) * np.uint64(BASE) + (stop - start).astype(np.uint64)


def known_runs(a: tuple, b: tuple, left: np.ndarray, least: int = LEAST) -> np.ndarray:
    """True at the lines of a that are in a minimal run that b of the same pair has and that holds a line of ``left``.

    a and b are (h, n, offsets) of all pairs.
    """
    found = []
    for h, n, offsets in (a, b):
        start, stop, run = minimal_runs(h, n, offsets, least)
        found.append((start, stop, run, np.searchsorted(offsets, start, "right") - 1))
    (start, stop, run, pair), (_, _, other, its) = found
    names, code = np.unique(np.r_[run, other], return_inverse=True)
    code = code.astype(np.int64) + np.r_[pair, its] * len(names)
    before = np.r_[0, np.cumsum(left)]
    known = np.isin(code[: len(run)], code[len(run) :]) & (before[stop] > before[start])
    edge = np.bincount(start[known], minlength=len(a[0]) + 1) - np.bincount(stop[known], minlength=len(a[0]) + 1)
    return np.cumsum(edge)[:-1] > 0


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list array."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _keyed(df: DataFrame, id_col: str, text_col: str, names: tuple[str, str] = ("_id", "_key")) -> DataFrame:
    return df.withColumns({names[0]: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), names[1]: F.xxhash64(F.col(text_col))})


def line_deletions(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """(_id, _key, gone, aligned): the line numbers to delete from each document that loses any, and those of them that alignment decided."""
    only = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    listed = F.split("text", "\n", -1)
    lines = _keyed(only, "id", "text").where("text is not null").select(
        "_id", "_key", F.transform(listed, lambda x: F.xxhash64(x)).alias("h"), F.transform(listed, lambda x: F.length(F.trim(x))).alias("n")
    )
    lines = scratch.table(lines, "lines")

    def runs(batches):
        for b in batches:
            h, offsets = _flat(b.column(2))
            start, stop, run = minimal_runs(h, _flat(b.column(3))[0], offsets, least)
            doc = np.searchsorted(offsets, start, "right") - 1
            place = [pa.array((x - offsets[doc]).astype(np.int32)) for x in (start, stop)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array(run.view(np.int64)), *place], ["_id", "_key", "run", "start", "stop"]
            )

    placed = lines.mapInArrow(runs, "_id long, _key long, run long, start int, stop int")
    each = placed.drop("start", "stop")
    first = each.groupBy("run").agg(F.min("_id").alias("oid"), F.min_by("_key", "_id").alias("okey"), F.max("_id").alias("last"), F.count("*").alias("n")).where("oid < last")
    first = scratch.table(first.select("run", "oid", "okey", (F.col("n") > RARE).alias("frequent")), "first")
    pairs = each.join(first.where("not frequent"), "run").where("oid < _id").select("_id", "_key", "oid", "okey").distinct()
    pairs = scratch.table(pairs, "pairs")
    # distinct by all columns leaves the join an exchange of its own, so a hot owner's pairs can be split
    earlier = lines.select(F.col("_id").alias("oid"), F.col("_key").alias("okey"), F.col("h").alias("oh"), F.col("n").alias("on")).distinct()
    # the owner's lines come once to each pair; rows that repeat id and text are one
    later = lines.dropDuplicates(["_id", "_key"])
    joined = pairs.join(earlier, ["oid", "okey"]).join(later, ["_id", "_key"]).select("_id", "_key", "h", "n", "oh", "on")
    # a frequent run's own lines, once, from its owner; there are at most as many frequent runs as rows / RARE
    owned = placed.join(first.where("frequent"), "run").where("_id = oid and _key = okey").dropDuplicates(["run"]).select("run", "oid", "okey", "start", "stop")
    cut = lambda c: F.slice(c, F.col("start") + 1, F.col("stop") - F.col("start"))
    excerpts = owned.join(earlier, ["oid", "okey"]).select("run", "oid", F.struct("oid", "okey", "start", cut("oh").alias("h"), cut("on").alias("n")).alias("part"))
    excerpts = scratch.table(excerpts, "excerpts")
    # lines end to end, with a line that no document has between runs
    known = each.join(excerpts, "run").where("oid < _id").groupBy("_id", "_key").agg(F.array_sort(F.collect_set("part")).alias("p"))
    wall = F.array(F.xxhash64(F.lit("\n")))
    laid = known.select("_id", "_key", F.flatten(F.transform("p", lambda x: F.concat(x["h"], wall))).alias("oh"), F.flatten(F.transform("p", lambda x: F.concat(x["n"], F.array(F.lit(0))))).alias("on"))
    with_frequent = laid.join(later, ["_id", "_key"]).select("_id", "_key", "h", "n", "oh", "on")

    def align(batches):
        for b in batches:
            (h, ends), (oh, other_ends) = _flat(b.column(2)), _flat(b.column(4))
            left, ordered = np.zeros(len(h), bool), []
            for k, (a, sizes, o) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4)))):
                blocks, rest = common_blocks(a, sizes, o, least)
                left[ends[k] + np.array(rest, np.int64)] = True
                ordered.append(blocks)
            known = known_runs((h, _flat(b.column(3))[0], ends), (oh, _flat(b.column(5))[0], other_ends), left, least)
            gone = [sorted({*blocks, *np.flatnonzero(known[ends[k] : ends[k + 1]]).tolist()}) for k, blocks in enumerate(ordered)]
            keep = [k for k, places in enumerate(gone) if places]
            at, places = pa.array(keep, pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array([gone[k] for k in keep], places), pa.array([ordered[k] for k in keep], places)], ["_id", "_key", "gone", "aligned"]
            )

    found = joined.unionByName(with_frequent).mapInArrow(align, "_id long, _key long, gone array<int>, aligned array<int>")
    merged = found.groupBy("_id", "_key").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("gone", "aligned")))
    out = scratch.table(merged, "gone")
    for name in ("lines", "first", "pairs", "excerpts"):
        scratch.drop(name)
    return out


def dedup_lines_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """df with shortened texts, plus n_lines, n_removed and n_aligned (with underscores behind if df has such columns)."""
    spark = df.sparkSession
    own = [free_name(df, c) for c in ("_id", "_key", "_gone", "_aligned")]
    with settings(spark):
        gone = line_deletions(df, Scratch(spark, "line-dedup"), id_col, text_col, least).toDF(*own)
    listed = F.split(F.col(text_col), "\n", -1)
    joined = _keyed(df, id_col, text_col, (own[0], own[1])).join(gone.hint("shuffle_hash"), own[:2], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(listed) - 1), F.col(own[2]))
    text = F.when(F.col(own[2]).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(listed, i)), "\n"))
    others = [F.col(f"`{c}`") if c != text_col else text.alias(text_col) for c in df.columns]
    return joined.select(
        *others, F.when(F.col(text_col).isNull(), 0).otherwise(F.size(listed)).cast("long").alias(free_name(df, "n_lines")),
        F.coalesce(F.size(own[2]), F.lit(0)).cast("long").alias(free_name(df, "n_removed")),
        F.coalesce(F.size(own[3]), F.lit(0)).cast("long").alias(free_name(df, "n_aligned")),
    )


def op3_line_dedup(spark, sf_dir):
    out = dedup_lines_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_aligned", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))

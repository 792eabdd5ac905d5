"""Repeated windows of symbol sequences, found exactly: the core of the two substring operators.

A *window* is ``lengths[-1]`` consecutive symbols of one text. Every window holds an
*anchor*: its smallest-hashed gram of ``lengths[0]`` symbols. Equal windows have the same
anchor at the same place, so

1. only anchors (about 2 in w + 1 positions) become rows, each with its name (rank) at
   the first length;
2. ranks are doubled: rows whose rank is unique are dropped, the others are ranked by a
   sort of the pairs of their rank and the name at the next offset, up to the window's
   length. What still repeats there covers a whole window;
3. windows that reach over the edge of a covered run are compared themselves; which
   anchors and offsets can have such windows follows from the runs alone, and the same
   windows of all other texts are asked for by the anchor's name.

Texts are classes of equal texts, named by a hash that is checked for collisions and
stored once in a bucketed table in the shared folder (a bucket for each ``BUCKET_BYTES``
of text at least), so that the later passes bring rows to the texts and never deal out
texts again. Repeats are judged by an aggregate and a join, which adaptive execution can
split where one gram is in a large part of all texts. Edge windows are settled inside
each task first: what repeats there is known to repeat, and of each name one row goes on
as a witness, so a name that is in a large part of all texts meets once for each task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draper.llm.common import Scratch, utf8

CHUNK = 1 << 18
BUCKET_BYTES = 256 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(32)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    x = a * _A
    x += b
    x ^= x >> _S
    x *= _B
    x ^= x >> _S
    return x


def rank_at(symbols: np.ndarray, length: int) -> np.ndarray:
    """Names of all grams of ``length`` by doubling; shorter by length - 1 than symbols."""
    now, have = mix(symbols, symbols), 1
    while have < length:
        step = min(have, length - have)
        now = mix(now[: len(now) - step], now[step:]) if len(now) > step else now[:0]
        have += step
    return now


def longer(rank: np.ndarray, have: int, length: int) -> np.ndarray:
    step = length - have
    return mix(rank[: len(rank) - step], rank[step:]) if len(rank) > step else rank[:0]


def sliding(f: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """f over every run of ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have < width:
        step = min(have, width - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


def window_minima(gram: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """For every position the smallest gram name of the window that starts there; 0: no window."""
    width = lengths[-1] - lengths[0] + 1
    low = sliding(np.minimum, gram, width)
    at = np.arange(len(low))
    return np.where(at + lengths[-1] <= ends[: len(low)], low, np.uint64(0))


def anchors(gram: np.ndarray, low: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """Positions whose gram is the smallest of some window."""
    width = lengths[-1] - lengths[0] + 1
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(sliding(np.maximum, padded, width)[: len(gram)] == gram) if len(low) else np.zeros(0, np.int64)


def settle(name: np.ndarray, ids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(known to repeat, witness of its name) for windows of one chunk.

    Without ids a window is known where its name occurs again, and the first of a name is
    its witness. With ids it is known where its name has a smaller id, and all windows of
    the smallest id are witnesses.
    """
    if not len(name):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(name, kind="stable") if ids is None else np.lexsort((ids, name))
    head = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
    count = np.diff(np.r_[head, len(name)])
    known, witness = np.zeros(len(name), bool), np.zeros(len(name), bool)
    if ids is None:
        known[order] = np.repeat(count > 1, count)
        witness[order[head]] = True
    else:
        known[order] = ids[order] > np.repeat(ids[order[head]], count)
        witness = ~known
    return known, witness


def gathered(name: np.ndarray, text: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of the rows ``at`` one for each (name, text), and the places of the others of that name and text as lists."""
    order = at[np.lexsort((place[at], text[at], name[at]))]
    new = np.ones(len(order), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (text[order][1:] != text[order][:-1])
    head = np.flatnonzero(new)
    offsets = np.r_[0, np.cumsum(np.diff(np.r_[head, len(order)]) - 1)]
    return order[head], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place[order[~new]], pa.int32()))


def thinned(text: np.ndarray, place: np.ndarray, known: np.ndarray, size: int) -> np.ndarray:
    """Known windows that cover what all known ones do: the first and last of each half window of a text; rows in order of text and place."""
    at = np.flatnonzero(known)
    out = np.zeros(len(text), bool)
    if len(at):
        part = place[at] // max(1, size // 2)
        edge = (text[at][1:] != text[at][:-1]) | (part[1:] != part[:-1])
        out[at[np.r_[True, edge] | np.r_[edge, True]]] = True
    return out


def chunks(sizes: np.ndarray, most: int = CHUNK):
    """Runs of texts of about ``most`` symbols together (a longer text is alone)."""
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


Tokenize = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _laid_out(column, tokenize: Tokenize):
    """(first text, symbols as uint64, offsets) of every chunk of a batch."""
    data, offsets = utf8(column)
    for i, j in chunks(np.diff(offsets)):
        symbols, places = tokenize(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, symbols, places


class Repeats:
    """One search: classes of texts, and which of their windows repeat.

    lengths: gram lengths from the anchors' to the window's, each at most twice the one
    before. smaller: a window counts only if it also starts in a text of a smaller id
    (else: if it starts anywhere else).
    """

    def __init__(self, df: DataFrame, tokenize: Tokenize, lengths: tuple[int, ...], smaller: bool, id_col: str, text_col: str):
        self.spark, self.tokenize, self.lengths, self.smaller = df.sparkSession, tokenize, lengths, smaller
        self.scratch = Scratch(self.spark, "repeats")
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        self.name = f"draper_texts_{uuid.uuid4().hex}"
        self.width = lengths[-1] - lengths[0] + 1

    def store_texts(self) -> None:
        """Classes (cid, text, id: smallest doc_id, n: rows) in a bucketed table, and (doc_id, cid) rows."""
        total = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
        for seed in range(8):
            cid = F.xxhash64(F.sha2(F.col("text").cast("binary"), 256), F.lit(seed))
            classes = self.docs.withColumn("cid", cid).groupBy("cid").agg(
                F.first("text").alias("text"), F.min("doc_id").alias("id"), F.count("*").alias("n"),
                F.min(F.xxhash64("text")).alias("h0"), F.max(F.xxhash64("text")).alias("h1"),
            )
            store = classes.write.format("parquet").option("compression", "zstd").option("path", f"{self.scratch.root}/texts{seed}")
            store.bucketBy(buckets, "cid").mode("overwrite").saveAsTable(self.name)
            if self.spark.table(self.name).where("h0 <> h1").isEmpty():
                break
        else:
            raise ValueError("different texts share a 64-bit name under each of eight seeds; there are too many texts for such names")
        self.texts = self.spark.table(self.name).select("cid", "text", "id", "n")
        self.rows = self.scratch.table(self.docs.select("doc_id", cid.alias("cid")), "rows")

    def __enter__(self) -> Repeats:
        self.store_texts()
        return self

    def __exit__(self, *error) -> None:
        """The catalog forgets the texts, also after a failure."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _anchor_rows(self) -> DataFrame:
        lengths, tokenize = self.lengths, self.tokenize
        names = [f"r{n}" for n in range(len(lengths) - 1)]

        def run(batches):
            for b in batches:
                for first, symbols, places in _laid_out(b.column(1), tokenize):
                    gram = rank_at(symbols, lengths[0])
                    if not len(gram):
                        continue
                    ends = np.repeat(places[1:], np.diff(places))
                    at = anchors(gram, window_minima(gram, ends, lengths), lengths)
                    text = np.searchsorted(places, at, "right") - 1
                    whole = at + lengths[-1] <= ends[at]
                    # the partner that doubles a rank: the rank of the same length at the next offset
                    ranks, partners = gram, []
                    for have, want in zip(lengths, lengths[1:]):
                        partners.append(ranks[np.minimum(at + want - have, len(ranks) - 1)] if len(ranks) else at.astype(np.uint64))
                        ranks = longer(ranks, have, want)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram[at].view(np.int64)), *[pa.array(x.view(np.int64), mask=~whole) for x in partners],
                         b.column(0).take(pa.array(first + text)), b.column(2).take(pa.array(first + text)), pa.array(at - places[text], pa.int32())],
                        ["g", *names, "cid", "id", "pos"],
                    )

        schema = "g long, " + "".join(f"{n} long, " for n in names) + "cid long, id long, pos int"
        found = self.texts.select("cid", "text", "id").mapInArrow(run, schema)
        return found if self.smaller else found.drop("id")

    def _repeated(self, rows: DataFrame, keys: list[str], ranked: bool = False) -> DataFrame:
        """The rows whose keys repeat (with the smallest id as ``least`` where ids matter).

        ranked: with ``rank``, the place of their keys among all that repeat, by a sort of those.
        """
        if self.smaller:
            again = rows.groupBy(*keys).agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
        else:
            again = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        if ranked:
            again = again.orderBy(*keys).withColumn("next", F.monotonically_increasing_id())
        again = self.scratch.table(again, f"again-{uuid.uuid4().hex}")
        found = rows.drop("least").join(again, keys)
        return found.withColumn("rank", F.col("next")).drop("next") if ranked else found

    def _covered(self, found: DataFrame) -> DataFrame:
        """Ranks doubled up to the window: (cid, pos) of anchors whose whole window repeats."""
        now = found.where("r0 is not null").drop("g")
        last = len(self.lengths) - 2
        for n in range(last + 1):
            now = self._repeated(now, ["rank", f"r{n}"], ranked=n < last)
            if n < last:
                now = self.scratch.table(now.drop(f"r{n}"), f"doubled{n}")
        if self.smaller:
            now = now.where("id > least")
        return now.select("cid", "pos")

    def _asked(self, found: DataFrame, covered: DataFrame) -> DataFrame:
        """(cid, asks): anchors with the offsets below lo and above hi at which windows must be compared."""
        size, width = self.lengths[-1], self.width
        run = Window.partitionBy("cid").orderBy("pos")
        flagged = found.join(covered.withColumn("covered", F.lit(True)), ["cid", "pos"], "left")
        end = F.when(F.col("covered"), F.col("pos") + size)
        flagged = flagged.withColumn("ahead", F.max(end).over(run.rowsBetween(Window.unboundedPreceding, -1)))
        opens = F.col("covered") & (F.col("ahead").isNull() | (F.col("pos") > F.col("ahead")))
        flagged = flagged.withColumn("island", F.sum(F.when(opens, 1).otherwise(0)).over(run.rowsBetween(Window.unboundedPreceding, 0)))
        island = Window.partitionBy("cid", "island")
        flagged = flagged.withColumn("cs", F.min(F.when(F.col("covered"), F.col("pos"))).over(island)).withColumn("ce", F.max(end).over(island))
        inside = F.coalesce(F.col("pos") < F.col("ce"), F.lit(False))
        flagged = flagged.withColumn("lo", F.when(inside, F.col("pos") + size - F.col("ce")).otherwise(width)).withColumn(
            "hi", F.when(inside, F.col("pos") - F.col("cs")).otherwise(-1)
        )
        open_ = (F.col("lo") > 0) | (F.col("hi") < F.least(F.lit(width - 1), F.col("pos")))
        if self.smaller:
            open_ &= F.col("id") > F.col("least")
        wanted = self.scratch.table(flagged.where(open_).groupBy("g").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")), "wanted")
        return found.select("g", "cid", "pos").join(wanted, "g").groupBy("cid").agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("asks"))

    def _edge_windows(self, asked: DataFrame) -> DataFrame:
        """(name, cid, start) of every asked window."""
        lengths, tokenize, width = self.lengths, self.tokenize, self.width

        def run(batches):
            for b in batches:
                asks = b.column(3)
                count = np.diff(asks.offsets.to_numpy())
                flat = asks.flatten()
                pos, lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                bound = np.r_[0, np.cumsum(count)]
                for first, symbols, places in _laid_out(b.column(1), tokenize):
                    gram = rank_at(symbols, lengths[0])
                    if not len(gram):
                        continue
                    low = window_minima(gram, np.repeat(places[1:], np.diff(places)), lengths)
                    n = len(places) - 1
                    part = slice(bound[first], bound[first + n])
                    text = np.repeat(np.arange(n), count[first : first + n])
                    at = pos[part] + places[text]
                    d = np.arange(width)
                    want = ((d < lo[part][:, None]) | (d > hi[part][:, None])) & (d <= pos[part][:, None])
                    row, off = np.nonzero(want)
                    start = at[row] - off
                    ok = start < len(low)
                    row, start = row[ok], start[ok]
                    ok = low[start] == gram[at[row]]
                    start, which = np.unique(start[ok], return_index=True)
                    text = text[row[ok][which]]
                    ranks = gram
                    for have, size in zip(lengths, lengths[1:]):
                        ranks = longer(ranks, have, size)
                    name, place = ranks[start], start - places[text]
                    row_id = b.column(2).take(pa.array(first + text))
                    known, witness = settle(name, row_id.to_numpy(zero_copy_only=False).astype(np.int64) if smaller else None)
                    apart = known & ~witness
                    kept = ~apart | thinned(text, place, known, lengths[-1])
                    # a known window that isn't the name's witness is a name of its own
                    name = np.where(apart, mix(start.astype(np.uint64), b.column(0).take(pa.array(first + text)).to_numpy().view(np.uint64)), name)
                    at, more = np.flatnonzero(kept), None
                    if smaller:
                        at, more = gathered(name, text, place, at)
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name.view(np.int64)).take(at), pa.array(apart).take(at), pa.array(known).take(at),
                         b.column(0).take(pa.array(first + text)).take(at), row_id.take(at), pa.array(place, pa.int32()).take(at), *([more] if smaller else [])],
                        ["name", "apart", "known", "cid", "id", "pos", *(["more"] if smaller else [])],
                    )

        smaller = self.smaller
        joined = self.texts.join(asked, "cid").select("cid", "text", "id", "asks")
        found = joined.mapInArrow(run, "name long, apart boolean, known boolean, cid long, id long, pos int" + (", more array<int>" if smaller else ""))
        if self.smaller:
            # counted with map-side partials and joined back, so that a name in most texts is no single task
            found = self.scratch.table(found, "windows")
            again = found.groupBy("name", "apart").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
            kept = found.join(again, ["name", "apart"], "left").where("known or id > least")
            return kept.select("cid", F.explode(F.concat(F.array("pos"), "more")).alias("pos"))
        # bytes have about 50 windows for one of words; written and joined back they would pass the check tool's disk (README)
        same = Window.partitionBy("name", "apart")
        return found.drop("id").withColumn("n", F.count("*").over(same)).where("known or n > 1").select("cid", "pos")

    def starts(self) -> DataFrame:
        """(cid, starts): where windows that repeat start, enough of them to cover every repeated symbol."""
        anchor_rows = self.scratch.table(self._anchor_rows(), "anchors")
        found = self.scratch.table(self._repeated(anchor_rows, ["g"], ranked=True), "found")
        self.scratch.drop("anchors")
        covered = self.scratch.table(self._covered(found), "covered")
        asked = self.scratch.table(self._asked(found, covered), "asked")
        self.scratch.drop("found")
        edges = self.scratch.table(self._edge_windows(asked), "edges")
        for name in ("asked", "windows", "wanted"):
            self.scratch.drop(name)
        return covered.unionByName(edges).groupBy("cid").agg(F.sort_array(F.collect_list("pos")).alias("starts"))


def cover(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n symbols lie in a window of ``size`` that starts at one of ``starts``."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:-1]) > 0

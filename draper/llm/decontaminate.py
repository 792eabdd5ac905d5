"""Benchmark decontamination by SimHash windows of the items' sizes.

A document is a run of word-shingle hashes. For every size that benchmark items have,
windows of that size slide over it (in steps of 2 shingles, 4 for longer items; shorter
windows at the end), and each gets a SimHash from prefix sums of the bits. Windows are
looked up in a multi-index: 64 bits are four blocks, and a fingerprint within ``RADIUS``
of an item's is within ``RADIUS // 4`` of it in one of the first ``RADIUS % 4 + 1`` blocks
or within one less in another (else all blocks together would differ in more), so tables
of block values find all of them; the full distance decides. Candidates are then verified exactly: the
weighted Jaccard similarity of shingles (weights: occurrences) between the item and the
best stretch of the window's surroundings has to reach ``SIMILARITY``. Surroundings are as
wide as a copy of that similarity with words inserted can be.

What could not pass verification is never given a fingerprint: a similarity of ``SIMILARITY``
takes that share of an item's shingles, so windows slide only over stretches around
shingles that the benchmark has, with enough of them, and only the items that have that
share of their shingles in the chunk of stretches are looked up. This loses nothing (the
bound is the verification's own), and the work follows the shared text, not items x corpus.

The benchmark is read in slices of at most ``SLICE_BYTES`` of text. Each slice is
broadcast and has one pass over the documents, which is written before the next begins.

Defined cases: null and empty texts and items match nothing; items of fewer words than a
shingle are compared as one shingle of their own length; of repeated items each matches;
null ids are kept; an empty benchmark gives no match; other columns pass through; a very
long text is read in pieces of ``PIECE`` characters, of which only the words' hashes stay.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draper.llm.common import Scratch, arrow_strings, free_name, settings
from draper.llm.repeats import mix
from draper.llm.substring_dedup import WordNames

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 18
SLICE_BYTES = 16 << 20
CHUNK = 1 << 17
PIECE = 1 << 20
TABLES = 64
WORDS = re.compile(r"\w+")
HITS = "array<struct<item_id:bigint,similarity:double,start_word:int,n_words:int>>"


def shingles(names: np.ndarray, n: int) -> np.ndarray:
    out = mix(names[: len(names) - n + 1], names[: len(names) - n + 1])
    for i in range(1, n):
        out = mix(out, names[i : len(names) - n + 1 + i])
    return out


def simhash(bits: np.ndarray, count) -> np.ndarray:
    """Fingerprints from sums of bits (rows of 64) and numbers of shingles."""
    return np.packbits(bits > count // 2, axis=1).view(np.uint64)[:, 0]


def pieces(text: str):
    """The words of a text, a list for each ``PIECE`` characters or so."""
    start = 0
    while start < len(text):
        stop = start + PIECE
        while stop < len(text) and WORDS.match(text[stop]) and WORDS.match(text[stop - 1]):
            stop += 1
        yield WORDS.findall(text[start:stop].lower())
        start = stop


def words_between(text: str, a: int, b: int) -> list[str]:
    """Words a to b - 1 of a text."""
    found: list[str] = []
    for words in pieces(text):
        found += words[max(0, a) : max(0, b)]
        a, b = a - len(words), b - len(words)
        if b <= 0:
            break
    return found


class ItemIndex:
    """Items of one slice: their shingles, and by window size their fingerprints with block tables of at most 64 items each."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS):
        self.names = names = WordNames()
        self.radius = radius
        self.items, by_size, self.short = [], {}, {}
        self.codes: dict[str, int] = {}  # the benchmark's words; all others are 0
        for item_id, text in items:
            words = [w for piece in pieces(text or "") for w in piece]
            if not words:
                continue
            w = np.array([names[x] for x in words], np.uint64)
            for x in words:
                self.codes.setdefault(x, len(self.codes) + 1)
            n = min(SHINGLE, len(w))
            s = shingles(w, n)
            if n < SHINGLE:
                self.short.setdefault(n, {}).setdefault(int(s[0]), []).append(item_id)
                continue
            step = 1 if len(s) < 8 else 2 if len(s) < 24 else 4
            by_size.setdefault((step, max(1, round(len(s) / step))), []).append(len(self.items))
            self.items.append((item_id, s, Counter(s.tolist()), np.unique(s)))
        self.short = {n: (np.array(sorted(known), np.uint64), known) for n, known in self.short.items()}
        self.groups = []
        for (step, blocks), at in sorted(by_size.items()):
            for i in range(0, len(at), 64):
                part = at[i : i + 64]
                self.groups.append((step, blocks, part, np.array([self._print(self.items[k][1]) for k in part])))
        self.code_names = np.array([0, *(names[w] for w in self.codes)], np.uint64)
        self.built: dict[int, np.ndarray] = {}
        # every shingle with the items that have it, and how often
        sizes = [len(x[3]) for x in self.items]
        shingle = np.concatenate([np.zeros(0, np.uint64), *(x[3] for x in self.items)])
        weight = np.array([x[2][v] for x in self.items for v in x[3].tolist()], np.float64)
        order = np.argsort(shingle, kind="stable")
        self.known, first = np.unique(shingle[order], return_index=True)
        self.owner, self.weight = np.repeat(np.arange(len(sizes)), sizes)[order], weight[order]
        self.first = np.r_[first, len(order)]
        self.need = np.array([SIMILARITY * len(x[1]) - 1e-9 for x in self.items])
        self.least = self.need.min() if len(self.need) else np.inf
        self.reach = int(2 * max((len(x[1]) for x in self.items), default=0)) + 8
        bits = max(16, int(16 * len(self.known)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[self.known & self.mask] = True

    @staticmethod
    def _print(s: np.ndarray):
        return simhash(np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1).sum(0, keepdims=True, dtype=np.int64), len(s))[0]

    def tables(self, n: int) -> np.ndarray:
        """Block tables of group n: for each value of each block the items (bits) it is near to; ``TABLES`` groups stay built."""
        if n not in self.built:
            if len(self.built) >= TABLES:
                self.built.pop(next(iter(self.built)))
            own = self.groups[n][3].view(np.uint16).reshape(-1, 4)
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(own) <= np.iinfo(k).bits)
            values, tables = np.arange(65536, dtype=np.uint16), np.zeros((4, 65536), kind)
            for j, blocks in enumerate(own):
                for k in range(4):
                    tables[k][np.bitwise_count(values ^ blocks[k]) <= self.radius // 4 - (k > self.radius % 4)] |= kind(1 << j)
            self.built[n] = tables
        return self.built[n]

    def near(self, n: int, prints: np.ndarray, present: np.ndarray):
        """(places, item) of fingerprints within the radius of a present item's of group n."""
        part, own, tables = *self.groups[n][2:], self.tables(n)
        blocks = prints.view(np.uint16).reshape(-1, 4)
        hit = tables[0][blocks[:, 0]]
        for k in (1, 2, 3):
            hit |= tables[k][blocks[:, k]]
        for j, item in enumerate(part):
            if present[item]:
                at = np.flatnonzero((hit & tables.dtype.type(1 << j)) != 0)
                at = at[np.bitwise_count(prints[at] ^ own[j]) <= self.radius]
                if len(at):
                    yield at, item

    def stretches(self, s: np.ndarray):
        """(first, last + 1) of the runs of shingles around known ones that have enough of them for the smallest item."""
        maybe = np.flatnonzero(self.sieve[s & self.mask])
        if len(maybe) < self.least:
            return
        at = np.minimum(np.searchsorted(self.known, s[maybe]), len(self.known) - 1)
        hits = maybe[self.known[at] == s[maybe]]
        if len(hits) < self.least:
            return
        cut = np.flatnonzero(np.diff(hits) > 2 * self.reach) + 1
        for run in np.split(hits, cut):
            if len(run) >= self.least:
                begin, end = max(0, (int(run[0]) - self.reach) // 4 * 4), min(len(s), int(run[-1]) + self.reach)
                for a in range(begin, end, CHUNK):  # neighbours share what a window and its surroundings can need
                    yield max(begin, (a - 2 * self.reach) // 4 * 4), min(end, a + CHUNK)

    def search(self, texts: list[str]) -> list[dict[int, tuple[float, int, int]]]:
        """For each text: item id -> (similarity, first word, words) of its best stretch."""
        found: list[dict] = [{} for _ in texts]
        chunk, total, code = [], 0, self.codes.get
        for i, text in enumerate(texts):
            read, words = [], None
            for words in pieces(text):
                read.append(np.fromiter(map(code, words, repeat(0)), np.int32, len(words)))
            if not read:
                continue
            w = self.code_names[read[0] if len(read) == 1 else np.concatenate(read)]
            for n, (values, known) in self.short.items():
                if len(w) >= n:
                    s = shingles(w, n)
                    for place in np.flatnonzero(np.isin(s, values)).tolist():
                        for item_id in known[int(s[place])]:
                            found[i].setdefault(item_id, (1.0, place, n))
            if len(w) < SHINGLE or not self.items:
                continue
            for a, b in self.stretches(shingles(w, SHINGLE)):
                own = words[a : b + SHINGLE - 1] if len(read) == 1 else words_between(text, a, b + SHINGLE - 1)
                chunk.append((i, shingles(np.array([self.names[x] for x in own], np.uint64), SHINGLE), a))
                total += b - a
                if total >= CHUNK:
                    self._search(chunk, found)
                    chunk, total = [], 0
        if chunk:
            self._search(chunk, found)
        return found

    def _present(self, s: np.ndarray) -> np.ndarray:
        """For each item whether its share of shingles is among ``s``."""
        s = np.unique(s)
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        at = at[self.known[at] == s]
        count = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.bincount(self.owner[place], self.weight[place], len(self.items)) >= self.need

    def _search(self, chunk, found) -> None:
        sizes = np.array([len(s) for _, s, _ in chunk])
        padded = -(-sizes // 4) * 4
        begin = np.r_[0, np.cumsum(padded)]
        total = int(begin[-1])
        all_s, real = np.zeros(total, np.uint64), np.zeros(total, np.uint8)
        for (_, s, _), b in zip(chunk, begin.tolist()):
            all_s[b : b + len(s)] = s
            real[b : b + len(s)] = 1
        present = self._present(all_s)
        groups = [n for n, g in enumerate(self.groups) if present[g[2]].any()]
        bits = np.unpackbits(all_s.view(np.uint8).reshape(-1, 8), axis=1) if groups else None
        sums = {}
        for step in {self.groups[n][0] for n in groups}:
            ones = bits  # padding has no bits
            for _ in range(step.bit_length() - 1):
                ones = ones[0::2] + ones[1::2]
            sums[step] = (
                np.concatenate([np.zeros((1, 64), np.uint16), np.cumsum(ones, 0, dtype=np.uint16)]),
                np.r_[0, np.cumsum(real.reshape(-1, step).sum(1, dtype=np.int64))],
                np.repeat(begin[1:] // step, padded // step),
            )
        prints, last = None, None
        for n_group in groups:
            step, blocks = self.groups[n_group][:2]
            if (step, blocks) != last:
                last = (step, blocks)
                ones, count, ends = sums[step]
                start = np.arange(len(ends))
                stop = np.minimum(start + blocks, ends)
                n = count[stop] - count[start]
                window = np.zeros((len(ends), 64), np.uint16)
                if len(ends) > blocks:
                    np.subtract(ones[blocks:], ones[:-blocks], out=window[: len(ones) - blocks])
                short = np.flatnonzero(start + blocks > ends)
                window[short] = ones[ends[short]] - ones[short]
                prints = simhash(window, n[:, None].astype(np.uint16))
                start = start[n >= 0.75 * blocks * step]
                stop, prints = stop[start], prints[start]
            for at, item in self.near(n_group, prints, present):
                around = max(2 * step, int(np.ceil(len(self.items[item][1]) * (1 / SIMILARITY - 1))))
                few = max(1, (1 << 20) // (blocks * step + 2 * around))
                for k in range(0, len(at), few):
                    part = at[k : k + few]
                    self._verify(start[part] * step, stop[part] * step, item, around, all_s, real, begin, chunk, found)

    @staticmethod
    def _best(places: np.ndarray, names: np.ndarray, weights: Counter, size: int) -> tuple[float, int, int]:
        """(similarity, first place, place behind the last) of the best stretch between two of an item's shingles."""
        seen: dict[int, list[int]] = {}
        spent = np.full(len(places), -1)  # a shingle counts in stretches that begin behind its weight-th last occurrence
        for t, name in enumerate(names.tolist()):
            at = seen.setdefault(name, [])
            if len(at) >= weights[name]:
                spent[t] = at[-weights[name]]
            at.append(t)
        best = (0.0, 0, 0)
        for i in range(len(places)):
            both = np.cumsum(spent[i:] < i)
            similarity = both / (size + places[i:] - places[i] + 1 - both)
            j = int(similarity.argmax())
            if similarity[j] > best[0]:
                best = (float(similarity[j]), int(places[i]), int(places[i + j]) + 1)
            if len(places) - i - 1 < SIMILARITY * size - 1e-9:
                break
        return best

    def _verify(self, start, stop, item, around, all_s, real, begin, chunk, found) -> None:
        item_id, s, weights, known = self.items[item]
        doc = np.searchsorted(begin, start, "right") - 1
        low, high = np.maximum(start - around, begin[doc]), np.minimum(stop + around, begin[doc + 1])
        span = low[:, None] + np.arange(int((high - low).max()))
        inside = span < high[:, None]
        span = np.minimum(span, len(all_s) - 1)
        at = np.minimum(np.searchsorted(known, all_s[span]), len(known) - 1)
        hit = (known[at] == all_s[span]) & inside & (real[span] > 0)
        done: dict[tuple[int, int], tuple[float, int, int]] = {}  # windows beside each other often have the same shingles
        for k in np.flatnonzero(hit.sum(1) >= SIMILARITY * len(s) - 1e-9).tolist():
            places = span[k, hit[k]]
            ends = int(places[0]), int(places[-1])
            if ends in done:
                continue
            similarity, a, b = done[ends] = self._best(places, all_s[places], weights, len(s))
            if similarity >= SIMILARITY - 1e-9:
                i, first = chunk[doc[k]][0], a - int(begin[doc[k]]) + chunk[doc[k]][2]
                new = (similarity, first, b - a + SHINGLE - 1)
                old = found[i].get(item_id)
                if old is None or (-new[0], new[1]) < (-old[0], old[1]):
                    found[i][item_id] = new


def benchmark_slices(benchmark: DataFrame, item_col: str, text_col: str, most: int = SLICE_BYTES):
    """Lists of (item id, text), each of at most about ``most`` bytes."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // most) or 1
    for k in range(count):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        yield sorted(((r["item_id"], r["text"]) for r in got), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def with_hits(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
              hits: str = "hits") -> DataFrame:
    """df plus ``hits`` (underscores behind if df has one), the benchmark items found in each row's text.

    With more slices than one, each slice's pass is written to the shared folder before the next, so one broadcast is in use at a time.
    """
    spark = df.sparkSession
    hits = free_name(df, hits)
    slot = free_name(df, hits + "_new")
    at = df.columns.index(text_col)
    columns, scratch, before = df.columns, Scratch(spark, "decontaminate"), None
    schema = T.StructType([*df.schema.fields, T.StructField(slot, T._parse_datatype_string(HITS))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int32()), ("n_words", pa.int32())]))
    for n, items in enumerate(benchmark_slices(benchmark, item_col, item_text)):
        if n:
            written = scratch.table(df, f"slice{n}")
            if before is not None:
                shared.unpersist()
                scratch.drop(before)
            df, before = written, f"slice{n}"
        shared = spark.sparkContext.broadcast({"items": items})
        own = df.schema

        def run(batches, shared=shared, names=[*df.columns, slot]):
            held = shared.value  # a worker builds the slice's index once
            if "index" not in held:
                held["index"] = ItemIndex(held["items"])
            index = held["index"]
            for b in batches:
                rows = [
                    [{"item_id": k, "similarity": v[0], "start_word": v[1], "n_words": v[2]} for k, v in sorted(d.items(), key=lambda x: (x[0] is None, x[0] or 0))]
                    for d in index.search(arrow_strings(b.column(at)))
                ]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names)

        df = df.mapInArrow(run, T.StructType([*own.fields, schema[-1]]))
        df = df.select(*(f"`{c}`" for c in columns), (F.concat(hits, slot) if n else F.col(slot)).alias(hits))
    return df


def op4_decontaminate(spark, sf_dir):
    """One row for each benchmark item found in a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with settings(spark):
        found = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "hits").where(F.size("hits") > 0)
        return Scratch(spark, "hits").table(found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*"), "hits")

"""SimHash near-duplicates with a Gray-order hierarchical index.

Distinct fingerprints are dealt out by ``clean`` of ``radius + clean`` bit blocks: two
fingerprints within the radius agree in at least that many blocks, so they meet. In a
bucket they lie in Gray order, where neighbours share most bits; groups of ``FAN``
become nodes that keep the bits all their members share (mask and pattern), and so on
up to a root. Pairs of nodes are followed from the roots down; a pair of groups whose
shared bits already differ in more than the radius is pruned whole, as the difference
can only grow below. A bucket over ``BUCKET`` fingerprints is cut into chunks by hash
and each pair of chunks is its own bucket. What a task found leaves it as a spanning
forest, never as all pairs; components are contracted on the cluster.

``similar_groups`` is for links by similarity, which a fingerprint within 4 bits would miss:
blocks of 64 bits cannot tell fingerprints 18 bits apart from any others, so texts are
dealt out by ``KEYS`` shingles of least hash instead (two texts of similarity s share one
with a chance of 1 - (1 - s) ** KEYS, 0.992 at 0.8), the same index prunes each bucket, and
what it leaves is verified by the exact similarity of the shingle sets, nearest
fingerprints first, until a bucket's verified links are a spanning forest.

Defined cases: null and blank texts have fingerprint zero and link like any other;
shorter texts than a shingle hash as one sequence; null ids take part, and a component's
id is its smallest non-null one; repeated rows get equal results; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draper.llm.common import Scratch, settings, utf8
from draper.llm.components import components
from draper.llm.repeats import mix
from draper.llm.substring_dedup import WordNames

FAN = 8
BUCKET = 2048
SLICE = 2_000_000
#: For groups by similarity: words of a shingle, least similarity, bits that such fingerprints may differ in, keys for dealing them out.
SHINGLE, SIMILARITY, WIDE, KEYS = 5, 0.8, 18, 3
#: Candidate pairs of one group from which they are verified together.
MANY = 1000


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> bytes:
    """Eight bytes: a bit is set where over half the shingles' XXH64 have it."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for i in range(0, len(rows), 4096):
        total += np.unpackbits(rows[i : i + 4096], axis=1).sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(rows)).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's 64 bits as a long."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            raw = data.tobytes()
            prints = b"".join([fingerprint(raw[s:e], shingle, seed) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a bit string in Gray order (the inverse of x ^ (x >> 1)), unsigned order kept as signed."""
    for n in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, n))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def block_keys(fp: Column, radius: int, clean: int) -> Column:
    """Array of (which blocks, their bits) for every choice of ``clean`` blocks."""
    blocks = radius + clean
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), clean)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(n).alias("which"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def _parents(group, pattern, mask):
    """The next level up: (group, pattern, mask, first child, children) of runs of FAN nodes of one group."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    local = np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))
    first = np.flatnonzero(local % FAN == 0)
    low, high = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
    shared = np.bitwise_and.reduceat(mask, first) & ~(low ^ high)
    return group[first], low & shared, shared, first, np.diff(np.r_[first, len(group)])


def index_links(group: np.ndarray, fps: np.ndarray, radius: int):
    """Pairs of places (i < j) in one group within the radius; rows sorted by group and Gray rank."""
    levels = [(group, fps, np.full(len(fps), ~np.uint64(0)), None, None)]
    while True:
        g, pattern, mask = levels[-1][:3]
        if len(np.unique(g)) == len(g):
            break
        up = _parents(g, pattern, mask)
        levels.append(up)
    found = []

    def descend(level: int, a: np.ndarray, b: np.ndarray) -> None:
        if level == 0:
            keep = a != b
            found.append((a[keep], b[keep]))
            return
        first, count = levels[level][3], levels[level][4]
        _, pattern, mask = levels[level - 1][:3]
        cb = count[b]
        many = count[a] * cb
        total = np.cumsum(many)
        if len(a) > 1 and total[-1] > SLICE:
            cut = int(np.searchsorted(total, total[-1] // 2)) or 1
            cut = min(cut, len(a) - 1)
            descend(level, a[:cut], b[:cut])
            descend(level, a[cut:], b[cut:])
            return
        pair = np.repeat(np.arange(len(a)), many)
        k = np.arange(total[-1] if len(total) else 0) - np.repeat(total - many, many)
        i, j = first[a][pair] + k // cb[pair], first[b][pair] + k % cb[pair]
        ahead = i <= j
        i, j = i[ahead], j[ahead]
        near = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= radius
        i, j = i[near], j[near]
        if len(i):
            descend(level - 1, i, j)

    top = np.arange(len(levels[-1][0]))
    descend(len(levels) - 1, top, top)
    return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.zeros(0, int),) * 2


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every linked place to the smallest place of its component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def fingerprint_links(prints: DataFrame, scratch: Scratch, radius: int = 4, clean: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints: a spanning forest of all links within the radius."""
    spark = prints.sparkSession
    prints = scratch.table(prints.select("fp").distinct(), "distinct")
    if clean is None:  # more blocks as fingerprints grow keep buckets small; every choice finds the same links
        n = prints.count()
        clean = next(c for c in (1, 2, 3, 4) if n <= bucket << (64 * c // (radius + c)) or c == 4)
    dealt = prints.select("fp", F.explode(block_keys(F.col("fp"), radius, clean)).alias("k")).select("fp", "k.*")
    sizes = dealt.groupBy("which", "bits").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    sizes = scratch.table(sizes.select("which", "bits", F.ceil(F.col("n") / bucket).cast("int").alias("chunks")), "large")
    placed = dealt.join(sizes, ["which", "bits"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    placed = placed.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    placed = placed.select(
        "which", "bits", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "fp", gray_rank(F.col("fp")).alias("gray")
    )
    keys = ["which", "bits", "c1", "c2"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = placed.repartition(parts, *keys).sortWithinPartitions(*keys, "gray").select(F.xxhash64(*keys).alias("key"), "fp")

    def links(batches):
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def solve(key, fps):
            start = np.r_[True, key[1:] != key[:-1]]
            group = np.cumsum(start)
            a, b = forest(len(fps), *index_links(group, fps, radius))
            return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], ["a", "b"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1]) if len(key) else 0
            if cut:
                yield solve(key[:cut], fps[:cut])
            held_key, held = key[cut:], fps[cut:]
        if len(held):
            yield solve(held_key, held)

    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="20000"):
        return scratch.table(placed.mapInArrow(links, "a long, b long").distinct(), "links")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4,
                   seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "simhash")
    with settings(spark):
        prints = scratch.table(fingerprints(df, id_col, text_col, shingle, seed), "prints")
        labels = scratch.table(components(fingerprint_links(prints, scratch, radius), scratch), "labels")
        # everything below works on one row per distinct fingerprint; documents join once, at the end
        least = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
        named = least.join(labels, least["fp"] == labels["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
        named = scratch.table(named, "named")
        ids = named.groupBy("component").agg(F.min("low").alias("component_id"))
        by_print = scratch.table(named.join(ids, "component").select("fp", "component_id"), "by_print")
        return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketches(df: DataFrame, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(cls, fp, keys, shingles) of every row: the text's hash, fingerprint, least hashes, and sorted 32-bit shingle hashes as bytes."""

    def run(batches):
        names = WordNames()
        for b in batches:
            data, offsets = utf8(b.column(1))
            raw, fps, keys, sets = data.tobytes(), [], [], []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                words = raw[s:e].lower().split()
                n = min(shingle, len(words))
                if not n:
                    fps.append(bytes(8))
                    keys.append([0] * KEYS)
                    sets.append(b"")
                    continue
                w = np.array([names[x] for x in words], np.uint64)
                h = mix(w[: len(w) - n + 1], w[: len(w) - n + 1])
                for i in range(1, n):
                    h = mix(h, w[i : len(w) - n + 1 + i])
                total = np.zeros(64, np.int64)
                for i in range(0, len(h), 4096):
                    total += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                fps.append(np.packbits(total * 2 > len(h)).tobytes())
                keys.append([int(mix(h, np.uint64(k + 1)).min().view(np.int64)) for k in range(KEYS)])
                sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes())
            fp = pa.array(np.frombuffer(b"".join(fps), ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), fp, pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["cls", "fp", "keys", "shingles"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.xxhash64(text).alias("cls"), text.alias("text")).mapInArrow(run, "cls long, fp long, keys array<long>, shingles binary")


def similarity_of(a: bytes, b: bytes, least: float = SIMILARITY) -> float:
    """Jaccard similarity of two sets of sorted 32-bit hashes (0 where their sizes alone keep it below ``least``); of two empty ones 1."""
    if len(a) == len(b) == 0:
        return 1.0
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return 0.0  # too unequal in size to reach it
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def similarities(sets: list[bytes], a: np.ndarray, b: np.ndarray, slice_words: int = 1 << 21) -> np.ndarray:
    """Jaccard similarities of many pairs at once: shingles that several sets have become bits, and bits are counted."""
    used, place = np.unique(np.r_[a, b], return_inverse=True)
    pa_, pb = place[: len(a)], place[len(a) :]
    size = np.array([len(sets[i]) // 4 for i in used.tolist()], np.int64)
    values = np.frombuffer(b"".join([sets[i] for i in used.tolist()]), np.uint32)
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    words = max(1, -(-int(shared.sum()) // 64))
    bit = (np.cumsum(shared) - 1)[code]
    kept = shared[code]
    rows = np.zeros((len(used), words), np.uint64)
    owner = np.repeat(np.arange(len(used)), size)[kept]
    np.bitwise_or.at(rows.ravel(), owner * words + (bit[kept] >> 6), np.uint64(1) << (bit[kept] & 63).astype(np.uint64))
    both = np.zeros(len(a), np.int64)
    step = max(1, slice_words // words)
    for i in range(0, len(a), step):
        part = slice(i, i + step)
        both[part] = np.bitwise_count(rows[pa_[part]] & rows[pb[part]]).sum(1, dtype=np.int64)
    union = size[pa_] + size[pb] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def bucket_links(number: np.ndarray, fps: np.ndarray, sets: list[bytes], least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links of each group: pairs of a group with many of them are verified together, others one by one."""
    a, b = index_links(number, fps, WIDE)
    many = np.bincount(number[a], minlength=int(number[-1]) + 1 if len(number) else 1) > MANY
    large = many[number[a]]
    left, right = [], []
    for g in np.flatnonzero(many).tolist():
        own = number[a] == g
        x, y = a[own], b[own]
        good = similarities(sets, x, y) >= least - 1e-9
        left.append(x[good])
        right.append(y[good])
    x, y = verified_forest(fps, sets, a[~large], b[~large], least)
    left.append(np.array(x, int))
    right.append(np.array(y, int))
    return forest(len(fps), np.concatenate(left), np.concatenate(right))


def verified_forest(fps: np.ndarray, sets: list[bytes], a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> tuple[list[int], list[int]]:
    """A spanning forest of the candidate pairs whose similarity is enough, tried nearest first; pairs inside a component aren't tried."""
    order = np.argsort(np.bitwise_count(fps[a] ^ fps[b]), kind="stable")
    a, b = a[order], b[order]
    label = np.arange(len(fps))
    left: list[int] = []
    right: list[int] = []
    while True:
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return left, right
        tried = np.unique(label[a], return_index=True)[1]  # one pair for each component
        good = np.array([i for i in tried.tolist() if similarity_of(sets[a[i]], sets[b[i]], least) >= least - 1e-9], int)
        left += a[good].tolist()
        right += b[good].tolist()
        moved, to = forest(len(fps), label[a[good]], label[b[good]])
        renamed = np.arange(len(fps))
        renamed[moved] = to
        label = renamed[label]
        rest = np.ones(len(a), bool)
        rest[tried] = False
        a, b = a[rest], b[rest]


def similar_groups(df: DataFrame, text_col: str = "text", least: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(cls, component) of every text that is linked to another: hash of the text, and the smallest one it can reach over verified links."""
    spark = df.sparkSession
    scratch = Scratch(spark, "similar")
    with settings(spark):
        drawn = scratch.table(sketches(df, text_col), "sketches")
        dealt = drawn.select("cls", "fp", F.explode("keys").alias("key")).distinct()
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / bucket).cast("int").alias("chunks"))
        met = scratch.table(dealt.join(sizes, "key"), "met")
        sets = drawn.select("cls", "shingles").join(met.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
        own = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks")).cast("int")
        placed = met.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        placed = placed.select("key", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "fp", "cls", gray_rank(F.col("fp")).alias("gray"))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        keys = ["key", "c1", "c2"]
        placed = placed.join(sets, "cls").repartition(parts, *keys).sortWithinPartitions(*keys, "gray").select(F.xxhash64(*keys).alias("group"), "fp", "cls", "shingles")

        def links(batches):
            def solve(rows):
                group, fps, cls, held = rows
                number = np.cumsum(np.r_[True, group[1:] != group[:-1]])
                a, b = bucket_links(number, fps, held, least)
                return pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b])], ["a", "b"])

            kept = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), [])
            for batch in batches:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                rows = (np.r_[kept[0], new[0]], np.r_[kept[1], new[1].view(np.uint64)], np.r_[kept[2], new[2]], kept[3] + batch.column(3).to_pylist())
                cut = int(np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])[-1]) if len(rows[0]) else 0
                if cut:
                    yield solve([x[:cut] for x in rows])
                kept = tuple(x[cut:] for x in rows)
            if len(kept[0]):
                yield solve(kept)

        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1024"):
            found = scratch.table(placed.mapInArrow(links, "a long, b long").distinct(), "links")
        scratch.drop("sketches")
        return scratch.table(components(found, scratch), "labels").select(F.col("node").alias("cls"), "component")


def op9_simhash(spark, sf_dir):
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

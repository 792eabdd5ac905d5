"""Vector code compression: product codebooks whose nearest entries a vantage-point tree finds.

Vectors become integers (components times ``scale``, rounded down) and are cut into equal
parts. Each part position has a codebook of at most ``entries`` entries and a
vantage-point tree over them: a node is an entry, its inner and outer child hold the
entries nearer and farther than the median, with the least and greatest distance of
each. A search takes whole batches of parts down the tree: the distance to a node's entry is a
candidate and, with the children's radii, bounds what a child can hold. Distances are
compared as integers; radii and roots are rounded away from pruning, and a child is
visited where its bound equals the best distance, so that ties reach the lower index.

Each round is one pass over the vectors: tasks add their parts by entry, Spark adds those
sums (parts x entries rows a task), and the driver holds only the codebooks. Vectors are
never shuffled for it. A label's error is summed map-side; labels that may hold more than
1/256 of the rows are at most 256 and are joined by broadcast, all others by shuffle.

Defined cases: a null vector and one with null, NaN or infinite components is dropped, and so
is one with a component whose integer passes 2 ** 27 (32,768 at the usual scale), as squared
distances would pass a long. The vector of the smallest id whose length the number of parts
divides gives the length; vectors of other lengths, empty ones included, are dropped. Repeated ids and
rows each count; the first entries follow id (null last), then the vector. With fewer vectors
than entries the codebook is smaller. A null label is a label. An empty table gives no rows.
Columns of other names are not read.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draper.llm.common import Scratch, settings

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 27


class VantageTree:
    """Exact nearest entries (squared Euclidean distance, ties to the lower index) of integer rows."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        self.root = self._node(list(range(len(self.entries))))
        self.compared = 0

    def _node(self, members: list[int]) -> tuple | None:
        """(entry, squared median, inner child, its radii, outer child, its radii)."""
        if not members:
            return None
        at, rest = members[0], members[1:]
        far = {k: int(((self.entries[k] - self.entries[at]) ** 2).sum()) for k in rest}
        median = sorted(far.values())[(len(rest) - 1) // 2] if rest else 0
        sides = [k for k in rest if far[k] <= median], [k for k in rest if far[k] > median]
        # rounded down and up: a child never lies outside its radii
        radii = [(isqrt(min(far[k] for k in side)), isqrt(max(far[k] for k in side)) + 1) if side else (0, 0) for side in sides]
        return at, median, self._node(sides[0]), radii[0], self._node(sides[1]), radii[1]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.full(len(x), np.iinfo(np.int64).max)
        which = np.zeros(len(x), np.int64)
        self._visit(self.root, x, np.arange(len(x)), best, which)
        return which, best

    def _visit(self, node: tuple | None, x: np.ndarray, rows: np.ndarray, best: np.ndarray, which: np.ndarray) -> None:
        if node is None or not len(rows):
            return
        at, median, inner, inner_radii, outer, outer_radii = node
        d = ((x[rows] - self.entries[at]) ** 2).sum(1)
        self.compared += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (at < which[rows]))
        best[rows[better]], which[rows[better]] = d[better], at
        low, high, near = np.floor(np.sqrt(d)) - 1, np.ceil(np.sqrt(d)) + 1, d <= median
        sides = [(inner, inner_radii, near), (outer, outer_radii, ~near)]
        for turn in (True, False):  # the side a row lies on first, then the other with what was found
            for child, (least, greatest), own in sides:
                bound = np.maximum(low - greatest, least - high)
                go = (own == turn) & (bound <= np.ceil(np.sqrt(best[rows])) + 1)
                self._visit(child, x, rows[go], best, which)


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers and squared distances (rows x parts) of the vectors x."""
    pieces = np.split(x, len(books), axis=1)
    found = [VantageTree(book).nearest(piece) for piece, book in zip(pieces, books)]
    return np.stack([w for w, _ in found], 1), np.stack([d for _, d in found], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v array<int>) of the vectors that are whole, finite and small enough."""
    x = F.col("x")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.floor(c * scale)) <= LARGEST))
    named = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    return named.where(x.isNotNull()).where(fine).select("vec_id", "label", F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def _refine(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry as the mean of its parts, rounded down; an unused entry stays."""
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        books = sent.value
        width, total, count = books[0].shape[1], {}, {}
        for b in batches:
            x = _matrix(b.column(0))
            for p, entry in enumerate(assign(x, books)[0].T):
                for e in np.unique(entry).tolist():
                    own = x[entry == e, p * width : (p + 1) * width]
                    total[p, e] = total.get((p, e), 0) + own.sum(0)
                    count[p, e] = count.get((p, e), 0) + len(own)
        if total:
            keys = sorted(total)
            flat = [[*k, i, int(s), count[k]] for k in keys for i, s in enumerate(total[k])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], ["part", "entry", "place", "total", "n"])

    added = kept.select("v").mapInArrow(sums, "part long, entry long, place long, total long, n long")
    found = added.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out = [book.copy() for book in books]
    for r in found:
        out[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code array<int>, error long) of every kept vector, and the codebooks by part."""
    spark = df.sparkSession
    scratch = Scratch(spark, "vector-codes")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="4096"):
        whole = scratch.table(integer_vectors(df, id_col, vector_col, label_col, scale), "vectors")
        order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
        size = F.size("v")
        first = whole.where((size > 0) & (size % parts == 0)).orderBy(*order).limit(1).select(size.alias("n")).collect()
        if not first:
            return whole.limit(0).select("vec_id", "label", F.col("v").alias("code"), F.lit(0).cast("long").alias("error")), []
        kept = whole.where(size == first[0]["n"])
        start = np.array([r["v"] for r in kept.orderBy(*order).limit(entries).select("v").collect()], np.int64)
        books = np.split(start, parts, axis=1)
        for _ in range(rounds):
            books = _refine(kept, books)
        sent = spark.sparkContext.broadcast(books)

        def code(batches):
            for b in batches:
                entry, error = assign(_matrix(b.column(2)), sent.value)
                flat = pa.ListArray.from_arrays(np.arange(0, entry.size + 1, entry.shape[1], np.int32), pa.array(entry.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat, pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

        schema = whole.select("vec_id", "label", F.col("v").alias("code"), F.lit(0).cast("long").alias("error")).schema
        codes = scratch.table(kept.mapInArrow(code, schema), "codes")
        scratch.drop("vectors")
    return codes, books


def decoded(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """codes with ``vector``, the middle of the cell of integers that each component's entry stands for."""
    table = F.array(*[F.array(*[F.array(*[F.lit((int(x) + 0.5) / scale) for x in entry]) for entry in book]) for book in books])
    return codes.withColumn("vector", F.flatten(F.transform("code", lambda e, p: F.get(F.get(table, p), e))))


def label_errors(codes: DataFrame, heavy: int = 256) -> DataFrame:
    """codes with ``label_error``, the error summed over equal labels."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    sums = Scratch(codes.sparkSession, "label-errors").table(sums, "sums")
    n = codes.count()
    # at most ``heavy`` labels hold more than 1/heavy of the rows each
    hot, rest = sums.where(F.col("n") * heavy > n).drop("n"), sums.where(F.col("n") * heavy <= n).drop("n")

    def with_sums(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
        named = found.withColumnRenamed("label", "_label")
        return rows.join(named, F.col("label").eqNullSafe(F.col("_label")), how).drop("_label")

    marked = with_sums(codes, F.broadcast(hot), "left")
    tail = marked.where("label_error is null").drop("label_error")
    return marked.where("label_error is not null").unionByName(with_sums(tail, rest, "inner"))


def op13_vector_codes(spark, sf_dir):
    import hashlib

    codes, books = compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    said = ",".join(str(int(x)) for book in books for entry in book for x in entry)
    return label_errors(codes).select(
        "vec_id",
        F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "").alias("code"),
        "error", "label_error",
        F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256"),
    )


def _sql() -> str:
    """Rounds as common table expressions over (row, part, place, value), every distance computed."""
    out = [
        "x AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings"
        " WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false))) AND len(embedding) > 0 AND len(embedding) % 8 = 0)",
        "v AS MATERIALIZED (SELECT r, (i - 1) // (len(embedding) // 8) AS p, (i - 1) % (len(embedding) // 8) AS j, floor(4096 * embedding[i]::DOUBLE)::BIGINT AS q"
        " FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM x))",
        "b0 AS MATERIALIZED (SELECT p, (r - 1) AS e, j, q FROM v WHERE r <= 16)",
    ]
    for n in range(ROUNDS + 1):
        out.append(f"d{n} AS (SELECT v.r, v.p, b.e, sum((v.q - b.q) * (v.q - b.q))::BIGINT AS d FROM v JOIN b{n} b ON v.p = b.p AND v.j = b.j GROUP BY ALL)")
        out.append(f"a{n} AS MATERIALIZED (SELECT r, p, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM d{n} GROUP BY ALL)")
        if n < ROUNDS:
            out.append(
                f"b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(floor(m.s / m.n)::BIGINT, b.q) AS q FROM b{n} b LEFT JOIN"
                f" (SELECT a.p, a.e, v.j, sum(v.q)::DOUBLE AS s, count(*) AS n FROM a{n} a JOIN v ON v.r = a.r AND v.p = a.p GROUP BY ALL) m ON m.p = b.p AND m.e = b.e AND m.j = b.j)"
            )
    return "WITH " + ",\n".join(out) + f""",
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT x.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY x.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(q::VARCHAR, ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded c JOIN x USING (r)"""


SQL = _sql()

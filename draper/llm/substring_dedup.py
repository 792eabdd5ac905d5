"""Substring dedup of words by level-wise doubling.

Word grams that repeat in more than one document at 13 words alone are extended to 25, and
those that still do to the window of 50 words (see repeats), until no candidate is left or
the window is reached. A word goes if it lies in a window whose word sequence also starts
in a document with a smaller id.

Defined cases: null text has no words; fewer words than a window stay whole; of equal
texts the smallest id keeps what it has, all others lose every word a window covers;
rows that repeat an id are not smaller than each other; a null id counts as the largest;
windows are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draper.llm.common import settings, utf8
from draper.llm.repeats import Repeats, cover

LENGTHS = (13, 25, 50)
LAST = 2**63 - 1


class WordNames(dict):
    """Word -> XXH64, remembered for the words seen lately."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) > 500_000:
            self.clear()
        name = self[word] = xxhash.xxh64_intdigest(word)
        return name


def words_as_symbols(data: np.ndarray, offsets: np.ndarray):
    names, raw = WordNames(), data.tobytes()
    per = [raw[s:e].split() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    places = np.r_[0, np.cumsum([len(w) for w in per])].astype(np.int64)
    return np.array([names[w] for ws in per for w in ws], np.uint64), places


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, with_kept: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept) for every row."""
    spark, size = df.sparkSession, lengths[-1]
    named = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text_col).alias("text"))
    with settings(spark):
        with Repeats(named, words_as_symbols, lengths, True, "doc_id", "text") as search:
            starts = search.starts()

            def cut(batches):
                for b in batches:
                    data, offsets = utf8(b.column(1))
                    raw, where, out = data.tobytes(), b.column(2).to_pylist(), []
                    for i in range(b.num_rows):
                        words = raw[offsets[i] : offsets[i + 1]].split()
                        n = len(words)
                        kept = words
                        if where[i]:
                            gone = cover(np.array(where[i]), size, n)
                            kept = [w for w, g in zip(words, gone.tolist()) if not g]
                        kept = b" ".join(kept)
                        whole = b"" if n >= size else b" ".join(words)  # what is left of a later copy
                        removed = int(gone.sum()) if where[i] else 0
                        out.append((n, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_kept else None,
                                    n if n >= size else 0, hashlib.sha256(whole).hexdigest(), whole.decode() if with_kept else None))
                    cols = list(zip(*out)) if out else [[]] * 7
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), b.column(3), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                        ["cid", "id", "n_words", "n_removed", "kept_sha256", "kept", "c_removed", "c_sha256", "c_kept"],
                    )

            joined = search.texts.join(starts, "cid", "left").select("cid", "text", "starts", "id")
            schema = "cid long, id long, n_words long, n_removed long, kept_sha256 string, kept string, c_removed long, c_sha256 string, c_kept string"
            results = search.scratch.table(joined.mapInArrow(cut, schema), "results")
    later = F.col("doc_id") > F.col("id")
    out = search.rows.join(results, "cid").select(
        F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "n_words", F.when(later, F.col("c_removed")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, F.col("c_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(later, F.col("c_kept")).otherwise(F.col("kept")).alias("kept"),
    )
    return out if with_kept else out.drop("kept")


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

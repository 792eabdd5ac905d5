"""Suffix-array dedup of bytes by distributed prefix doubling.

Ranks of sampled suffixes (see repeats) start at 64 bytes and are doubled: Spark sorts and
joins the rows on (rank, rank at the next offset), drops the rows whose pair is unique and
names the others anew, at 128 and then at 200 bytes, the threshold. Bytes that lie in a
200-byte string which also starts anywhere else, in the same text or another, are removed.

Defined cases: null text is empty; a text shorter than the threshold keeps all bytes;
equal texts remove each other whole; strings are judged on the input; null ids are kept;
repeated rows are copies; kept bytes may split a character, so ``kept`` is binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draper.llm.common import settings, utf8
from draper.llm.repeats import Repeats, cover

LENGTHS = (64, 128, 200)


def bytes_as_symbols(data: np.ndarray, offsets: np.ndarray):
    return data.astype(np.uint64), offsets


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept) for every row."""
    spark, size = df.sparkSession, lengths[-1]
    with settings(spark):
        with Repeats(df, bytes_as_symbols, lengths, False, id_col, text_col) as search:
            starts = search.starts()

            def cut(batches):
                for b in batches:
                    data, offsets = utf8(b.column(1))
                    where = b.column(3).to_pylist()
                    out = []
                    for i, copies in enumerate(b.column(2).to_pylist()):
                        text = data[offsets[i] : offsets[i + 1]]
                        gone = np.zeros(len(text), bool)
                        if copies > 1 and len(text) >= size:
                            gone[:] = True
                        elif where[i]:
                            gone = cover(np.array(where[i]), size, len(text))
                        kept = text[~gone].tobytes()
                        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
                        out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
                    cols = list(zip(*out)) if out else [[]] * 5
                    kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["cid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                    )

            joined = search.texts.join(starts, "cid", "left").select("cid", "text", "n", "starts")
            schema = "cid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
            results = search.scratch.table(joined.mapInArrow(cut, schema), "results")
    out = search.rows.join(results, "cid").drop("cid")
    return out if with_kept else out.drop("kept")


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draper.llm.common import Scratch, free_name, settings
from draper.llm.decontaminate import with_hits
from draper.llm.language_id import keep_identified
from draper.llm.line_dedup import dedup_lines_of
from draper.llm.simhash import similar_groups
from draper.llm.source_mix import mix_sources

LAST = 2**63 - 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no letters).

    Null and empty texts go; other columns, null ids and repeated rows stay as they are; an empty table stays empty.
    """
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes lines that earlier documents have; a document of which nothing is left goes.

    Null texts stay null; rows that share an id are not earlier than each other, a null id is later than all; a row
    that loses lines gets its new length as n_chars, all other columns are kept.
    """
    lines, removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    out = dedup_lines_of(docs)
    left = (F.col(removed) == 0) | F.col("text").rlike(r"\S")
    shorter = F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", shorter).drop(lines).select(*(f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest (id, hash of id and text).

    Texts link at a similarity of 0.8 or more of their five-word shingles (simhash.similar_groups; README: recall), and
    groups are what links connect. Rows with the same id and text are one document, of which the row with the least hash
    of its other columns stays; rows with one id, or none, and other texts are several. Null and blank texts are one group.
    """
    own, node, nth, cls, group = (free_name(docs, c) for c in ("_id", "_node", "_nth", "_cls", "_group"))
    keyed = docs.withColumn(own, F.coalesce("doc_id", F.lit(LAST))).withColumn(node, F.xxhash64(own, "text"))
    groups = similar_groups(docs).toDF(cls, group)
    members = keyed.select(node, own, F.xxhash64(F.coalesce("text", F.lit(""))).alias(cls)).distinct().join(groups, cls, "left")
    stays = members.groupBy(F.coalesce(group, cls).alias(group)).agg(F.min(F.struct(own, node)).alias("least")).select(f"least.{node}")
    same = Window.partitionBy(node).orderBy(F.xxhash64(*(f"`{c}`" for c in docs.columns if c not in ("doc_id", "text"))))
    kept = keyed.join(stays.hint("shuffle_hash"), node, "left_semi").withColumn(nth, F.row_number().over(same))
    return kept.where(F.col(nth) == 1).select(*(f"`{c}`" for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; ids, other columns and repeated rows stay as they are; an empty benchmark removes nothing.
    """
    hits = free_name(docs, "hits")
    found = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits=hits)
    return found.where(F.size(hits) == 0).select(*(f"`{c}`" for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with its copy number from 1 (``copy``, underscores behind if docs has one).

    Rows that are equal in all columns are one document with all their copies, put together before any shuffle; null
    texts take no words and are emitted like any document without words; null ids and sources count like others.
    """
    key = free_name(docs, "_key")
    columns = [f"`{c}`" for c in docs.columns]
    keyed = docs.withColumn(key, F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b")))
    total = mix_sources(keyed, id_col=key).groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").alias("n")).where("n > 0")
    total = total.withColumnRenamed("n", free_name(docs, "_copies"))
    rows = keyed.dropDuplicates([key]).join(total.hint("shuffle_hash"), key)
    each = F.sequence(F.lit(1).cast("long"), F.col(free_name(docs, "_copies")))
    return rows.select(*columns, F.explode(each).alias(free_name(docs, "copy")))


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("source_mix", mix),
]

#: Several stages (network, alignment, SimHash index) have no SQL; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for n, (name, stage) in enumerate(STAGES):
        with settings(spark):
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if n > 0:
            scratch.drop(STAGES[n - 1][0])
    return docs

"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries sketch (``approx_top_k`` keeps at most ``tracked`` counters per task
and merges them) names every digest that may hold more than 1/``share`` of the rows.
Their winners are counted exactly, verified, and broadcast: at most ``heavy_max``
rows, whatever the input. Rows that lose to a broadcast winner are decided in the
map task that read them. All other digests are rare by the sketch's guarantee, so
they are dealt out by digest and ranked in a window.

Defined cases: null text counts as empty; a null id ranks below every other id;
of rows that repeat both id and text exactly one stays; an empty table gives an
empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draper.llm.common import Scratch, settings


def frequent_digests(rows: DataFrame, column: str, heavy_max: int = 256, tracked: int = 4096) -> DataFrame:
    """At most heavy_max values of ``column`` that may be frequent: (value, estimate).

    approx_top_k is a Misra-Gries summary: every value with more than n / (0.75 *
    tracked) rows is among its counters, and an estimate is never below the truth.
    """
    top = rows.agg(F.expr(f"approx_top_k({column}, {heavy_max}, {tracked})").alias("top"), F.count("*").alias("n"))
    return top.select(F.explode("top").alias("t"), "n").where(F.col("t.count") * heavy_max > F.col("n")).select(
        F.col("t.item").alias(column), F.col("t.count").alias("estimate")
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_max: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of df."""
    spark = df.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    with settings(spark):
        rows = df.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"),
        )
        rows = scratch.table(rows.withColumn("short", F.xxhash64("digest")), "rows")
        heavy = scratch.table(frequent_digests(rows, "short", heavy_max).select("short"), "heavy")
        # verified winners: exact counts by the full digest; map-side partial aggregates
        winners = scratch.table(
            rows.join(F.broadcast(heavy), "short", "left_semi")
            .groupBy("digest")
            .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            .where(F.col("group_size") > 1),
            "winners",
        )
        # Short hashes that collide would only add digests here; the sketch bounds the short ones.
        marked = rows.join(F.broadcast(winners), "digest", "left")
        hex_digest = F.lower(F.hex("digest")).alias("text_sha256")
        wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        is_heavy = F.col("group_size").isNotNull()
        losers = marked.where(is_heavy & ~wins).select(
            "doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), hex_digest
        )
        # the winner's row, perhaps repeated: counted first, then told apart
        winner_rows = (
            marked.where(is_heavy & wins)
            .groupBy("digest", "doc_id", "keep_id", "group_size")
            .agg(F.count("*").alias("copies"))
            .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"))
            .select("doc_id", "keep_id", "group_size", (F.col("nth") == 1).alias("kept"), hex_digest)
        )
        by = Window.partitionBy("digest")
        tail = (
            marked.where(~is_heavy)
            .select("doc_id", "digest")
            .select(
                "doc_id",
                F.max("doc_id").over(by).alias("keep_id"),
                F.count("*").over(by).alias("group_size"),
                (F.row_number().over(by.orderBy(F.col("doc_id").desc_nulls_last())) == 1).alias("kept"),
                hex_digest,
            )
        )
        return losers.unionByName(winner_rows).unionByName(tail)


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""

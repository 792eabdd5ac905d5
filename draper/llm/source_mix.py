"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / size of
its source. Documents are put in order of (source, size, id) by a range partitioning;
the prefix sum of expected copies is the rank inside the source times that number, and
a document is emitted once for each integer boundary that ``offset + prefix sum``
crosses. Ranks come from counts per (range, source), so no source has to fit a task.
Order by size makes the taken words follow the target closely.

Defined cases: null text has size 0; null source is a source of its own, last in
order; null ids come first among equal sizes; repeated rows are separate documents;
an empty table gives an empty mix; a source whose documents are all empty takes 0.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draper.llm.common import Scratch, settings

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20240607
#: One random offset for the run; sources step on from it by the golden ratio.
OFFSET = random.Random(SEED).random()
STEP = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> plus rank and target: capped shares by weight, water-filled.

    In order of cap / weight, each source's level is what the budget left by the sources
    before it gives for a weight of 1; the highest is the final one, and every source gets
    level * weight or its cap, whichever is less.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("nth", F.row_number().over(by_source) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(most))
    )
    up = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = ranked.withColumn(
        "level",
        F.try_divide(
            F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        ),
    )
    # sources capped in turn raise the level; past the first that is not, it only falls
    level = F.max("level").over(every)
    return filled.select("source", "source_size", "nth", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, share: float = SHARE, most: int = MOST, offset: float = OFFSET) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    with settings(spark):
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = scratch.table(
            rows.repartitionByRange(parts, F.col("source"), F.col("size"), F.col("doc_id")).withColumn(
                "part", F.spark_partition_id()
            ),
            "rows",
        )
        counts = rows.groupBy("part", "source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
        counts = scratch.table(counts, "counts")  # at most parts + sources rows
        ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("part", "source", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
        targets = source_targets(
            counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most
        )
        plan = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
            "part", F.col("s.source").alias("its_source"), "start", "source_size", "target", "nth"
        )
        plan = scratch.table(plan, "plan")
        inside = Window.partitionBy("part", "source").orderBy("size", "doc_id")
        ranked = rows.withColumn("within", F.row_number().over(inside) - 1)
        joined = ranked.join(
            plan.withColumnRenamed("part", "its_part"),
            (F.col("part") == F.col("its_part")) & F.col("source").eqNullSafe(F.col("its_source")),
        )
        each = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
        shift = (F.lit(offset) + F.col("nth") * STEP) % 1.0
        rank = F.col("start") + F.col("within")
        copies = F.floor(shift + each * (rank + 1)) - F.floor(shift + each * rank)
        return joined.select(
            "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"),
            (copies * F.col("size")).cast("long").alias("taken"),
        )


def op5_source_mix(spark, sf_dir):
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mix_sql(table: str, columns: str) -> str:
    """The same mix in DuckDB SQL over ``table``; ``columns`` of it are read."""
    return f"""
WITH docs AS (SELECT {columns}, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {table}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sizes),
weighed AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
            source_size * 2.0::DOUBLE AS cap FROM ranked),
filled AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0))
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
           FROM weighed WINDOW b AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, least(cap, max(level) OVER () * weight) AS target FROM filled),
placed AS (SELECT d.*, t.source_size, t.target, t.nth, coalesce(t.target / nullif(t.source_size, 0), 0) AS each,
           row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS rank
           FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, (floor(shift + each * (rank + 1)) - floor(shift + each * rank))::BIGINT AS copies
          FROM (SELECT *, ({OFFSET!r}::DOUBLE + nth * {STEP!r}::DOUBLE) % 1.0::DOUBLE AS shift FROM placed))
"""


SQL = mix_sql("documents", "doc_id, source, text") + "SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM mixed"

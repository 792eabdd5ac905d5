"""Outfits are dealt out to more tasks as the tables grow, once, and lines and parts meet without sorts of lines."""

import duckdb
import pytest
from pyspark.sql import functions as F

from draper.operators import pairs
from draper.plans import catalogue
from draper.plans.adapter import garments, read

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["area_fraction", "configured_features", "feature_vector"])
def test_tasks_follow_the_input(spark, name):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        reading = read(spark, SF, "lineitem").rdd.getNumPartitions()
        df = catalogue.QUERIES[name](spark, SF)
        assert reading > 1 and df.rdd.getNumPartitions() == 4 * reading
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert "SortMergeJoin" not in final and final.count("Exchange hashpartitioning(l_orderkey") == 1 and "Exchange hashpartitioning(image_id" not in final
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_without_a_part_or_with_two(spark, tmp_path):
    parts = read(spark, SF, "part")
    parts.where("p_partkey % 7 > 0").unionByName(parts.where("p_partkey % 5 = 1").withColumn("p_size", parts.p_size + 1)).write.parquet(f"{tmp_path}/part.parquet")
    read(spark, SF, "lineitem").where("l_orderkey < 300").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = garments(spark, str(tmp_path))
    plain = lambda rows: sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE['garments_long']})").fetchall()
    assert plain(df.collect()) == plain(want) and len(want) > 100


def test_palette_tasks_follow_the_input(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        reading = read(spark, SF, "lineitem").rdd.getNumPartitions()
        df = catalogue.QUERIES["palette"](spark, SF)
        assert reading > 1 and df.rdd.getNumPartitions() == 4 * reading
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_donors_bring_their_group(spark):
    owner = read(spark, SF, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("grp"))
    found = pairs.grouped_donors(garments(spark, SF).where("image_id < 200"), owner).collect()
    group = {r.image_id: r.grp for r in owner.collect()}
    assert len(found) > 100 and all(r.donor_grp == group[r.donor_id] != group[r.image_id] for r in found)


@pytest.mark.parametrize("name, most", [("pair_records", 1), ("attrition", 1)])
def test_garments_and_donor_pools_are_dealt_out_once(spark, name, most):
    df = catalogue.QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [line.split("Exchange ", 1)[1] for line in plan.split("\n") if "Exchange hashpartitioning(" in line and "ReusedExchange" not in line]
    by = {k: len([m for m in made if m.startswith(f"hashpartitioning({k}")]) for k in ("l_orderkey", "l_partkey", "code", "image_id")}
    # by code: the pool in buckets, the pool by index, first draws, later draws, and draws that are sent back
    assert by["l_orderkey"] == by["l_partkey"] == most and by["code"] <= 5 and by["image_id"] <= 2, by

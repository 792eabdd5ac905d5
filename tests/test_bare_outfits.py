"""Queries by rules over outfits without Lab, level or area, against their SQL; the driver's small tables have none."""

import duckdb
import pytest
from pyspark.sql import functions as F

from draper.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["color_harmony", "configured_issues", "configured_rule_score", "formality", "issue_refs", "proportion", "rule_score", "seasonality", "tone", "worst_issues"]


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("bare")
    key = F.when(F.col("l_orderkey") % 3 == 0, 143 * (F.col("l_linenumber") % 2 + 1)).otherwise(F.col("l_partkey"))  # 11 and 13 divide it
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey < 600").withColumn("l_partkey", key.cast("long"))
    parts = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey not in (143, 286)")
    extra = parts.where("p_partkey = 1").withColumns({"p_partkey": F.explode(F.array(*[F.lit(k).cast("long") for k in (143, 286)])), "p_name": F.lit("small widget")})
    for name, df in (("lineitem", lines), ("part", parts.unionByName(extra.select(parts.columns)))):
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, bare, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{bare}/{t}.parquet/*.parquet'")
    assert con.sql("SELECT count(*) FROM lineitem WHERE l_partkey % 143 = 0 AND l_orderkey % 3 = 0").fetchall()[0][0] > 100
    df = catalogue.QUERIES[name](spark, bare)
    plain = lambda rows: sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE[name]})").fetchall()
    assert plain(df.collect()) == plain(want)

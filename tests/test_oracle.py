"""Every query that has SQL against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from draper.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 7)
    return v


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        made.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return made


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalogue.ORACLE[name]})").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)

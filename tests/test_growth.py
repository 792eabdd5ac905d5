"""Work that has to be done once for each row is written once in the plan, so that large tables don't pay for it again and again."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from draper.functions import text
from draper.operators import free_text, perception_eval, preflight
from draper.plans import catalogue


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_preflight_reads_each_answer_once(spark):
    answers = spark.sql("SELECT id AS image_id, concat('upper: shirt | color=red | fabric=', if(id % 2 = 0, 'cotton', 'na')) AS answer FROM range(4)")
    assert _plan(answers.select(preflight.target_records(F.col("answer")).alias("t"))).count("split(") == 2  # lines, and parts of a line
    plan = _plan(preflight.tried_answers(answers, preflight.known_colors))
    assert [plan.count(by) for by in (r", \R, -1", r", \|, -1", r",  \| , -1", ", \n, -1")] == [1, 1, 1, 1]
    tried = preflight.tried_answers(answers.unionByName(spark.sql("SELECT 9L AS image_id, 'upper: shirt | color=mauve' AS answer")), preflight.known_colors)
    assert {r.image_id: r.trip for r in tried.collect()} == dict.fromkeys(range(4)) | {9: "record 0: color became unknown, expected mauve"}


def test_preflight_reports_read_the_findings_once(spark):
    checked = spark.sql("""SELECT if(id % 3 = 0, 'val', 'train') AS split, id AS image_id, if(id % 2 = 1, 'missing_mask', NULL) AS kind,
        if(id % 2 = 0, concat('upper: shirt | color=', if(id = 6, 'navy', 'red'), ' | fabric=', if(id = 6, 'denim', 'cotton')), NULL) AS answer FROM range(12)""")
    counts, gaps = preflight.error_counts(checked), preflight.coverage_findings(preflight.target_counts(checked))
    assert _plan(counts).count("Range (") == _plan(gaps).count("Range (") == 1
    assert {tuple(r) for r in counts.collect()} == {("val", 4, 2, "missing_mask", 2), ("train", 8, 4, "missing_mask", 4)}
    assert {tuple(r) for r in gaps.collect()} == {("warning", "color", "navy=1"), ("error", "fabric", "denim")}
    clean = preflight.error_counts(checked.where("kind is null and split = 'val'"))
    assert [tuple(r) for r in clean.collect()] == [("val", 2, 2, None, None)]


SF = "/root/testdata/sf0.001"


def test_issues_are_made_once(spark):
    for query in ("issue_refs", "configured_issues", "roast_plan", "roast"):
        plan = _plan(catalogue.QUERIES[query](spark, SF))
        assert plan.count("struct(code, hue_clash") == 1, query


def test_safe_texts_meet_one_pattern(spark):
    plan = _plan(spark.range(1).select(text.safety_flags(F.col("id").cast("string")).alias("f")))
    assert plan.count("lower(") == plan.count("regexp_replace(") == 1
    assert spark.sql("SELECT 'A DAMN  real woman' AS t UNION ALL SELECT 'hello' UNION ALL SELECT NULL").select(text.safety_flags(F.col("t"))).collect() == [("safety:gender,safety:profanity",), ("",), ("",)]


def test_equal_short_texts_and_fields_are_parsed_once(monkeypatch):
    read, lines = [], free_text.garments_of
    monkeypatch.setattr(free_text, "garments_of", lambda t: read.append(t) or lines(t))
    one, long = "upper: test shirt | color=red", "upper: shirt | color=red " + " " * free_text.SHORT
    got = free_text._parse_batch(pa.array([one, one, None, one, long, long])).to_pylist()
    assert read.count(one) == 1 and read.count(long) == 2
    assert got == [free_text.parse(t) for t in (one, one, None, one, long, long)]
    assert free_text.key_and_rest("upper: shirt") == ("upper", "shirt") and free_text.key_and_rest("upper:") == ("upper", "")


def test_perception_reads_each_side_and_the_comparisons_once(spark):
    compared = spark.sql("SELECT 'color' AS field, if(id = 3, 'blue', 'red') AS actual, 'red' AS predicted, id < 4 AS supervised FROM range(5) UNION ALL SELECT 'length', 'na', 'na', false FROM range(2)")
    m = perception_eval.field_metrics(compared)
    assert _plan(m).count("Range (") == 2
    got = {r.field: (r.n, r.accuracy, r.macro_f1, r.excluded, r.undefined) for r in m.collect()}
    assert got["color"] == (4, 0.75, (6 / 7 + 0) / 2, 1, None) and got["length"] == (0, None, None, 2, "no_supervised_rows")
    assert got["fabric"] == (0, None, None, 0, "no_supervised_rows")
    assert _plan(catalogue.QUERIES["perception_metrics"](spark, SF)).count("Relation [p_partkey") == 1

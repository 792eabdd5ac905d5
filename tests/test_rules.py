"""Hand rows of rules that the driver's tables don't reach: category spelling, set refs, broken Lab, unsafe phrases, checks that fail."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from draper.functions.text import parse_garment, safety_flags
from draper.operators import evaluation, pairs, perception_eval, preflight, roast, rules, tables
from draper.operators.audits import ground_truth_audit, sampled_ids

COLUMNS = "image_id string, pos int, slot string, category string, color string, pattern string, fabric string, sleeve_length string, length string, neckline string, lab_l double, lab_a double, lab_b double, area double"


def garments(spark, rows, extra=""):
    full = []
    for r in rows:
        d = {"image_id": "x", "pos": 0, "slot": "upper", "category": "top", "color": "red", "pattern": "na", "fabric": "na", "sleeve_length": None, "length": None,
             "neckline": None, "lab_l": None, "lab_a": None, "lab_b": None, "area": None} | r
        full.append(tuple(d[c.split()[0]] for c in (COLUMNS + extra).split(", ")))
    return spark.createDataFrame(full, COLUMNS + extra)


def test_categories_are_looked_up_by_their_key(spark):
    g = garments(spark, [{"category": "T-Shirt"}, {"category": " Heeled   PUMPS", "pos": 1, "slot": "footwear"}])
    m = rules.measures(g).first()
    assert (m.levels, m.bottom, m.top) == (2, 1, 4)
    assert "formality_mismatch" in rules.rule_score(g).first().issues.split(",")


def test_set_refs_stay_and_repeats_fail(spark):
    g = garments(spark, [{"ref": "mine"}, {"pos": 1, "ref": ""}, {"pos": 2, "ref": None}], ", ref string")
    assert [r.ref for r in rules.with_refs(g).orderBy("pos").collect()] == ["mine", "upper_1", "upper_2"]
    with pytest.raises(Exception, match="duplicate garment ref upper_1"):
        rules.with_refs(garments(spark, [{"ref": "upper_1"}, {"pos": 1, "ref": ""}], ", ref string")).collect()


def test_largest_measured_ties_by_ref(spark):
    rows = [{"pos": p, "area": a} for p, a in enumerate([0.1] * 2 + [None] + [0.3] * 9)]
    assert rules.largest_measured(garments(spark, rows)).first().pos == 10  # upper_10 is before upper_3
    assert rules.largest_measured(garments(spark, [{"pos": 5, "ref": "b"}, {"pos": 6, "ref": "a"}], ", ref string")).first().ref == "a"


def test_lab_that_is_not_finite_counts_as_unmeasured(spark):
    bad = [float("nan"), float("inf"), -float("inf"), None]
    g = garments(spark, [{"pos": i, "color": "white", "lab_l": v, "lab_a": 1.0, "lab_b": 1.0} for i, v in enumerate(bad)] + [{"pos": 9, "lab_l": 5.0, "lab_a": 1.0, "lab_b": 1.0}])
    assert [round(r.l) for r in rules.resolved(g).orderBy("pos").collect()] == [100] * 4 + [5]
    with pytest.raises(Exception, match="three finite numbers"):
        g.select(*[c.alias(n) for n, c in zip("lab", rules.checked_lab([F.col(f"lab_{c}") for c in "lab"]))]).collect()


#: A sentence for every phrase that must be flagged, and some near ones that must not.
UNSAFE = {
    "age": ["Too  old!", "like a grandma", "at your age", "a teenager", "only a child"],
    "attractiveness": ["Your face does this coat no favours", "make you attractive", "too ugly", "fix your looks", "the person wearing them is not", "The person wearing it is not"],
    "body": ["lost some weight", "flatter stomach", "thigh look enormous", "thighs look enormous", "your size", "shoulder far too wide", "shoulders are far too wide", "too fat", "too skinny"],
    "disability": ["something is wrong with you", "are you blind", "look disabled", "cannot use your hands", "with a limp"],
    "gender": ["men should never wear", "real woman", "you look like a man", "girls should not dress this masculine", "pick a gender"],
    "implicature": ["Nothing could have saved this.", "should not be photographed", "the mirror clearly gave up", "more than fabric can hide", "it does not like you"],
    "profanity": ["crap", "HELL", "damn", "bloody", "garbage"],
    "race": ["people of your race", "your skin tone", "your own culture", "immigrant", "only white people"],
}


def test_unsafe_phrases(spark):
    rows = [(k, t) for k, texts in UNSAFE.items() for t in texts] + [("", t) for t in ("hello", "hellish", "scrap", "your faces and no favours", "toold", "a lovely coat", "")]
    got = spark.createDataFrame(rows, "k string, t string").select("k", "t", safety_flags(F.col("t")).alias("f")).collect()
    assert [(r.t, r.f) for r in got if r.f != (f"safety:{r.k}" if r.k else "")] == []
    both = spark.createDataFrame([("Nothing could have saved this. Damn. You look   like a man",)], "t string").select(safety_flags(F.col("t"))).first()[0]
    assert both == "safety:gender,safety:implicature,safety:profanity"


def test_donors_differ_in_any_of_seven_attributes(spark):
    rows = [{"image_id": str(i), "neckline": "round" if i % 2 else "square"} for i in range(12)]
    g = garments(spark, rows).withColumn("image_id", F.col("image_id").cast("long"))
    owner = g.select("image_id", F.col("image_id").alias("grp"))
    found = pairs.donors(g, owner).collect()
    assert found and all(r.image_id % 2 != r.donor_id % 2 for r in found)


def test_each_draw_asks_every_index_once(spark):
    sizes = [1, 2, 3, 5, 7, 12, 30, 99, 100, 101, 1000]
    df = spark.createDataFrame([(n, i, k) for n in sizes for i in range(n) for k in (1, 33, 70)], "size long, idx long, k long")
    got = df.withColumn("x", pairs.permuted(F.col("idx"), F.col("size"), F.col("k"))).groupBy("size", "k").agg(F.array_sort(F.collect_list("x")).alias("x"), F.collect_list("x").alias("order")).collect()
    assert len(got) == 3 * len(sizes) and all(r.x == list(range(r["size"])) for r in got)
    assert len({tuple(r.order) for r in got if r["size"] == 1000}) == 3


def test_attrition_has_its_five_reasons_and_is_observed_in_the_same_job(spark, tmp_path):
    def outfit(i, slots, look="round"):
        return [{"image_id": str(i), "pos": p, "slot": s, "neckline": look} for p, s in enumerate(slots)]

    rows = []
    for i in range(20):  # uppers and lowers of two looks, in groups of their own
        rows += outfit(i, ["upper", "lower"], "round" if i % 2 else "square")
    rows += outfit(100, ["bag"]) + outfit(101, ["dress"]) + outfit(102, ["upper", "outer"])
    g = garments(spark, rows).withColumn("image_id", F.col("image_id").cast("long"))
    for groups, reasons in ((F.col("image_id"), None), (F.col("image_id") % 2, {"easy_one_donor_group"})):
        owner = g.select("image_id").distinct().withColumn("grp", groups)
        want = {r.reason: r.n for r in pairs.attrition(g, pairs.donors(g, owner), owner).collect()}
        seen = Observation()
        pairs.pair_records(g, owner, seen).write.mode("overwrite").parquet(str(tmp_path / "out"))
        assert {k: v for k, v in seen.get.items() if v} == want and list(seen.get) == pairs.REASONS
        assert reasons is None or reasons <= set(want)
        assert want["no_eligible_slot"] == 1 and want["easy_incomplete"] >= 2 and want["hard_no_donor"] >= 1


def test_worst_issues_put_major_ones_first(spark):
    rows = [("missing_footwear", "minor"), ("season_mismatch", "major"), ("other", "info"), ("formality_mismatch", "major")]
    df = spark.createDataFrame([([(c, s, "m", ["b", "a"]) for c, s in rows],)], f"issues array<{roast.ISSUE}>")
    assert [x.code for x in df.select(roast.worst(F.col("issues"), 3)).first()[0]] == ["formality_mismatch", "season_mismatch", "missing_footwear"]


def test_keyed_lines_never_fail(spark):
    lines = ["upper: tee | color=red | color=blue | pattern=a=b", "x", "", "upper: t" + "".join(f" | k{i}={i}" for i in range(80)) + " | fabric=denim"]
    got = parse_garment(spark.createDataFrame([(t,) for t in lines], "line string"), ["color", "pattern", "fabric"]).collect()
    assert (got[0].color, got[0].pattern, got[0].fabric) == ("blue", "a=b", None) and got[1].color is None and got[3].fabric == "denim"


def test_strict_targets(spark):
    cases = {
        "upper: top | color=red\n\n lower: bottom": None, "": "Target contains no garment records", "upper top": "Target line has no slot delimiter: upper top",
        "upper: | ": "Target line has no category: upper: |", "upper: top | red": "Target field is not keyed: red", "upper: top | shade=red": "Unexpected target field shade",
        "upper: top | color=": "Target field color has an empty value", "upper: top | color=red | color=red": "Target field color is repeated",
        "upper: top | color=red\nx\nlower:": "Target line has no slot delimiter: x", "upper: a:b | color=x=y": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "a string").select("a", preflight.target_records(F.col("a")).alias("t")).collect()
    assert {r.a: r.t.error for r in got} == cases
    last = next(r.t.records for r in got if r.a.startswith("upper: a:b"))
    assert [(x.slot, x.category, [(f.name, f.value) for f in x.fields]) for x in last] == [("upper", "a:b", [("color", "x=y")])]


def test_round_trip(spark):
    answers = spark.createDataFrame([(1, "upper: top | color=red"), (2, "upper: top | color=mauve"), (3, "upper: top\nlower: bottom"), (4, "upper: top | color")], "image_id int, answer string")
    parsed = preflight.keyed_garments(answers).withColumn("garments", F.transform("garments", lambda g: g.withField("color", F.when(g["color"] == "red", "red"))))
    parsed = parsed.withColumn("garments", F.when(F.col("image_id") == 3, F.slice("garments", 1, 1)).otherwise(F.col("garments")))
    got = {r.image_id: r.error for r in preflight.round_trip_errors(answers, parsed).collect()}
    assert got == {1: None, 2: "record 0: color became null, expected mauve", 3: "parser returned 1 garments for 2 target records", 4: "Target field is not keyed: color"}


def test_slot_and_shape_values_differ_on_nulls(spark):
    g = garments(spark, [{"slot": "dress", "fabric": None}, {"slot": "upper", "pos": 1, "fabric": "denim", "sleeve_length": "long"}])
    f = perception_eval.first_garments(g).select(F.struct(*perception_eval.COLOURED).alias("p"))
    row = f.select(perception_eval.slot_value("p", ["dress", "upper"], "fabric").alias("s"), perception_eval.shape_value("p", ["dress", "upper"], "sleeve_length").alias("h"), perception_eval.slot_value("p", ["bag"], "color").alias("n")).first()
    assert (row.s, row.h, row.n) == ("na", "long", "na")


def test_coverage_has_to_be_exact(spark):
    g = garments(spark, [{}])
    labels = spark.createDataFrame([("x", True), ("y", True)], "image_id string, has_shape boolean")
    for c in preflight.LABELS:
        labels = labels.withColumn(c, F.lit("na"))
    with pytest.raises(Exception, match="do not cover the images exactly: y"):
        perception_eval.comparisons(labels, g, g).collect()
    m = {r.field: r for r in perception_eval.field_metrics(perception_eval.comparisons(labels.where("image_id = 'x'").withColumn("has_shape", F.lit(False)), g, g)).collect()}
    assert m["neckline"].undefined == "no_supervised_rows" and m["neckline"].excluded == 1 and m["color"].accuracy == 1.0 and m["fabric"].n == 3


def test_scorer_without_negatives(spark):
    got = {r.metric: r.value for r in evaluation.evaluate_scorer(spark.createDataFrame([("a", "observed", 1.0), ("b", "hard", 2.0)], "recipient_id string, kind string, score double")).collect()}
    assert got["n_observed"] == 1 and got["n_hard"] == 0 and got["auc_hard"] is None and got["ranking_accuracy"] is None and got["mean_observed"] == 1.0
    ties = [(r, k, v) for r, vs in {"a": (3.0, 3.0, 1.0), "b": (1.0, 2.0, 2.0), "c": (5.0, None, 4.0)}.items() for k, v in zip(evaluation.KINDS, vs) if v is not None]
    got = {r.metric: r.value for r in evaluation.evaluate_scorer(spark.createDataFrame(ties, "recipient_id string, kind string, score double")).collect()}
    assert (got["accuracy_hard"], got["ranking_accuracy"], got["n_ranked"]) == (0.25, 0.5, 2) and got["auc_easy"] == pytest.approx(5.5 / 9)


def test_grounding_needs_a_description(spark):
    roasts = spark.createDataFrame([("x", ["upper_0"]), ("y", [])], "image_id string, grounded_garments array<string>")
    known = spark.createDataFrame([("x", "upper_0")], "image_id string, ref string")
    with pytest.raises(Exception, match="no description for y"):
        evaluation.evaluate_grounding(roasts, known).collect()


def test_checks_that_fail_when_read(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    made = tables.assert_unique(df, "k")  # nothing runs yet
    with pytest.raises(Exception, match="k is not unique: a"):
        made.collect()
    assert tables.assert_unique(df, "k", "v").count() == 3
    ids = spark.createDataFrame([("MEN-Denim-id_00000080-01_7",), ("none",)], "i string")
    assert ids.where("i like 'MEN%'").select(tables.group_key(F.col("i"))).first()[0] == "MEN-Denim-id_00000080"
    with pytest.raises(Exception, match="no product id in none"):
        ids.select(tables.group_key(F.col("i"))).collect()
    with pytest.raises(Exception, match="no labels for q"):
        labels = spark.createDataFrame([("x",)], "image_id string").withColumn("has_shape", F.lit(True))
        for c in preflight.LABELS:
            labels = labels.withColumn(c, F.lit("na"))
        ground_truth_audit(labels, spark.createDataFrame([("q", "upper")], "image_id string, slot string")).collect()


def test_samples_agree_whatever_the_partitions(spark):
    ids = spark.range(500).select(F.col("id").cast("string").alias("image_id"))
    one = [r.image_id for r in sampled_ids(ids, 20, 5).collect()]
    assert one == sorted(one) == [r.image_id for r in sampled_ids(ids.repartition(7), 20, 5).collect()] and len(one) == 20
    assert one != [r.image_id for r in sampled_ids(ids, 20, 6).collect()]


def test_outfits_without_evidence_obey_the_rules_where_the_book_says_so(spark):
    from draper.plans.outfits import BOOK

    g = garments(spark, [{"category": "widget", "color": "unknown"}])
    named, scored = rules.rule_score(g).first(), rules.rule_score(g, book=BOOK).first()
    assert (named.overall, named.issues) == (50.0, "other") and (scored.overall, scored.issues, scored.majors) == (100.0, "", 0)
    assert [len(roast.issues(g, *book).first().issues) for book in ((), (BOOK,))] == [1, 0]


def test_a_group_with_nearly_all_garments_is_met_from_the_other_side(spark):
    """The first draw that finds a donor, by brute force over every draw."""
    n = 300
    rows = [{"image_id": str(i), "neckline": None if i % 3 else "round"} for i in range(n)]
    g = garments(spark, rows).withColumn("image_id", F.col("image_id").cast("long"))
    owner = g.select("image_id", F.when(F.col("image_id") % 20 == 0, F.col("image_id")).otherwise(-1).alias("grp"))
    asked = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(pairs.DRAWS - 1))).alias("k"))
    key = pairs.slot_code(F.lit("upper")) * pairs.DRAWS + F.col("k")
    asked = asked.withColumn("want", pairs.permuted(F.col("id"), F.lit(n).cast("long"), key))
    want = {}
    for r in asked.orderBy("k").collect():
        i, j = r.id, r.want
        if i != j and bool(i % 3) != bool(j % 3) and (i % 20 == 0 or j % 20 == 0):
            want.setdefault(i, (r.k, j))
    assert {r.image_id: (r.k, r.donor_id) for r in pairs.donors(g, owner).collect()} == want
    back = asked.withColumn("back", pairs.permuted(F.col("want"), F.lit(n).cast("long"), key, True))
    assert back.where("back <> id").count() == 0


def test_scores_are_made_once_for_all_metrics(spark):
    rows = spark.createDataFrame([(i, k, float((i * 7 + n * 3) % 5)) for i in range(40) for n, k in enumerate(evaluation.KINDS)], "recipient_id int, kind string, score double")
    read = spark.sparkContext.accumulator(0)

    def seen(parts):
        for p in parts:
            read.add(p.num_rows)
            yield p

    got = {r.metric: r.value for r in evaluation.evaluate_scorer(rows.mapInArrow(seen, rows.schema)).collect()}
    assert (got["n_ranked"], read.value) == (40, 120)


def test_versions_of_an_outfit_are_scored_by_their_keys(spark):
    g = garments(spark, [{"area": 0.5}, {"pos": 1, "slot": "lower", "category": "blazer", "color": "blue"}])
    both = g.withColumn("kind", F.lit("a")).unionByName(g.where("pos = 0").withColumn("kind", F.lit("b")))
    got = {(r.image_id, r.kind): r.overall for r in rules.rule_score(both, by=("image_id", "kind")).collect()}
    assert got == {("x", "a"): rules.rule_score(g).first().overall, ("x", "b"): rules.rule_score(g.where("pos = 0")).first().overall}

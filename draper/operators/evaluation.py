"""Scorers against pairs, roasts against descriptions, and the safety filter against probes.

Each result is one row of aggregates; what cannot be measured is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draper.functions.text import safety_flags
from draper.operators.metrics import rank_auc
from draper.operators.perception_eval import covering

KINDS = ["observed", "hard", "easy"]


def scores_by_recipient(scores: DataFrame) -> DataFrame:
    """(recipient_id, kind, score) -> recipient_id, observed, hard, easy; recipients without an observed score go."""
    at = [F.max(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in KINDS]
    return scores.groupBy("recipient_id").agg(*at).where("observed is not null")


def counted(wide: DataFrame) -> DataFrame:
    """The distinct triples of scores with the number n of their recipients: all that the metrics read."""
    return wide.groupBy(*KINDS).agg(F.count("*").alias("n"))


def two_sample_aucs(wide: DataFrame) -> DataFrame:
    """(metric, auc) of ``counted`` triples: observed against hard and easy scores of the same recipients, and all observed against all negatives."""
    o, h, e = (F.col(k) for k in KINDS)
    one = lambda metric, label, score: F.when(score.isNotNull(), F.struct(F.lit(metric).alias("metric"), F.lit(label).alias("label"), score.alias("score")))
    sides = [one("auc_pooled", 1, o)]
    for name, negative in (("auc_hard", h), ("auc_easy", e)):
        sides += [one(name, 0, negative), one("auc_pooled", 0, negative), one(name, 1, F.when(negative.isNotNull(), o))]
    rows = wide.select(F.explode(F.array_compact(F.array(*sides))).alias("x"), "n").select("x.*", "n")
    return rank_auc(rows, "n", ("metric",))


def _wins(a: Column, b: Column) -> Column:
    """1 where a is above b, a half where they tie; null where one is."""
    return F.when(a > b, 1.0).when(a == b, 0.5).when(a < b, 0.0)


def evaluate_scorer(scores: DataFrame) -> DataFrame:
    """(recipient_id, kind, score) -> (metric, value): counts, means, paired and ranking accuracies and AUCs.

    Negatives without an observed score of their recipient don't count; a recipient is ranked if it has all three.
    """
    wide = counted(scores_by_recipient(scores)).localCheckpoint()  # read four times below; what made the scores runs once
    o, h, e = (F.col(k) for k in KINDS)
    ordered = F.when(h.isNotNull() & e.isNotNull(), ((o >= h) & (h >= e)).cast("double"))
    size = lambda c: F.coalesce(F.sum(F.when(c.isNotNull(), F.col("n"))), F.lit(0)).cast("double")
    mean = lambda c: F.try_divide(F.sum(c * F.col("n")), F.sum(F.when(c.isNotNull(), F.col("n"))))
    one = wide.agg(
        size(o).alias("n_observed"), size(h).alias("n_hard"), size(e).alias("n_easy"),
        size(ordered).alias("n_ranked"), mean(_wins(o, h)).alias("accuracy_hard"), mean(_wins(o, e)).alias("accuracy_easy"),
        mean(ordered).alias("ranking_accuracy"), mean(o).alias("mean_observed"), mean(h).alias("mean_hard"), mean(e).alias("mean_easy"),
    )
    aucs = wide.sparkSession.createDataFrame([("auc_hard",), ("auc_easy",), ("auc_pooled",)], "metric string").join(two_sample_aucs(wide), "metric", "left")
    return one.unpivot([], one.columns, "metric", "value").unionByName(aucs.select("metric", F.col("auc").cast("double").alias("value")))


def evaluate_grounding(roasts: DataFrame, garments: DataFrame) -> DataFrame:
    """Whether the refs of roasts (image_id, grounded_garments) are garments (image_id, ref); a roast without a description fails."""
    known = garments.groupBy("image_id").agg(F.collect_set("ref").alias("known"))
    fail = F.raise_error(F.concat(F.lit("no description for "), F.col("image_id").cast("string"))).cast("boolean")
    j = roasts.join(known, "image_id", "left").where(F.when(F.col("known").isNotNull(), F.lit(True)).otherwise(fail))
    missing = F.size(F.filter("grounded_garments", lambda r: ~F.array_contains("known", r)))
    refs = F.size("grounded_garments")
    m = j.select(refs.alias("refs"), missing.alias("missing"))
    return m.agg(
        F.avg(((F.col("refs") > 0) & (F.col("missing") == 0)).cast("double")).alias("grounded_rate"),
        F.coalesce(F.try_divide(F.sum("missing"), F.sum("refs")), F.lit(0.0)).alias("unsupported_rate"),
        F.avg((F.col("refs") == 0).cast("double")).alias("empty_grounding_rate"), F.avg("refs").alias("mean_grounded_refs"), F.count("*").alias("n_roasts"),
        F.sum(F.col("refs") - F.col("missing")).alias("n_grounded_refs"), F.sum("missing").alias("n_unsupported_refs"),
    )


def evaluate_safety(probes: DataFrame) -> DataFrame:
    """(probe_id, text, must_flag) -> recall, false positive rate, counts, and the ids of missed probes and false positives."""
    p = probes.select(F.col("probe_id").cast("string").alias("id"), "must_flag", (safety_flags(F.col("text")) != "").alias("raised"))
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    must, raised = F.col("must_flag"), F.col("raised")
    return p.agg(
        F.avg(F.when(must, raised.cast("double"))).alias("recall"), F.avg(F.when(~must, raised.cast("double"))).alias("false_positive_rate"),
        F.count("*").alias("n_probes"), F.count_if(must).alias("n_must_flag"), F.count_if(~must).alias("n_negative"), F.count_if(raised).alias("n_flagged"),
        ids(must & ~raised).alias("missed"), ids(~must & raised).alias("false_positives"),
    )


def scored_descriptions(descriptions: DataFrame, scores: DataFrame) -> DataFrame:
    """Descriptions with their scores; an image that only one side has fails."""
    return covering(descriptions, scores, "scores")

"""Stages by name: perception, scoring and roasting as functions from DataFrame to DataFrame, and the chain of the three."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draper.functions.rulebook import load_rules
from draper.operators import roast, rules
from draper.operators.evaluation import scored_descriptions
from draper.operators.palette import measure
from draper.plans.registry import Registry
from draper.sources.records import last_by_key, read_jsonl

Stage = Callable[[DataFrame], DataFrame]
PERCEPTION, SCORING, ROASTING = Registry(), Registry(), Registry()


def replay(spark: SparkSession, path: str, schema: str) -> Stage:
    """Committed descriptions for images: the last record of an id; an image without one fails when it is read."""
    lines = read_jsonl(spark, path, schema)
    records = last_by_key(lines.select("*", F.monotonically_increasing_id().alias("_line")), "image_id", "_line").drop("_line")

    def predict(images: DataFrame) -> DataFrame:
        j = images.select("image_id").join(records.withColumn("_known", F.lit(True)), "image_id", "left")
        fail = F.raise_error(F.concat(F.lit("no fixture for "), F.col("image_id"))).cast("boolean")
        return j.where(F.coalesce("_known", fail)).drop("_known")

    return predict


PERCEPTION.register("replay", replay)
PERCEPTION.register("palette", lambda: measure)
SCORING.register("rules", lambda weights=None: lambda garments: rules.rule_score(garments, weights))
SCORING.register("configured", lambda path: partial(rules.rule_score, book=load_rules(path)))
ROASTING.register("rules", lambda: roast.roast)
ROASTING.register("configured", lambda path: partial(roast.roast, book=load_rules(path)))


def resolve(stage: Stage | None, registry: Registry, name: str, *args, **kw) -> Stage:
    """The stage, or the one registered under the name."""
    return stage if stage is not None else registry.create(name, *args, **kw)


def run(garments: DataFrame, scorer: Stage | None = None, roaster: Stage | None = None) -> DataFrame:
    """Scores and roasts of described outfits; a score for another set of images fails."""
    scores = resolve(scorer, SCORING, "rules")(garments)
    roasts = resolve(roaster, ROASTING, "rules")(garments)
    described = garments.groupBy("image_id").agg(F.count("*").alias("n_garments"))
    return scored_descriptions(described, scores).join(roasts, "image_id")

"""JSONL records, prediction files with a sidecar manifest, and atomic JSON sinks."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import tempfile
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draper.sources.digests import file_digests, folder_digest

GARMENT = (
    "ref string, slot string, category string, color string, color_lab array<double>, color_lab_source string, area_fraction double, pattern string, "
    "fabric string, sleeve_length string, length string, neckline string, confidence double"
)
DESCRIPTION = f"image_id string, image_path string, garments array<struct<{GARMENT.replace(' string', ':string').replace(' double', ':double').replace(' array<double>', ':array<double>')}>>, caption string, provenance string, source_model string, schema_version string"
MANIFEST_VERSION = 1
SCHEMA_VERSION = "1.0.0"
SPLITS = ["train", "val", "test"]
STAGES = ["perception", "scoring", "roast", "guard"]
#: The id of an image that has no name.
IN_MEMORY = "in_memory"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records split at line feeds only, so other line separators may be inside strings; malformed lines fail."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def read_cache(spark: SparkSession, path: str, schema: str, key: str = "image_id") -> DataFrame:
    """The records that an interrupted run has appended: a torn line is dropped, the last of a repeated key counts."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_at"))
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "_at")
    whole = parsed.where(F.col("r").isNotNull() & F.col("r._corrupt").isNull() & F.col(f"r.{key}").isNotNull())
    return last_by_key(whole.select("r.*", "_at").drop("_corrupt"), key, "_at").drop("_at")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """(probe_id, text, must_flag) of a probe corpus; an empty one fails."""
    probes = read_jsonl(spark, path, "probe_id string, text string, must_flag boolean")
    if probes.isEmpty():
        raise ValueError(f"the probe corpus {path} is empty")
    return probes


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no JSON object")
    return found


def write_json_atomic(path: str, value) -> None:
    """Sorted, finite JSON, by a temporary file and a rename."""
    body = json.dumps(value, sort_keys=True, indent=2, allow_nan=False) + "\n"
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w") as f:
            f.write(body)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def manifest_path(folder: str) -> str:
    """The sidecar of a prediction folder, which has to end in .jsonl."""
    if not folder.endswith(".jsonl"):
        raise ValueError(f"predictions must end in .jsonl, got {folder!r}")
    return folder[: -len(".jsonl")] + ".manifest.json"


def prediction_folder(model: str, split: str, base: str) -> str:
    return f"{base}/{model.replace('/', '_')}_{split}.jsonl"


def write_predictions(df: DataFrame, folder: str, model: str, split: str, config: dict | None = None, expected: DataFrame | None = None, seed: int | None = None, inputs: dict | None = None) -> dict:
    """Ids in order, in ranged part files, and beside them a manifest that counts and digests; both or neither stay.

    No records, a repeated id, the id of unnamed images, an unknown split, or ids that don't cover ``expected`` fail.
    """
    beside = manifest_path(folder)
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; expected one of {', '.join(SPLITS)}")
    n, distinct, unnamed = df.agg(F.count("*"), F.countDistinct("image_id"), F.count_if(F.col("image_id") == IN_MEMORY)).first()
    if not n:
        raise ValueError("there are no records")
    if unnamed:
        raise ValueError(f"{unnamed} records have the id {IN_MEMORY!r}, which no image owns")
    if n != distinct:
        raise ValueError(f"{n - distinct} ids are repeated")
    if expected is not None:
        missing = expected.select("image_id").exceptAll(df.select("image_id")).count()
        extra = df.select("image_id").exceptAll(expected.select("image_id")).count()
        if missing or extra:
            raise ValueError(f"{missing} ids are missing and {extra} are unexpected")
    spark = df.sparkSession
    df.orderBy("image_id").write.mode("error").json(folder)
    try:
        manifest = prediction_manifest(spark, folder, model, split, config or {}, seed, inputs)
        write_json_atomic(beside, manifest)
    except BaseException:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        raise
    return manifest


def prediction_manifest(spark: SparkSession, folder: str, model: str, split: str, config: dict, seed: int | None, inputs: dict | None = None) -> dict:
    """What the files of a folder hold: their lines, the Merkle digest of their bytes (digests.py), and where they come from."""
    n = spark.read.option("lineSep", "\n").text(folder).count()
    return {
        "manifest_version": MANIFEST_VERSION, "model": model, "split": split, "n_records": n, "sha256": folder_digest(file_digests(spark, folder)).first()["sha256"],
        "predictions_file": os.path.basename(folder.rstrip("/")), "config_hash": config_hash(config), "seed": seed, "inputs": inputs, "git_sha": git_sha(),
        "schema_version": SCHEMA_VERSION,
    }


def git_sha() -> str | None:
    """The commit of the working folder; none outside of a work tree or without git."""
    try:
        said = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return said.stdout.strip() or None if said.returncode == 0 else None


def out_of_order(df: DataFrame, key: str = "image_id") -> int:
    """How many keys of records read from files do not ascend strictly, inside files and from one file to the next by name."""
    at = df.select(F.col(key).alias("k"), F.struct("_metadata.file_name", "_metadata.file_block_start").alias("p"), F.monotonically_increasing_id().alias("i"))
    inside = at.withColumn("before", F.lag("k").over(Window.partitionBy("p").orderBy("i")))
    parts = inside.groupBy("p").agg(F.count_if(F.col("before") >= F.col("k")).alias("bad"), F.min("k").alias("low"), F.max("k").alias("high"))
    edge = F.coalesce(F.lag("high").over(Window.orderBy("p")) >= F.col("low"), F.lit(False))  # a row for each file
    return parts.withColumn("edge", edge).agg(F.coalesce(F.sum(F.col("bad") + F.col("edge").cast("int")), F.lit(0))).first()[0]


def read_predictions(spark: SparkSession, folder: str, schema: str = DESCRIPTION) -> DataFrame:
    """Records whose manifest is right: version, name, count, digest of the files' bytes, ids that ascend strictly; malformed lines fail."""
    manifest = read_json(manifest_path(folder))
    version = manifest.get("manifest_version")
    if isinstance(version, bool) or not isinstance(version, int) or not 1 <= version <= MANIFEST_VERSION:
        raise ValueError(f"the manifest has version {version!r}, this reader knows {MANIFEST_VERSION}")
    found = prediction_manifest(spark, folder, manifest.get("model"), manifest.get("split"), {}, manifest.get("seed"))
    for key in ("predictions_file", "n_records", "sha256"):
        if found[key] != manifest.get(key):
            raise ValueError(f"the manifest does not describe these predictions: {key} is {found[key]!r}, not {manifest.get(key)!r}")
    df = read_jsonl(spark, folder, schema)
    if out_of_order(df):
        raise ValueError("image ids are not unique and strictly ascending")
    return df


def export_splits(predict, spark: SparkSession, model: str, splits: dict[str, DataFrame], photos: DataFrame, base: str, config: dict | None = None, limit: int | None = None) -> dict[str, dict]:
    """A prediction folder for each split: ids -> predict(DataFrame of id and photograph); an absent photograph fails before any prediction.

    predict takes and returns a DataFrame; limit keeps a split's first ids.
    """
    chosen = {}
    for split, ids in splits.items():
        ids = ids.select("image_id").distinct() if limit is None else ids.select("image_id").distinct().orderBy("image_id").limit(limit)
        absent = ids.join(photos.select("image_id"), "image_id", "left_anti").orderBy("image_id").first()
        if absent:
            raise FileNotFoundError(f"no photograph of {absent['image_id']}")
        chosen[split] = ids
    return {
        split: write_predictions(predict(photos.join(ids, "image_id", "left_semi")), prediction_folder(model, split, base), model, split, config, ids)
        for split, ids in chosen.items()
    }


def config_hash(config: dict) -> str:
    """Eight hex digits of the sorted compact JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:8]


def undefined(reason: str) -> dict:
    """The place of a metric that can't be measured."""
    if not reason.strip():
        raise ValueError("an undefined metric needs a reason")
    return {"reason": reason, "value": None}


def metric_record(stage: str, model: str, split: str, n_items: int, metrics: dict, config: dict, stamp=None, provenance: str = "predicted",
                  baseline: dict | None = None, seed: int | None = None, inputs: dict | None = None) -> dict:
    """The envelope of one measurement; blank names, no items, no metrics or a stamp without a time zone fail."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; expected one of {', '.join(STAGES)}")
    for name, text in (("model", model), ("split", split), ("provenance", provenance)):
        if not text.strip():
            raise ValueError(f"a metric record needs a {name}")
    if n_items < 1 or not metrics:
        raise ValueError("a metric record needs measured items and metrics")
    stamp = stamp or datetime.now(UTC)
    if stamp.utcoffset() is None:
        raise ValueError("the stamp has no time zone")
    return {
        "stage": stage, "model": model, "split": split, "n_items": n_items, "metrics": metrics, "config_hash": config_hash(config), "provenance": provenance,
        "baseline": baseline, "seed": seed, "inputs": inputs, "git_sha": git_sha(), "schema_version": SCHEMA_VERSION, "timestamp": stamp.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
    }


def write_metric_record(record: dict, path: str) -> None:
    write_json_atomic(path, record)

"""Frozen splits: one folder of ordered ids for each split and a manifest that lets a reader prove them.

An id set's digest is of digests: ids go to 4,096 buckets by their MD5, each bucket's sorted
lines are hashed, and then the buckets' hashes in order, so no task ever holds a split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draper.operators.tables import fold_split, group_key
from draper.sources.records import read_json, write_json_atomic

SPLITS = ["train", "val", "test"]
LEAST_GROUPS = 7
MANIFEST = "MANIFEST.json"


def ids_digest(df: DataFrame, id_col: str, *by: str) -> DataFrame:
    """(by, n, ids_sha256): the digest of each group's ids, whatever their order and partitions."""
    line = F.concat(F.col(id_col).cast("string"), F.lit("\n"))
    bucket = F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 3)
    parts = df.groupBy(*by, bucket.alias("_bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "").cast("binary"), 256).alias("_part"), F.count("*").alias("_n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_part"))), lambda x: x["_part"])
    return parts.groupBy(*by).agg(F.sum("_n").alias("n"), F.sha2(F.array_join(ordered, "").cast("binary"), 256).alias("ids_sha256"))


def read_split(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The distinct ids of a split; blank lines don't count."""
    if name not in SPLITS:
        raise ValueError(f"unknown split {name!r}; expected one of {', '.join(SPLITS)}")
    return spark.read.text(f"{folder}/{name}.txt").select(F.trim("value").alias("image_id")).where("image_id <> ''").distinct()


def eligible(outfits: DataFrame) -> DataFrame:
    """(image_id, group, stratum) of full-body rows with a product id; a blank gender or category fails."""
    known = outfits.where(F.col("is_full_body") & F.col("image_id").rlike(r"id_\d{8}"))
    blank = F.coalesce(F.trim("gender") == "", F.lit(True)) | F.coalesce(F.trim("category_from_filename") == "", F.lit(True))
    fail = F.raise_error(F.concat(F.lit("no gender or category: "), F.col("image_id"))).cast("string")
    stratum = F.when(blank, fail).otherwise(F.concat_ws("|", "gender", "category_from_filename"))
    return known.select("image_id", group_key(F.col("image_id")).alias("group"), stratum.alias("stratum"))


def grouped_splits(rows: DataFrame, seed: int = 20260101) -> DataFrame:
    """(image_id, group, split): whole groups dealt within strata; a group of two strata fails when it is read."""
    torn = F.raise_error(F.concat(F.lit("a group spans strata: "), F.col("group").cast("string"))).cast("string")
    groups = rows.groupBy("group").agg(F.count("*").alias("size"), F.min("stratum").alias("low"), F.max("stratum").alias("high"))
    groups = groups.select("group", "size", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(torn).alias("stratum"))
    return rows.join(fold_split(groups, seed=seed).select("group", "split"), "group").select("image_id", "group", "split")


def write_splits(outfits: DataFrame, folder: str, seed: int = 20260101) -> dict:
    """Writes the three splits in order of id, then the manifest; returns it."""
    rows = eligible(outfits)
    n_groups = rows.agg(F.countDistinct("group")).first()[0]
    if n_groups < LEAST_GROUPS:
        raise ValueError(f"only {n_groups} full-body product groups, {LEAST_GROUPS} are needed")
    split = grouped_splits(rows, seed)
    for name in SPLITS:
        split.where(F.col("split") == name).select("image_id").orderBy("image_id").write.mode("overwrite").text(f"{folder}/{name}.txt")
    spark = outfits.sparkSession
    found = {name: ids_digest(read_split(spark, folder, name), "image_id").first() for name in SPLITS}
    manifest = {
        "split_seed": seed, "n_groups": n_groups, "counts": {k: r["n"] if r else 0 for k, r in found.items()}, "sha256": {f"{k}.txt": r["ids_sha256"] if r else "" for k, r in found.items()},
    }
    write_json_atomic(f"{folder}/{MANIFEST}", manifest)
    return manifest


def shared_groups(splits: DataFrame) -> DataFrame:
    """Groups that more than one split has, with those splits."""
    g = splits.groupBy("group").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return g.where(F.size("splits") > 1)


def verify_split_manifest(spark: SparkSession, folder: str) -> dict:
    """The verified counts and digests; repeated ids, other counts or digests and shared groups fail."""
    manifest = read_json(f"{folder}/{MANIFEST}")
    if not isinstance(manifest.get("counts"), dict) or not isinstance(manifest.get("sha256"), dict):
        raise ValueError("the manifest needs counts and sha256")
    every = None
    for name in SPLITS:
        lines = spark.read.text(f"{folder}/{name}.txt").select(F.trim("value").alias("image_id")).where("image_id <> ''")
        n, distinct = lines.agg(F.count("*"), F.countDistinct("image_id")).first()
        if n != distinct:
            raise ValueError(f"split {name!r} repeats {n - distinct} ids")
        if manifest["counts"].get(name) != n:
            raise ValueError(f"split {name!r} has {n} ids but the manifest says {manifest['counts'].get(name)!r}")
        row = ids_digest(lines, "image_id").first()
        if manifest["sha256"].get(f"{name}.txt") != (row["ids_sha256"] if row else ""):
            raise ValueError(f"split {name!r} has another digest than the manifest")
        own = lines.select(F.lit(name).alias("split"), group_key(F.col("image_id")).alias("group"))
        every = own if every is None else every.unionByName(own)
    bad = shared_groups(every).orderBy("group").first()
    if bad:
        raise ValueError(f"splits {', '.join(bad['splits'])} share the group {bad['group']}")
    return {"counts": manifest["counts"], "sha256": manifest["sha256"], "group_disjoint": True}

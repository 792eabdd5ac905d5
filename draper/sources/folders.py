"""Folders of raw files: finding label and caption files, inventories, what a set of ids lacks.

Listings, sizes and line counts are Spark reads of file metadata and text, so a folder of
millions of photographs is one distributed listing. Files are read where they lie; nothing is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draper.operators.perception_eval import covering
from draper.sources.labels import FABRIC, PATTERN, SHAPE_WIDTH, TEXTURE_WIDTH, read_labels
from draper.functions import vocab as V

#: Kind of label file -> words of its name, the first kind that has one counts. Fixed values.
TOKENS = {"shape": ["shape"], "fabric": ["fabric"], "pattern": ["pattern", "color", "colour", "texture"]}
CAPTION_FILES = ["captions.json", "textual_descriptions.json"]
BULK = ["images", "parsing"]
SAMPLE = 120


def human_size(size: Column) -> Column:
    """Bytes in the largest of B, KB, MB and GB that keeps the number readable."""
    out = F.format_string("%d B", size.cast("long"))
    for n, unit in enumerate(("KB", "MB", "GB"), start=1):
        out = F.when(size >= 1024**n, F.format_string(f"%.1f {unit}", F.bround(size / float(1024**n), 1))).otherwise(out)
    return out


def files(spark: SparkSession, root: str, pattern: str = "*", deep: bool = True) -> DataFrame:
    """(path, name, relpath, size) of the files under a folder whose names match; contents are not read."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(deep).lower()).load(root)
    relative = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    return read.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), relative.alias("relpath"), F.col("length").alias("size"))


def label_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, path) of the label files of a folder: by the width of the first line that isn't blank, then by words of the name; the first name counts."""
    blank = F.trim(F.regexp_replace("value", r"[﻿\s]+", " ")) == ""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth"))
    width = F.size(F.split(F.trim(F.regexp_replace("value", r"[﻿\s]+", " ")), " "))
    first = rows.where((F.col("at") == 0) & ~blank).groupBy("path", "name").agg(F.min_by(width, "nth").alias("width"))
    named = lambda kind: F.exists(F.array(*map(F.lit, TOKENS[kind])), lambda t: F.lower("name").contains(t))
    texture = F.col("width") == TEXTURE_WIDTH
    kind = F.when(F.col("width") == SHAPE_WIDTH, "shape").when(texture & named("fabric"), "fabric").when(texture & named("pattern"), "pattern")
    return first.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.min_by("path", "name").alias("path"))


def find_label_files(spark: SparkSession, folder: str) -> dict[str, str]:
    found = {r["kind"]: r["path"] for r in label_kinds(spark, folder).collect()}
    missing = [k for k in TOKENS if k not in found]
    if missing:
        raise ValueError(f"no {', '.join(missing)} annotation in {folder}")
    return found


def read_label_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Fabric, pattern and shape labels of a folder's three files, an image a row.

    Fails when it is read if fabric and pattern cover different images or shape has one more; shape columns of an
    image without a shape are null.
    """
    paths = find_label_files(spark, folder)
    texture = covering(read_labels(spark, paths["fabric"], FABRIC), read_labels(spark, paths["pattern"], PATTERN), "fabric and pattern labels")
    shape = read_labels(spark, paths["shape"], V.SHAPE_CODES)
    j = texture.withColumn("_known", F.lit(True)).join(shape, "image_id", "full_outer")
    surplus = F.raise_error(F.concat(F.lit("shape annotates an image without textures: "), F.col("image_id"))).cast("boolean")
    return j.where(F.coalesce("_known", surplus)).drop("_known")


def missing_label_kinds(spark: SparkSession, raw: str) -> list[str]:
    """Kinds that no label file of ``raw`` is named after."""
    names = files(spark, f"{raw}/labels", "*.txt", deep=False).select(F.lower("name").alias("name"))
    flags = names.agg(*[F.coalesce(F.bool_or(F.exists(F.array(*map(F.lit, tokens)), lambda t: F.col("name").contains(t))), F.lit(False)).alias(k) for k, tokens in TOKENS.items()])
    row = flags.first()
    return [k for k in TOKENS if not row[k]]


def find_caption_file(spark: SparkSession, raw: str) -> str:
    """One of the two usual names, else the only file that is named after captions."""
    found = {r["name"]: r["path"] for r in files(spark, raw, "*.json", deep=False).collect()}
    for name in CAPTION_FILES:
        if name in found:
            return found[name]
    named = sorted(n for n in found if "caption" in n)
    if len(named) != 1:
        raise ValueError(f"no caption JSON in {raw}")
    return found[named[0]]


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(relpath, size, shown, lines, entries, sample) of every file, bulk folders as one row with their number of files."""
    listed = files(spark, root).withColumn("top", F.when(F.col("relpath").contains("/"), F.split_part("relpath", F.lit("/"), F.lit(1))))
    bulk = F.coalesce(F.col("top").isin(BULK), F.lit(False))
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,csv,jsonl}").text(root)
    lines = text.select("value", F.col("_metadata.file_path").alias("p"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth")).alias("at")).groupBy("p").agg(
        F.count("*").alias("lines"), F.min_by(F.substring(F.regexp_replace("value", "^﻿", ""), 1, SAMPLE), "at").alias("line"))
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True).select(
        F.col("_metadata.file_path").alias("q"), F.regexp_replace("value", "^﻿", "").alias("json"))
    keys = F.json_object_keys("json")
    entries = whole.select("q", F.coalesce(F.size(keys), F.json_array_length("json")).alias("entries"), F.when(F.size(keys) > 0, F.substring(F.trim("json"), 1, SAMPLE)).alias("head"))
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    single = listed.where(~bulk).join(lines, plain("path") == plain("p"), "left").join(entries, plain("path") == plain("q"), "left")
    single = single.select("relpath", "size", "lines", "entries", F.coalesce("line", "head").alias("sample"))
    summed = listed.where(bulk).groupBy("top").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    summed = summed.select(F.concat("top", F.lit("/")).alias("relpath"), "size", F.lit(None).cast("long").alias("lines"), F.lit(None).cast("int").alias("entries"), F.concat(F.col("n").cast("string"), F.lit(" files")).alias("sample"))
    return single.unionByName(summed).withColumn("shown", human_size(F.col("size")))


def input_report(ids: DataFrame, photos: DataFrame, masks: DataFrame) -> DataFrame:
    """One row: total ids, ids without a photograph, without a mask, and the first three that lack either."""
    have = lambda df, name: df.select("image_id").distinct().withColumn(name, F.lit(True))
    j = ids.select("image_id").join(have(photos, "photo"), "image_id", "left").join(have(masks, "mask"), "image_id", "left")
    lacks = lambda c: F.col(c).isNull()
    few = j.where(lacks("photo") | lacks("mask")).orderBy("image_id").limit(3).agg(F.array_sort(F.collect_list("image_id")).alias("first_missing"))
    counts = j.agg(F.count("*").alias("total"), F.count_if(lacks("photo")).alias("missing_photos"), F.count_if(lacks("mask")).alias("missing_masks"))
    return counts.withColumn("first_missing", few.scalar())


def require_inputs(ids: DataFrame, photos: DataFrame, masks: DataFrame, label: str = "ids") -> None:
    """Fails unless every id has a photograph and a mask."""
    r = input_report(ids, photos, masks).first()
    if r["missing_photos"] or r["missing_masks"]:
        raise ValueError(f"{label}: {r['total']} ids, {r['missing_photos']} photographs and {r['missing_masks']} parsing masks missing; first missing: {', '.join(r['first_missing'])}")

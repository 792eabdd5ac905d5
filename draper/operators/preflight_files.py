"""The preflight from folders: photographs and masks as files, labels and splits as tables.

Sizes come from the files' headers, class numbers from masks read strictly, colours from the photographs
that can be decoded. A file that can't be read is a finding, never an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draper.operators import palette, preflight
from draper.operators.descriptions import describe, training_answers
from draper.operators.perception import apply_measured, mask_skeleton
from draper.sources.headers import read_headers
from draper.sources.images import mask_counts, read_photos, with_masks
from draper.sources.masks import mask_sizes, read_label_masks


def slots_of(sizes: DataFrame, masks: DataFrame) -> DataFrame:
    """image_id, width, height, slots of each mask: null slots where its class numbers can't be read, none where no garment is."""
    skeleton = mask_skeleton(mask_counts(masks.where("unread is null")))
    found = skeleton.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "slot"))), lambda x: x["slot"]).alias("found"))
    unread = masks.where("unread is not null").select("image_id", F.lit(True).alias("wrong"))
    joined = sizes.join(found, "image_id", "left").join(unread, "image_id", "left")
    slots = F.when(F.col("wrong").isNull(), F.coalesce("found", F.array().cast("array<string>")))
    return joined.select("image_id", "width", "height", slots.alias("slots"))


def training_targets(table: DataFrame, masks: DataFrame, photos: DataFrame) -> DataFrame:
    """(image_id, answer): the garments that labels and masks give, coloured by the photographs."""
    whole = masks.where("unread is null").drop("unread")
    garments = describe(table, mask_skeleton(mask_counts(whole)))
    return training_answers(apply_measured(garments, palette.measure(with_masks(photos, whole), 1)))


def check_folders(spark: SparkSession, requested: DataFrame, table: DataFrame, photos: str, masks: str, answers: DataFrame | None = None) -> DataFrame:
    """The cascade's findings (split, image_id, kind, detail, answer) for the requested images of a label table and two folders.

    Given answers (image_id, answer) are checked in place of those that the labels, masks and photographs give.
    Of photographs that share a name the first path counts.
    """
    pixels = read_label_masks(spark, masks)
    wanted = table.join(requested.select("image_id"), "image_id", "left_semi")
    told = training_targets(wanted, pixels, read_photos(spark, photos)) if answers is None else answers
    sizes = read_headers(spark, photos).groupBy("image_id").agg(F.min_by(F.struct("width", "height"), "path").alias("s")).select("image_id", "s.*")
    return preflight.cascade(requested, table, sizes, slots_of(mask_sizes(spark, masks), pixels), preflight.tried_answers(told, preflight.known_colors))

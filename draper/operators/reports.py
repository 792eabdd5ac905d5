"""Rows as lines of text: the reports that a run prints or keeps."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that show that a caption speaks of a colour. Fixed values.
COLOR_WORDS = ["black", "white", "red", "blue", "green", "yellow", "pink", "grey", "gray", "brown", "purple", "orange", "beige", "navy"]


def lines(df: DataFrame, title: str, *keys: str) -> DataFrame:
    """(line): ``title key=value ...`` for every row, fractions with six digits, in order of the keys."""
    parts = []
    for f in df.schema.fields:
        value = F.format_string("%.6f", F.col(f"`{f.name}`")) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`").cast("string")
        parts.append(F.concat(F.lit(f"{f.name}="), F.coalesce(value, F.lit("undefined"))))
    ordered = df.orderBy(*keys) if keys else df
    return ordered.select(F.concat_ws(" ", F.lit(title), *parts).alias("line"))


def records(df: DataFrame, stage: str, model: str) -> DataFrame:
    """(record): every row as JSON with its stage and model, keys in order, for a log of results."""
    named = df.select(F.lit(stage).alias("stage"), F.lit(model).alias("model"), F.struct(*sorted(df.columns)).alias("metrics"))
    return named.select(F.to_json(F.struct("metrics", "model", "stage")).alias("record"))


def mentions_color(caption: Column) -> Column:
    """True where a caption names a colour as a word."""
    return F.coalesce(F.lower(caption).rlike(r"\b(?:" + "|".join(COLOR_WORDS) + r")\b"), F.lit(False))


def data_root(variable: str = "DRAPER_DATA_ROOT") -> Path:
    """The folder of data: the environment's, else ``data`` in the working folder."""
    return Path(os.environ.get(variable) or "data").expanduser().resolve()


def export_path(path: Column, root: str, data: str) -> Column:
    """A path relative to the root, else under ``data/`` if it is below the data folder, else empty; relative paths stay."""
    clean = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    below = lambda folder: clean.startswith(folder.rstrip("/") + "/")
    behind = lambda folder: F.substr(clean, F.lit(len(folder.rstrip("/")) + 2))
    return F.when(~clean.startswith("/"), clean).when(below(root), behind(root)).when(below(data), F.concat(F.lit("data/"), behind(data))).otherwise("")

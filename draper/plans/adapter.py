"""Binds outfits and garments to the driver's tables; Spark and SQL say the same arithmetic.

An outfit is an order, a garment a lineitem in (line number, part, supplier, price, date,
quantity) order; colour, pattern, fabric, Lab and area come from the part and quantity.
A demonstration binding: the operators take any table with these columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draper.functions.vocab import FABRICS, LENGTHS, NECKLINES, PATTERNS, SLEEVES, SWAPPABLE

CATEGORY = {"anvil": "hoodie", "bolt": "T-Shirt", "gear": "blouse", "gizmo": "trousers", "plate": "blazer", "ring": "Jeans", "rod": "loafers", "widget": "widget"}
COLOR = {"blue": "blue", "cold": "cyan", "hot": "orange", "large": "violet", "new": "white", "old": "brown", "red": "red", "small": "unknown"}


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tasks(df: DataFrame) -> int:
    """To how many tasks rows are dealt out: four for each that reads them, as many as Spark takes for a shuffle at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.rdd.getNumPartitions())


def narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """garments_long as it travels: image_id, pos from 0, slot, part number, part (what ``attributes`` reads, in one number) and area.

    Parts come before numbers, as lists by key, so that lines without a part or with several count once in an outfit.
    Both are dealt out by part, then the lines by outfit, to more tasks the more tasks read them: what follows finds an
    outfit in one task without another exchange, and a task's sorts don't grow with the tables. Lines that share outfit,
    line number and part meet by part already: there they are put in order, so that supplier, price and date stay behind.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    p, wide = F.col("p_partkey"), tasks(lines)
    parts = read(spark, sf_dir, "part").repartition(wide, p).groupBy(p).agg(F.collect_list(_packed()).alias("parts"))
    same = Window.partitionBy("l_partkey", "l_orderkey", "l_linenumber").orderBy("l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    told = lines.repartition(wide, "l_partkey").withColumn("nth", F.row_number().over(same)).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "nth")
    outfit = Window.partitionBy("l_orderkey")
    return (
        told.join(parts.hint("shuffle_hash"), F.col("l_partkey") == p, "left").drop(p).repartition(wide, "l_orderkey")
        .withColumn("pos", F.row_number().over(outfit.orderBy("l_linenumber", "l_partkey", "nth")) - 1)
        .withColumn("area", F.when(F.col("l_partkey") % 13 != 0, F.col("l_quantity") / F.sum("l_quantity").over(outfit)))
        .withColumn("part", F.explode("parts"))
        .select(F.col("l_orderkey").alias("image_id"), "pos", _pick(SWAPPABLE, (F.col("l_linenumber") - 1) % 5).alias("slot"), F.col("l_partkey").alias("number"), "part", "area")
    )


def _packed() -> Column:
    """Size (32 bits, one more if it is null), noun, adjective and brand (4 bits each) of a part."""
    words = F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))
    nth = [F.coalesce(F.array_position(F.array(*map(F.lit, known)), word), F.lit(0)) for known, word in zip((CATEGORY, COLOR), words)]
    brand = F.coalesce(F.substring_index("p_brand", "#", -1).cast("int") % 8 + 7, F.lit(15))
    size = F.coalesce(F.col("p_size").cast("long") + 2**31, F.lit(2**32))
    return sum((F.shiftleft(c.cast("long"), at) for c, at in zip((*nth, brand), (33, 37, 41))), size)


def attributes() -> dict[str, Column]:
    """What a garment is, from the slot, part number and part of ``narrow``."""
    p, slot, bits = F.col("number"), F.col("slot"), lambda at: F.shiftright("part", at).bitwiseAND(15).cast("int")
    size = F.when(bits(32).bitwiseAND(1) == 0, F.col("part").bitwiseAND(2**32 - 1) - 2**31).cast("int")
    brand = F.when(bits(41) < 15, bits(41) - 7)
    known = lambda words, at: F.get(F.array(F.lit(None), *map(F.lit, words.values())), bits(at))
    measured = p % 11 != 0
    return {
        "category": known(CATEGORY, 33), "color": known(COLOR, 37), "pattern": _pick(PATTERNS, brand), "fabric": _pick(FABRICS, size % 8),
        "sleeve_length": F.when(slot.isin("upper", "outer", "dress"), _pick(SLEEVES, p % 6)), "length": F.when(slot.isin("lower", "dress"), _pick(LENGTHS, p % 5)),
        "neckline": F.when(slot.isin("upper", "outer", "dress"), _pick(NECKLINES, p % 7)), "lab_l": F.when(measured, 10 + size * 1.6),
        "lab_a": F.when(measured, (p * 37 % 161 - 80).cast("double")), "lab_b": F.when(measured, (p * 91 % 161 - 80).cast("double")),
    }


def garments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """garments_long: one row for each garment, with pos from 0."""
    return narrow(spark, sf_dir).select("image_id", "pos", "slot", *[c.alias(n) for n, c in attributes().items()], "area")


def paired(spark: SparkSession, sf_dir: str) -> dict:
    """How the operators on pairs take ``narrow``: its attributes, and to how many tasks they deal rows out."""
    return {"attributes": attributes(), "tasks": tasks(read(spark, sf_dir, "lineitem"))}


def _case(key: str, pairs: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


GARMENTS = f"""
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS pos,
  sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem),
slotted AS (SELECT *, {_list(SWAPPABLE)}[((l_linenumber - 1) % 5 + 1)::INT] AS slot FROM lines JOIN part ON l_partkey = p_partkey),
garments AS (SELECT l_orderkey AS image_id, pos, slot, {_case("split_part(p_name, ' ', 2)", CATEGORY)} AS category,
  {_case("split_part(p_name, ' ', 1)", COLOR)} AS color, {_list(PATTERNS)}[(split_part(p_brand, '#', 2)::INT % 8) + 1] AS pattern,
  {_list(FABRICS)}[(p_size % 8 + 1)::INT] AS fabric, CASE WHEN slot IN ('upper', 'outer', 'dress') THEN {_list(SLEEVES)}[(p_partkey % 6 + 1)::INT] END AS sleeve_length,
  CASE WHEN slot IN ('lower', 'dress') THEN {_list(LENGTHS)}[(p_partkey % 5 + 1)::INT] END AS length,
  CASE WHEN slot IN ('upper', 'outer', 'dress') THEN {_list(NECKLINES)}[(p_partkey % 7 + 1)::INT] END AS neckline,
  CASE WHEN p_partkey % 11 <> 0 THEN 10 + p_size * 1.6::DOUBLE END AS lab_l,
  CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 37 % 161 - 80)::DOUBLE END AS lab_a,
  CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 91 % 161 - 80)::DOUBLE END AS lab_b,
  CASE WHEN l_partkey % 13 <> 0 THEN l_quantity / total END AS area FROM slotted)
"""

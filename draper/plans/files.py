"""Queries of the incremental log and of file headers; the log is events, files are built from part."""

from __future__ import annotations

from pyspark.sql import functions as F

from draper.plans.adapter import read
from draper.plans.registry import query
from draper.sources import storage
from draper.sources.digests import content_root
from draper.sources.headers import with_sizes
from draper.streaming.resume import LastWins

_LATEST = "SELECT user_id, event_id, event_type, value FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(_LATEST)
def resumed_latest(spark, d):
    """Each user's last event, kept by a stream that is stopped and begun again: the first half of the events, then all of them."""
    events = read(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    root = storage.fresh_dir(spark, "resumed")
    store = LastWins(spark, f"{root}/store", events.schema, "user_id", "at", merge_every=2)
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        events.where(part).write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 64).parquet(f"{root}/log")
        store.follow(stream, f"{root}/checkpoint").awaitTermination()
    return store.read().select("user_id", "event_id", "event_type", "value")


@query("""SELECT p_partkey AS file, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 5000 + 1 END AS width,
CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN NULL ELSE p_size * 10 END AS height,
CASE WHEN p_partkey % 26 = 13 THEN 'neither PNG nor JPEG' WHEN p_partkey % 11 = 0 THEN 'breaks off' WHEN p_partkey % 13 = 0 THEN 'wrong checksum' END AS reason FROM part""")
def image_headers(spark, d):
    """PNG (even keys) and JPEG files of each part's own size, every 11th cut short, every 13th damaged."""
    key = F.col("p_partkey")
    number = lambda c, n: F.unhex(F.lpad(F.hex(c.cast("long")), 2 * n, "0"))
    joined = lambda *parts: F.concat(*[F.unhex(F.lit(p)) if isinstance(p, str) else p for p in parts])
    width, height = key % 5000 + 1, F.col("p_size") * 10
    head = joined("49484452", number(width, 4), number(height, 4), "0800000000")
    crc = F.when(key % 13 == 0, F.crc32(head) + 1).otherwise(F.crc32(head)) % 2**32
    png = joined("89504E470D0A1A0A0000000D", head, number(crc, 4), "0000000049454E44AE426082")
    jpeg = joined(F.when(key % 13 == 0, F.unhex(F.lit("0000"))).otherwise(F.unhex(F.lit("FFD8"))), "FFE000074A46494600FFC0000B08", number(height, 2), number(width, 2), "01011100FFD9")
    whole = F.when(key % 2 == 0, png).otherwise(jpeg)
    content = F.when(key % 11 == 0, F.substring(whole, 1, 15)).otherwise(whole)
    return with_sizes(read(spark, d, "part").select(key.alias("file"), content.alias("content"), "p_size")).select("file", F.col("width").cast("long"), F.col("height").cast("long"), "reason")


@query("""WITH f AS (SELECT doc_id, encode(coalesce(text, '')) AS c FROM documents),
leaves AS (SELECT doc_id, i, unhex(sha256(unhex('00') || c[i * 1024 + 1 : least(i * 1024 + 1024, octet_length(c))])) AS h FROM f, LATERAL (SELECT unnest(range(greatest(ceil(octet_length(c) / 1024.0)::BIGINT, 1))) AS i)),
""" + ",\n".join(
    f"l{n + 1} AS (SELECT doc_id, i // 2 AS i, CASE WHEN count(*) = 1 THEN any_value(h) ELSE unhex(sha256(unhex('01') || arg_min(h, i) || arg_max(h, i))) END AS h FROM {f'l{n}' if n else 'leaves'} GROUP BY doc_id, i // 2)" for n in range(16)
) + " SELECT doc_id AS file, lower(hex(h)) AS sha256 FROM l16")
def content_digests(spark, d):
    """The Merkle digest of each document's bytes in blocks of 1,024."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, d, "documents").select(F.col("doc_id").alias("file"), F.lower(F.hex(content_root(text, 1024))).alias("sha256"))

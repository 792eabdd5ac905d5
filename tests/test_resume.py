"""The stream that keeps the last record of each key: kills, restarts, torn tails, repeated keys, merges."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from draper.sources import storage
from draper.streaming.resume import LastWins, latest, log_schema, pending

SCHEMA = StructType().add("id", "string").add("at", "long").add("v", "string")


def batches(spark, n, rng):
    return [[(rng.choice([None, *"abcdefg"]), rng.randint(0, 40), f"{b}-{i}") for i in range(30)] for b in range(n)]


def expected(rows):
    best = {}
    for i, at, v in rows:
        if i is not None and (i not in best or (at, v) > best[i]):
            best[i] = (at, v)
    return {(i, *x) for i, x in best.items()}


def rows_of(store):
    return {tuple(r) for r in store.read().collect()}


def test_batches_merges_and_repeats(spark, tmp_path):
    parts = batches(spark, 9, random.Random(1))
    store = LastWins(spark, str(tmp_path / "store"), SCHEMA, "id", "at", merge_every=4)
    assert store.read().count() == 0
    for n, rows in enumerate(parts):
        df = spark.createDataFrame(rows, SCHEMA)
        store.write(df, n)
        store.write(df, n)  # run again after its commit was lost
        assert rows_of(store) == expected([r for p in parts[: n + 1] for r in p])
    assert storage.folders(spark, str(tmp_path / "store" / "base")) == ["7"] and storage.folders(spark, str(tmp_path / "store" / "delta")) == ["8"]


def test_a_folder_without_its_mark_does_not_count(spark, tmp_path):
    parts = batches(spark, 3, random.Random(2))
    store = LastWins(spark, str(tmp_path / "store"), SCHEMA, "id", "at", merge_every=100)
    for n, rows in enumerate(parts):
        store.write(spark.createDataFrame(rows, SCHEMA), n)
    os.remove(tmp_path / "store" / "delta" / "2" / "_SUCCESS")
    assert rows_of(store) == expected([r for p in parts[:2] for r in p])
    torn = tmp_path / "store" / "base" / "1"
    torn.mkdir(parents=True)
    (torn / "part-0.parquet").write_bytes(b"half")
    assert rows_of(store) == expected([r for p in parts[:2] for r in p])
    store.merge(1)
    assert rows_of(store) == expected([r for p in parts[:2] for r in p])


class Killed(LastWins):
    """Dies behind the write of its third batch, before the stream can note that it is done."""

    def write(self, batch, batch_id):
        super().write(batch, batch_id)
        if batch_id == 2:
            raise RuntimeError("killed")


def test_killed_and_restarted_stream_equals_the_batch(spark, tmp_path):
    log, rng, rows = tmp_path / "log", random.Random(3), []
    log.mkdir()
    for n in range(6):
        part = [(rng.choice("abcde"), 100 * rng.randint(0, 5) + n, f"{n}-{i}") for i in range(20)]
        rows += part
        text = "".join(json.dumps(dict(zip(("id", "at", "v"), r))) + "\n" for r in part)
        (log / f"{n}.jsonl").write_text(text + '{"id": "a", "at": 99999, "v": "to' if n % 2 else text + "\n[1]\n" + '{"at": 99999, "v": "no key"}\n')
    source = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", 1).text(str(log))
    parsed = source.select(F.from_json("value", "id string, at long, v string").alias("r")).select("r.*").where("id is not null and at is not null and v is not null")
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")
    died = Killed(spark, root, SCHEMA, "id", "at", merge_every=2).follow(parsed, checkpoint)
    with pytest.raises(Exception, match="killed"):
        died.awaitTermination()
    store = LastWins(spark, root, SCHEMA, "id", "at", merge_every=2)
    store.follow(parsed, checkpoint).awaitTermination()
    assert rows_of(store) == expected(rows) == {tuple(r) for r in latest(spark.createDataFrame(rows, SCHEMA), "id", "at").collect()}
    (log / "9.jsonl").write_text('{"id": "new", "at": 1, "v": "later"}\n')
    store.follow(parsed, checkpoint).awaitTermination()
    assert rows_of(store) == expected(rows) | {("new", 1, "later")}
    todo = spark.createDataFrame([("a",), ("new",), ("open",)], "id string")
    assert [r["id"] for r in pending(todo, store.read(), "id").collect()] == ["open"]
    store.finish(str(tmp_path / "out"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [*"abcde", "new"] and not storage.exists(spark, root)


def test_log_order_is_the_place_in_the_log(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for n, v in enumerate(("first", "second", "third")):
        (log / f"{9 - n}.jsonl").write_text("".join(json.dumps({"id": "a", "v": f"{v} {i}"}) + "\n" for i in range(3)))
        os.utime(log / f"{9 - n}.jsonl", (1_700_000_000 + n, 1_700_000_000 + n))
    schema = log_schema(StructType().add("id", "string").add("v", "string"))
    store = LastWins(spark, str(tmp_path / "store"), schema, "id", "_at")
    store.follow_files(str(log), str(tmp_path / "checkpoint"), 1).awaitTermination()
    assert [r["v"] for r in store.read().collect()] == ["third 2"]
    (log / "again.jsonl").write_text('{"id": "b", "v": "torn\n{"v": "no key"}\n[1]\n{"id": "a", "v": "fourth"}\n{"id": "a", "v": "to')
    store.follow_files(str(log), str(tmp_path / "checkpoint"), 1).awaitTermination()
    assert [tuple(r)[:2] for r in store.read().collect()] == [("a", "fourth")]

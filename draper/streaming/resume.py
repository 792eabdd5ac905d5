"""The resumable append log, the one incremental operator: the last record of each key counts.

``latest`` says so for a batch. ``LastWins`` keeps the same table under a stream. A
micro-batch writes the last record of each of its keys to a folder named by the batch's
id, so a batch that is run again after a crash replaces its own folder and nothing else.
After ``merge_every`` batches the folders are merged into a base, which names the last batch it holds.
A folder counts once Spark has put its _SUCCESS mark there, and readers start from the
newest base, so a run that dies while it writes or merges leaves the earlier state readable. The order of
records is a column of the log, not their arrival: late or repeated files do not change the result.

Defined cases: a record without a key is no record; a torn or malformed line is dropped;
records that tie in the order follow their other columns; an empty log gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from draper.sources import storage


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key; one partial aggregate, no window."""
    row = F.struct(*log.columns)
    return log.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, order).alias("r")).select("r.*")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a restarted run still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


#: Of each line of a log: its file's time, its file and its block there.
PLACE = ["_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"]


def log_records(lines: DataFrame, schema: str, key: str) -> DataFrame:
    """The whole records of a batch of JSON lines (value and PLACE), with ``_at``, their place in the log."""
    at = F.struct("file_modification_time", "file_path", "file_block_start", F.monotonically_increasing_id().alias("line"))
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), at.alias("_at"))
    whole = parsed.where(F.col("r").isNotNull() & F.col("r._corrupt").isNull() & F.col(f"r.{key}").isNotNull())
    return whole.select("r.*", "_at").drop("_corrupt")


def log_schema(schema: StructType) -> StructType:
    """The schema with the place in the log that ``follow_files`` adds."""
    at = StructType().add("file_modification_time", "timestamp").add("file_path", "string").add("file_block_start", "long").add("line", "long")
    return StructType(schema.fields).add("_at", at)


class LastWins:
    """A table of the last record of each key in a folder, written by micro-batches."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, order: str, merge_every: int = 16):
        self.spark, self.root, self.schema, self.key, self.order, self.merge_every = spark, root.rstrip("/"), schema, key, order, merge_every

    def _whole(self, kind: str) -> dict[int, str]:
        """Batch id -> folder of the deltas or bases that were written to their end."""
        at = f"{self.root}/{kind}"
        return {int(name): f"{at}/{name}" for name in storage.folders(self.spark, at) if storage.exists(self.spark, f"{at}/{name}/_SUCCESS")}

    def _last(self, rows: DataFrame) -> DataFrame:
        """Last by the order, then by the other columns, so that runs agree."""
        kept = rows.where(F.col(self.key).isNotNull()).select(*self.schema.names)
        rest = [c for c in self.schema.names if c not in (self.key, self.order)]
        ranked = kept.withColumn("_order", F.struct(self.order, F.to_json(F.struct(*rest)).alias("rest")) if rest else F.struct(self.order))
        return ranked.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*self.schema.names), "_order").alias("r")).select("r.*")

    def read(self) -> DataFrame:
        bases, deltas = self._whole("base"), self._whole("delta")
        upto = max(bases, default=-1)
        parts = ([bases[upto]] if bases else []) + [path for n, path in sorted(deltas.items()) if n > upto]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self._last(self.spark.read.schema(self.schema).parquet(*parts))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """A micro-batch; running it again changes nothing."""
        self._last(batch).write.mode("overwrite").parquet(f"{self.root}/delta/{batch_id}")
        if (batch_id + 1) % self.merge_every == 0:
            self.merge(batch_id)

    def merge(self, upto: int) -> None:
        """A base of all batches to ``upto``; what it replaces goes only when it is whole."""
        if upto not in self._whole("base"):
            self.read().write.mode("overwrite").parquet(f"{self.root}/base/{upto}")
        for kind in ("base", "delta"):
            for n, path in self._whole(kind).items():
                if n < upto or kind == "delta" and n == upto:
                    storage.remove(self.spark, path)

    def follow(self, log: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None):
        """Starts a query that takes in what has come since the last one, then ends."""
        return log.writeStream.foreachBatch(write or self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def follow_files(self, path: str, checkpoint: str, files_a_batch: int | None = None):
        """``follow`` over a folder of JSON lines, ordered by ``_at``, which the table's schema has to end with."""
        lines = self.spark.readStream.option("lineSep", "\n").options(**({"maxFilesPerTrigger": files_a_batch} if files_a_batch else {})).text(path)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema if f.name != "_at")
        return self.follow(lines.select("value", *PLACE), checkpoint, lambda batch, n: self.write(log_records(batch, ddl, self.key), n))

    def finish(self, out: str) -> None:
        """Exports the table in the order of its keys; the log's folder goes when the export stands."""
        self.read().orderBy(self.key).write.mode("error").parquet(out)
        storage.remove(self.spark, self.root)

"""The batch evaluation run per micro-batch.

A micro-batch is appended to a log under its batch id (written again if the batch is retried), the
committed time T is derived from what the log supports, and the same function that evaluates a table
evaluates the log. A snapshot is one partition per batch id, so a retried batch replaces its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotwise.operators.rank import membership_changes

Evaluate = Callable[[DataFrame, int], DataFrame]


class SnapshotStream:
    """Snapshots of ``evaluate(log, T)`` under ``root``, one per micro-batch."""

    def __init__(self, root: str, evaluate: Evaluate, time_column: str, delay: int = 0, first: int = 0, last: int = 1 << 40):
        self.root, self.evaluate, self.time_column = root, evaluate, time_column
        self.delay, self.first, self.last = delay, first, last

    def committed(self, log: DataFrame) -> int:
        """T: what the log supports, less the delay, inside the session; it never moves back as the log only grows."""
        reached = log.agg(F.max(self.time_column)).first()[0]
        return self.first if reached is None else min(max(int(reached) + 1 - self.delay, self.first), self.last)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.root}/log/batch_id={batch_id}")
        log = spark.read.option("basePath", f"{self.root}/log").parquet(f"{self.root}/log").where(F.col("batch_id") <= batch_id).drop("batch_id")
        at = self.committed(log)
        snapshot = self.evaluate(log, at).withColumn("at", F.lit(at))
        snapshot.write.mode("overwrite").parquet(f"{self.root}/snapshots/batch_id={batch_id}")

    def start(self, stream: DataFrame) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()

    def latest(self, spark: SparkSession) -> DataFrame:
        """The newest snapshot."""
        every = spark.read.parquet(f"{self.root}/snapshots")
        newest = every.agg(F.max("batch_id")).first()[0]
        return every.where(F.col("batch_id") == newest).drop("batch_id")

    def changes(self, spark: SparkSession, symbol: str = "symbol") -> DataFrame:
        """What the newest snapshot adds to and removes from the one before."""
        every = spark.read.parquet(f"{self.root}/snapshots")
        newest = every.agg(F.max("batch_id")).first()[0]
        now, before = (every.where(F.col("batch_id") == n).select(F.col(symbol).alias("symbol")) for n in (newest, newest - 1))
        return membership_changes(now, before)


def event_stream(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream, so many files a batch."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return source.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def windowed_counts(events: DataFrame, key: str, seconds: int, late_seconds: int) -> DataFrame:
    """Events per key and tumbling window of a stream with columns key, at (timestamp)."""
    marked = events.withWatermark("at", f"{late_seconds} seconds")
    counted = marked.groupBy(F.window("at", f"{seconds} seconds").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.unix_seconds("w.start").alias("start_s"), "n")


def distinct_stream(trades: DataFrame, identity: list[str], late_seconds: int) -> DataFrame:
    """The first of each identity of a stream of trades with column at; state is dropped behind the watermark."""
    return trades.withWatermark("at", f"{late_seconds} seconds").dropDuplicatesWithinWatermark(identity)

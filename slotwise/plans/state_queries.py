"""Registered stream queries whose state outlives a batch: the events in five files, out of order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.plans.queries import AT, GATE, HOUR, SQL, START, TICKS, query
from slotwise.sources.folders import shared_folder
from slotwise.sources.tables import ticks
from slotwise.streaming import keyed

FILES = 5


def _split(spark: SparkSession, sf_dir: str, symbol: str, root: str) -> DataFrame:
    """All events as a stream of several files; each holds ticks of every hour, so that all but the first correct bars."""
    rows = ticks(spark, sf_dir, symbol)
    for k in range(FILES):
        rows.where(F.col("seq") % FILES == k).repartition(1).write.parquet(f"{root}/in/file={k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")


@query(SQL["gate_first_pass"])
def stream_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest and latest passing windows of a stream with late corrections: the rows of the batch query."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    found = keyed.qualified(_split(spark, sf_dir, "event_type", root), GATE, HOUR, START, AT, AT - START, AT, 16)
    last = keyed.latest_updates(found, root, ["symbol"]).where("proofs > 0")
    return last.select("symbol", "first_pass", "last_pass", "proofs", F.col("finalized_at").cast("double").alias("finalized_at"))


@query(f"""WITH {TICKS} SELECT user_id AS symbol, size, min(seq) AS seq, count(*) AS copies, min(price > 50) <> max(price > 50) AS unequal FROM ticks GROUP BY 1, 2""")
def stream_trade_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades repeated in later files, and whether a repeat differs from the first."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    trades = _split(spark, sf_dir, "user_id", root).select("symbol", "size", "seq", (F.col("price") > 50).alias("high"), F.timestamp_seconds("sec").alias("at"))
    return keyed.latest_updates(keyed.repeated(trades, ["symbol", "size"], ["high"], 60 * 24 * HOUR, 60 * 24 * HOUR), root, ["symbol", "size"])

"""Reading the event tables as ticks, quotes and dimension rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def epoch_seconds(ts: str = "ts") -> Column:
    """Whole epoch seconds of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """Events as ticks: price is the value, size the ``k`` of the properties, ``seq`` the event id."""
    size = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf_dir, "events").select(
        F.col(symbol).alias("symbol"), epoch_seconds().alias("sec"), F.col("event_id").alias("seq"), F.col("value").alias("price"), size.alias("size")
    )

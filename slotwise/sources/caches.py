"""Dated reference tables as Parquet partitions, and the JSON snapshot sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.dims import retained_dates, usable_cache


def publish(rows: DataFrame, root: str, date: str) -> None:
    """Replace the partition of one date."""
    rows.withColumn("date", F.lit(date).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(root)


def exact(spark: SparkSession, root: str, date: str) -> DataFrame:
    """The rows of exactly this date; only its partition is read."""
    return spark.read.parquet(root).where(F.col("date") == F.lit(date).cast("date"))


def fallback(spark: SparkSession, root: str, date: str, max_age: int = 7) -> DataFrame:
    """The rows of the newest usable date with ``use``: current on the same date, observable up to ``max_age`` days."""
    entries = spark.read.parquet(root)
    best = usable_cache(entries.select("date").distinct(), F.lit(date).cast("date"), max_age)
    return entries.join(F.broadcast(best.where("date is not null")), "date")


def prune(spark: SparkSession, root: str, keep: int = 14) -> DataFrame:
    """What remains when only the newest ``keep`` dates stay."""
    return retained_dates(spark.read.parquet(root), keep)


def remove_old(spark: SparkSession, root: str, keep: int = 14) -> list[str]:
    """Delete the partitions of all but the newest ``keep`` dates and return their dates; the driver sees one row a date."""
    every = spark.read.parquet(root).select("date").distinct()
    gone = every.join(F.broadcast(retained_dates(every, keep)), "date", "left_anti").where("date is not null")
    dates = sorted(str(r["date"]) for r in gone.collect())
    for date in dates:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/date={date}")  # noqa: SLF001
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001
    return dates


def snapshot_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON documents, percentages as ratios and counters as text, as consumers expect them."""
    def outward(name: str) -> object:
        value = F.col(f"{name}.value")
        return F.struct(F.col(f"{name}.status").alias("status"), F.col(f"{name}.reason").alias("reason"), (value / 100).alias("value")).alias(name)

    percent = [c for c in ("from_close", "from_open", "day_range", "activity", "move") if c in rows.columns]
    rest = [F.col(c) for c in rows.columns if c not in percent]
    return rows.select(F.to_json(F.struct(*rest, *(outward(c) for c in percent))).alias("document"))

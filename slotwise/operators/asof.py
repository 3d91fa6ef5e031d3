"""As-of joins by one sort per symbol: both sides are unioned and the last value is carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def marks_before(bars: DataFrame, boundaries: DataFrame) -> DataFrame:
    """For each (symbol, boundary), the slot and close of the last bar that starts strictly before it."""
    at = boundaries.select("symbol", F.col("boundary").alias("slot"), F.lit(0).alias("kind"), F.lit(None).cast("struct<slot:bigint,close:double>").alias("mark"))
    marks = bars.select("symbol", "slot", F.lit(1).alias("kind"), F.struct("slot", "close").alias("mark"))
    order = Window.partitionBy("symbol").orderBy("slot", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = at.unionByName(marks).withColumn("last", F.last("mark", ignorenulls=True).over(order))
    return carried.where("kind = 0").select(
        "symbol", F.col("slot").alias("boundary"), F.col("last.slot").alias("mark_slot"), F.col("last.close").alias("mark_close")
    )


def nearest(current: DataFrame, history: DataFrame, target: int, tolerance: int) -> DataFrame:
    """``current`` with the rank each symbol had in the snapshot nearest to ``target`` (null if none is near).

    ``history`` has at, symbol, rank. Of two snapshots equally near, the later one counts.
    """
    distance = F.abs(F.col("at") - target)
    snapshots = history.select("at").distinct().where(distance <= tolerance)
    best = snapshots.agg(F.max_by("at", F.struct(-distance, F.col("at"))).alias("best"))
    before = history.join(F.broadcast(best), F.col("at") == F.col("best")).select("symbol", F.col("rank").alias("rank_before"))
    return current.join(before, "symbol", "left")


def next_date(dates: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each ``day``, the first listed date on or after it and the last one before it.

    The calendar becomes one row for each day from its first date to its last, so that asked days meet it by an equal join;
    only the listed dates, a row a day at most, go through one window. Days outside the calendar have one of the two.
    """
    listed = dates.where("date is not null").select("date").distinct()
    before = F.lag("date").over(Window.orderBy("date"))
    spans = listed.select("date", before.alias("prior"))
    every = spans.select(F.explode(F.sequence(F.coalesce(F.date_add("prior", 1), F.col("date")), F.col("date"))).alias("day"), F.col("date").alias("session"), "prior")
    ends = listed.agg(F.min("date").alias("first"), F.max("date").alias("last")).select("first", "last", F.lit(1).alias("one"))
    met = wanted.select("day", F.lit(1).alias("one")).join(every, "day", "left").join(F.broadcast(ends), "one", "left")
    session = F.when(F.col("day") < F.col("first"), F.col("first")).otherwise(F.col("session"))
    prior = F.when(F.col("day") > F.col("last"), F.col("last")).otherwise(F.col("prior"))
    return met.select("day", session.alias("session"), prior.alias("prior"))


def marks_carried(marks: DataFrame, bars: DataFrame, changed: DataFrame, since: int, at: int) -> DataFrame:
    """symbol, mark_slot and mark_close of the last bar before ``at``, from the marks before ``since``.

    ``bars`` are those that stand now, ``changed`` the (symbol, slot) that were inserted, revised or withdrawn meanwhile.
    A mark is carried on and meets the bars of [since, at) alone; only a symbol that changed at or after its mark, and
    before ``since``, is read again from the beginning, whose bars the semi-join picks out.
    """
    late = changed.where(F.col("slot") < since).groupBy("symbol").agg(F.max("slot").alias("changed_slot"))
    met = marks.select("symbol", "mark_slot", "mark_close").join(late, "symbol", "full")
    dirty = F.col("changed_slot").isNotNull() & (F.col("mark_slot").isNull() | (F.col("changed_slot") >= F.col("mark_slot")))
    again = met.where(dirty).select("symbol")
    last = lambda df: df.groupBy("symbol").agg(F.max_by(F.struct("slot", "close"), "slot").alias("mark"))
    held = met.where(~dirty & F.col("mark_slot").isNotNull()).select("symbol", F.struct(F.col("mark_slot").alias("slot"), F.col("mark_close").alias("close")).alias("mark"))
    read = last(bars.where(F.col("slot") < at).join(again, "symbol", "left_semi"))
    fresh = last(bars.where((F.col("slot") >= since) & (F.col("slot") < at)))
    every = held.unionByName(read).unionByName(fresh)
    newest = every.groupBy("symbol").agg(F.max_by("mark", "mark.slot").alias("mark"))
    return newest.select("symbol", F.col("mark.slot").alias("mark_slot"), F.col("mark.close").alias("mark_close"))

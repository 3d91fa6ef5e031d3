"""Which trades and quotes of selected symbols count, and from when a symbol's are covered.

An event counts only if its symbol is selected, it came over the selection's connection and after its
boundary, and no event before it (in order of arrival) has reached its position. Of these, the ones
outside the session or too far behind the committed time are rejected. The first of a symbol opens its
coverage, rejected or not. Membership is one row a symbol; the running maximum is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(events: DataFrame, members: DataFrame, first: int, last: int, committed: Column, horizon: int = 30) -> DataFrame:
    """``events`` (symbol, seq, epoch, frame, idx, event_s) with ``outcome``: admitted, fenced or rejected.

    ``members`` has symbol, member_epoch and boundary (a frame).
    """
    met = events.join(members, "symbol", "left")
    ours = F.coalesce((F.col("epoch") == F.col("member_epoch")) & (F.col("frame") > F.col("boundary")), F.lit(False))
    # Positions are compared as pairs.
    position = F.when(ours, F.struct("frame", "idx"))
    before = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = met.withColumn("position", position).withColumn("reached", F.max("position").over(before))
    ahead = F.col("position").isNotNull() & (F.col("reached").isNull() | (F.col("position") > F.col("reached")))
    timely = (F.col("event_s") >= first) & (F.col("event_s") < last) & (committed.isNull() | (F.col("event_s") >= committed - horizon))
    outcome = F.when(~ahead, "fenced").when(~F.coalesce(timely, F.lit(False)), "rejected").otherwise("admitted")
    return placed.withColumn("outcome", outcome).drop("position", "reached", "member_epoch", "boundary")


def coverage_starts(outcomes: DataFrame, first: int, last: int) -> DataFrame:
    """symbol and covered_from: when the first event that was not fenced was received, inside the session."""
    open_ = outcomes.where("outcome <> 'fenced'")
    start = F.min_by("received_s", "seq")
    return open_.groupBy("symbol").agg(F.least(F.greatest(start, F.lit(first)), F.lit(last)).alias("covered_from"))

"""Coverage as data: which slots of a symbol are present, proven absent, in conflict or unknown.

Coverage is kept as half-open intervals (symbol, a, b), never as a row per slot and symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(slots: DataFrame) -> DataFrame:
    """Maximal runs [a, b) of the slots of each symbol."""
    order = Window.partitionBy("symbol").orderBy("slot")
    run = slots.select("symbol", "slot").distinct().withColumn("run", F.col("slot") - F.row_number().over(order))
    return run.groupBy("symbol", "run").agg(F.min("slot").alias("a"), (F.max("slot") + 1).alias("b")).drop("run")


def merged(intervals: DataFrame) -> DataFrame:
    """The union of intervals that may overlap or touch, as disjoint intervals."""
    before = Window.partitionBy("symbol").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy("symbol").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("b").over(before)
    starts = intervals.withColumn("new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0))
    numbered = starts.withColumn("run", F.sum("new").over(running))
    return numbered.groupBy("symbol", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def subtracted(intervals: DataFrame, holes: DataFrame) -> DataFrame:
    """Disjoint intervals without what disjoint ``holes`` cover: a sweep over both sides' ends."""
    def ends(df: DataFrame, plus: str) -> DataFrame:
        step = F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d"))))
        other = "hole" if plus == "on" else "on"
        return df.select("symbol", step.alias("e")).select("symbol", "e.at", F.col("e.d").alias(plus), F.lit(0).alias(other))

    swept = ends(intervals, "on").unionByName(ends(holes, "hole")).groupBy("symbol", "at").agg(F.sum("on").alias("on"), F.sum("hole").alias("hole"))
    order = Window.partitionBy("symbol").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = swept.withColumn("on", F.sum("on").over(so_far)).withColumn("hole", F.sum("hole").over(so_far)).withColumn("b", F.lead("at").over(order))
    return merged(state.where("on > 0 and hole = 0 and b is not null").select("symbol", F.col("at").alias("a"), "b"))


def covered(intervals: DataFrame, conflicts: DataFrame, spans: DataFrame) -> DataFrame:
    """For each span (symbol, lo, hi): covered slots, and exact: all covered and none in conflict.

    ``intervals`` are disjoint per symbol (present or proven absent). One sort a symbol of all starts and of
    the spans' ends: what is covered before a point is the length of the intervals begun, less what of the last
    one lies ahead, so that spans and intervals are never paired.
    """
    lengths = lambda df, name: df.select("symbol", F.col("a").alias("at"), (F.col("b") - F.col("a")).alias(f"n_{name}"), F.col("b").alias(f"b_{name}"))
    ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("sign"))))
    points = spans.select("symbol", "lo", "hi").distinct().select("symbol", "lo", "hi", ends.alias("e")).select("symbol", "lo", "hi", "e.at", "e.sign")
    rows = points.unionByName(lengths(intervals, "c"), allowMissingColumns=True).unionByName(lengths(merged(conflicts), "x"), allowMissingColumns=True)
    begun = Window.partitionBy("symbol").orderBy("at")
    before = lambda name: F.coalesce(F.sum(f"n_{name}").over(begun) - F.greatest(F.max(f"b_{name}").over(begun) - F.col("at"), F.lit(0)), F.lit(0))
    counted = rows.select("symbol", "lo", "hi", "sign", before("c").alias("c"), before("x").alias("x")).where("sign is not null")
    both = counted.groupBy("symbol", "lo", "hi").agg(F.sum(F.col("c") * F.col("sign")).alias("n"), F.sum(F.col("x") * F.col("sign")).alias("bad"))
    n, bad = F.greatest("n", F.lit(0)), F.col("bad")
    return both.select("symbol", "lo", "hi", n.alias("covered"), ((n == F.col("hi") - F.col("lo")) & (bad <= 0)).alias("exact"), (bad > 0).alias("conflicted"))


def slot_class(present: DataFrame, absent: DataFrame, conflict: DataFrame, slots: DataFrame) -> DataFrame:
    """The class of single slots (symbol, slot); conflict outranks present, present outranks absent.

    One sort a symbol: an interval covers a slot if any that has begun by then reaches beyond it.
    """
    rows = slots.select("symbol", F.col("slot").alias("at"), F.lit(True).alias("asked"))
    for df, name in ((present, "p"), (absent, "q"), (conflict, "c")):
        rows = rows.unionByName(df.select("symbol", F.col("a").alias("at"), F.col("b").alias(name)), allowMissingColumns=True)
    begun = Window.partitionBy("symbol").orderBy("at")
    inside = lambda name: F.max(name).over(begun) > F.col("at")
    kind = F.when(inside("c"), "conflict").when(inside("p"), "present").when(inside("q"), "proven_absent").otherwise("unknown")
    return rows.withColumn("class", kind).where("asked").select("symbol", F.col("at").alias("slot"), "class")


def extended(universe: DataFrame, intervals: DataFrame, conflicts: DataFrame, invalid: DataFrame, marks: DataFrame, start: int, since: int, until: int) -> DataFrame:
    """symbol and consequence after the live fence has proven [since, until) for every symbol of ``universe``.

    ``universe`` has symbol and unknown (the origin of an uncertainty that stands already, or null), ``intervals``
    what was covered before, ``invalid`` slots of rejected bars, ``marks`` the slots of the bars that stand.
    An uncertainty that stands is not lifted here. A bar that was rejected inside the new interval keeps it from being exact.
    """
    span = universe.select("symbol", F.lit(start).cast("bigint").alias("lo"), F.lit(until).cast("bigint").alias("hi"))
    new = universe.select("symbol", F.lit(since).cast("bigint").alias("a"), F.lit(until).cast("bigint").alias("b"))
    trust = covered(merged(intervals.select("symbol", "a", "b").unionByName(new)), conflicts, span).select("symbol", "exact")
    rejected = invalid.where((F.col("slot") >= since) & (F.col("slot") < until)).select("symbol").distinct().withColumn("rejected", F.lit(True))
    printed = marks.where((F.col("slot") >= start) & (F.col("slot") < until)).select("symbol").distinct().withColumn("printed", F.lit(True))
    rows = universe.join(trust, "symbol", "left").join(rejected, "symbol", "left").join(printed, "symbol", "left")
    consequence = (
        F.when(F.col("unknown").isNotNull(), F.col("unknown"))
        .when(F.col("rejected").isNotNull() | ~F.coalesce("exact", F.lit(False)), "unknown_post_bootstrap")
        .when(F.col("printed").isNull(), "no_print_through_t")
        .otherwise("none")
    )
    return rows.select("symbol", consequence.alias("consequence"))


def reconciled(universe: DataFrame, requests: DataFrame, intervals: DataFrame, conflicts: DataFrame, invalid: DataFrame, marks: DataFrame, start: int, since: int, until: int, recovery: bool) -> DataFrame:
    """symbol and consequence once the history of [since, until) that was asked for has come, behind the live fence.

    ``universe`` are the symbols with a valid prior close, ``requests`` (symbol, outcome) what became of their requests:
    complete and not_needed prove the interval, anything else, or no row, leaves it unknown. The other arguments are those
    of ``extended``. An uncertainty is one after the bootstrap if a gap was to be recovered, and a failure otherwise.
    """
    answered = requests.where(F.col("outcome").isin("complete", "not_needed")).select("symbol").distinct()
    before = F.lit("unknown_post_bootstrap" if recovery else "unknown_failure_or_fence")
    known = universe.select("symbol").join(answered.withColumn("answered", F.lit(True)), "symbol", "left")
    asked = known.select("symbol", F.when(F.col("answered").isNull(), before).alias("unknown"))
    found = extended(asked, intervals, conflicts, invalid, marks, start, since, until)
    inexact = F.col("consequence") == "unknown_post_bootstrap"
    return found.select("symbol", F.when(inexact, before).otherwise(F.col("consequence")).alias("consequence"))


def settled(consequences: DataFrame, recovery: bool) -> DataFrame:
    """One row: how many symbols stay unknown, and whether the fence is reconciled, which a recovery with any of them is not."""
    unknown = F.count_if(F.col("consequence").startswith("unknown"))
    return consequences.agg(unknown.alias("n_unknown")).select("n_unknown", ((F.col("n_unknown") == 0) | F.lit(not recovery)).alias("reconciled"))


def later_mark_decision(universe: DataFrame, intervals: DataFrame, conflicts: DataFrame, invalid: DataFrame, marks: DataFrame, start: int, at: int) -> DataFrame:
    """symbol and decision: whether a later live mark lets a symbol be ranked whose earlier slots are unknown.

    ``universe`` has symbol and unknown (boolean), ``marks`` symbol, slot and live (whether a live delivery stands).
    The mark is the last one in [start, at); nothing from it on may be in conflict, rejected or unknown.
    """
    inside = marks.where((F.col("slot") >= start) & (F.col("slot") < at))
    last = inside.groupBy("symbol").agg(F.max("slot").alias("mark"), F.max_by("live", "slot").alias("live"))
    span = last.select("symbol", F.col("mark").alias("lo"), F.lit(at).cast("bigint").alias("hi"))
    trust = covered(intervals, conflicts, span).select("symbol", "exact", "conflicted")
    rejected = invalid.where(F.col("slot") < at).groupBy("symbol").agg(F.max("slot").alias("rejected"))
    rows = universe.join(last, "symbol", "left").join(trust, "symbol", "left").join(rejected, "symbol", "left")
    decision = (
        F.when(~F.coalesce("unknown", F.lit(False)), "not_applicable")
        .when(F.col("mark").isNull(), "no_later_eligible_mark")
        .when(~F.coalesce("live", F.lit(False)), "latest_mark_not_live")
        .when(F.col("conflicted"), "conflict_at_or_after_mark")
        .when(F.col("rejected") >= F.col("mark"), "invalid_at_or_after_mark")
        .when(~F.col("exact"), "incomplete_post_mark_coverage")
        .otherwise("trusted_by_later_live_mark")
    )
    return rows.select("symbol", decision.alias("decision"))

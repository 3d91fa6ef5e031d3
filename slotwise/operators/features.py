"""Measurements of each symbol as of slot T, each with a status and a reason instead of an invented zero.

All of them come from one aggregate over the session's bars of a symbol (Spark combines it before the
shuffle) and a few sums of covered slots, so that the number of bars decides the cost and the number of
measurements does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.scalars import field, finite_positive, percent_change, percent_move, range_position
from slotwise.operators.coverage import covered
from slotwise.params import ScanParams


def session_aggregates(bars: DataFrame, p: ScanParams, at: int) -> DataFrame:
    """Volume, first open, extrema and last mark of [start, at), and the marks that Move needs."""
    base = at - p.move_window
    inside = bars.where((F.col("slot") >= p.start) & (F.col("slot") < at))
    early = F.col("slot") < base
    mark = F.struct("slot", "close")
    return inside.groupBy("symbol").agg(
        F.sum(F.col("volume").cast("double")).alias("volume"),
        F.min("slot").alias("first_slot"),
        F.min_by("open", "slot").alias("first_open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by(mark, F.col("slot")).alias("mark"),
        F.max_by(mark, F.when(early, F.col("slot"))).alias("base_mark"),
    )


def activity_percentile(bars: DataFrame, p: ScanParams, at: int) -> DataFrame:
    """symbol, target and percentile: the share of the earlier windows whose mean volume the last one reaches.

    Every bar of the span adds to the windows that hold it: a bar ``d`` slots before ``at`` lies in the
    target if d <= window, else in the references k with (d - 2 window) / stride <= k < (d - window) / stride.
    """
    inside = bars.where((F.col("slot") >= at - p.activity_span) & (F.col("slot") < at)).select("symbol", (F.lit(at) - F.col("slot")).alias("d"), F.col("volume").cast("double").alias("volume"))
    w, s = p.activity_window, p.activity_stride
    lo = F.greatest(F.ceil((F.col("d") - 2 * w) / s), F.lit(0))
    hi = F.least(F.ceil((F.col("d") - w) / s) - 1, F.lit(p.activity_references - 1))
    windows = F.when(F.col("d") <= w, F.array(F.lit(-1).cast("bigint"))).when(lo <= hi, F.sequence(lo, hi))
    summed = inside.select("symbol", "volume", F.explode(windows).alias("k")).groupBy("symbol", "k").agg((F.sum("volume") / w).alias("mean"))
    per_symbol = summed.groupBy("symbol").agg(
        F.coalesce(F.max(F.when(F.col("k") == -1, F.col("mean"))), F.lit(0.0)).alias("target"),
        F.collect_list(F.when(F.col("k") >= 0, F.col("mean"))).alias("means"),
    )
    reached = F.size(F.filter("means", lambda m: m <= F.col("target"))) + (p.activity_references - F.size("means"))
    return per_symbol.select("symbol", "target", (F.lit(100.0) * reached / p.activity_references).alias("percentile"))


def _status(*cases: tuple[Column, str, str]) -> tuple[Column, Column]:
    """Status and reason of the first case that holds; current with no reason otherwise."""
    status, reason = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for condition, s, r in cases[1:]:
        status, reason = status.when(condition, s), reason.when(condition, r)
    return status.otherwise("current"), reason.otherwise("")


def _facts(universe: DataFrame, bars: DataFrame, intervals: DataFrame, conflicts: DataFrame, invalid: DataFrame, p: ScanParams, at: int) -> DataFrame:
    """One row per symbol with its totals, marks, coverage flags and last invalid slots, which the ladders read."""
    totals = session_aggregates(bars, p, at)
    base = at - p.move_window
    floor = max(at - p.activity_span, p.start)
    spans = universe.select("symbol", F.lit(p.start).cast("bigint").alias("lo"), F.lit(at).cast("bigint").alias("hi")).unionByName(
        universe.select("symbol", F.lit(floor).cast("bigint").alias("lo"), F.lit(at).cast("bigint").alias("hi"))
    ).unionByName(totals.select("symbol", F.lit(p.start).cast("bigint").alias("lo"), F.col("first_slot").alias("hi"))).unionByName(
        totals.select("symbol", (F.col("mark.slot") + 1).alias("lo"), F.lit(at).cast("bigint").alias("hi"))
    ).unionByName(totals.where("base_mark is not null").select("symbol", (F.col("base_mark.slot") + 1).alias("lo"), F.lit(base).cast("bigint").alias("hi"))).distinct()
    trust = covered(intervals, conflicts, spans)

    def of(name: str, lo: Column, hi: Column) -> list[Column]:
        here = (F.col("lo") == lo) & (F.col("hi") == hi)
        return [F.max(F.when(here, F.col("exact"))).alias(f"{name}_exact"), F.max(F.when(here, F.col("conflicted"))).alias(f"{name}_conflict")]

    bounds = trust.join(totals.select("symbol", "first_slot", "mark", "base_mark"), "symbol", "left")
    flags = bounds.groupBy("symbol").agg(
        *of("session", F.lit(p.start), F.lit(at)),
        *of("activity", F.lit(floor), F.lit(at)),
        *of("open", F.lit(p.start), F.col("first_slot")),
        *of("mark", F.col("mark.slot") + 1, F.lit(at)),
        *of("base", F.col("base_mark.slot") + 1, F.lit(base)),
    )
    bad = invalid.where(F.col("slot") < at).groupBy("symbol").agg(
        F.max(F.when(F.col("slot") >= p.start, F.col("slot"))).alias("bad_last"),
        F.max(F.when(F.col("slot") < base, F.col("slot"))).alias("bad_base"),
    )
    return universe.join(totals, "symbol", "left").join(flags, "symbol", "left").join(bad, "symbol", "left")


def _ladders(p: ScanParams, at: int) -> dict[str, tuple[Column, Column]]:
    """Status and reason of each field, as expressions over ``_facts`` (from_close also reads prior_close)."""
    base, floor = at - p.move_window, max(at - p.activity_span, p.start)
    no = F.lit(False)
    last, low, high = F.col("mark.close"), F.col("low"), F.col("high")
    bad_session = F.col("bad_last").isNotNull()
    bad_mark = F.coalesce(F.col("bad_last") > F.coalesce(F.col("mark.slot"), F.lit(-1)), no)
    bad_base = F.coalesce(F.col("bad_base") > F.coalesce(F.col("base_mark.slot"), F.lit(-1)), no)

    def history(name: str, also: Column | None = None) -> list[tuple[Column, str, str]]:
        conflict, exact = F.coalesce(f"{name}_conflict", no), F.coalesce(f"{name}_exact", no)
        return [(conflict, "invalid", "historical_conflict"), (~exact if also is None else ~exact & also, "unavailable", "history_incomplete")]

    day = percent_change(last, F.col("prior_close"))
    position = range_position(last, low, high)
    move = percent_move(last, F.col("base_mark.close"))
    volume = _status((bad_session, "invalid", "invalid_input"), *history("session"))
    from_close = _status((~F.coalesce(finite_positive(F.col("prior_close")), no), "unavailable", "prior_close_unavailable"), (F.col("mark").isNull(), "unavailable", "before_first_print"), (bad_mark | day.isNull(), "invalid", "invalid_input"))
    from_open = _status((bad_mark, "invalid", "invalid_input"), (F.col("mark").isNull(), "unavailable", "before_first_print"), *history("open", F.col("first_slot") > p.start))
    day_range = _status((bad_session, "invalid", "invalid_input"), *history("session"), (F.col("mark").isNull(), "unavailable", "before_first_print"), (high == low, "unavailable", "zero_width"), (position.isNull(), "invalid", "invalid_input"))
    activity = _status((F.coalesce(F.col("bad_last") >= floor, no), "invalid", "invalid_input"), (F.lit(at - p.start < p.activity_span), "warming", "reference_warmup"), *history("activity"))
    moved = _status(
        (F.lit(at - p.start < p.move_window), "warming", "rolling_warmup"),
        (bad_base | bad_mark, "invalid", "invalid_input"),
        (F.col("base_mark").isNull() | F.col("mark").isNull(), "warming", "before_first_print"),
        *history("base", F.col("base_mark.slot") + 1 < base),
        *history("mark", F.col("mark.slot") + 1 < at),
        (move.isNull(), "invalid", "invalid_input"),
    )
    return {"volume": volume, "from_close": from_close, "from_open": from_open, "day_range": day_range, "activity": activity, "move": moved}


def measurements(universe: DataFrame, bars: DataFrame, intervals: DataFrame, conflicts: DataFrame, invalid: DataFrame, priors: DataFrame, p: ScanParams, at: int) -> DataFrame:
    """One row per symbol of ``universe`` with its measurements at ``at``.

    ``intervals`` are the covered slots (present or proven absent, disjoint), ``conflicts`` those in
    conflict, ``invalid`` the slots (symbol, slot) of rejected bars, ``priors`` have symbol, prior_close.
    """
    rows = _facts(universe, bars, intervals, conflicts, invalid, p, at).join(priors, "symbol", "left")
    rows = rows.join(activity_percentile(bars, p, at), "symbol", "left")
    last = F.col("mark.close")
    ladder = _ladders(p, at)
    return rows.select(
        "symbol",
        last.alias("last"),
        (F.lit(at) - F.col("mark.slot") - 1).alias("mark_age"),
        field(*ladder["volume"], F.coalesce("volume", F.lit(0.0))).alias("volume"),
        field(*ladder["from_close"], percent_change(last, F.col("prior_close"))).alias("from_close"),
        field(*ladder["from_open"], percent_change(last, F.col("first_open"))).alias("from_open"),
        field(*ladder["day_range"], range_position(last, F.col("low"), F.col("high"))).alias("day_range"),
        field(*ladder["activity"], F.coalesce("percentile", F.lit(100.0))).alias("activity"),
        field(*ladder["move"], percent_move(last, F.col("base_mark.close"))).alias("move"),
        F.coalesce("session_exact", F.lit(False)).alias("exact"),
    )


#: Fields whose status needs no prior close.
STATUS_ONLY = ("volume", "from_open", "day_range", "activity", "move")


def statuses(universe: DataFrame, bars: DataFrame, intervals: DataFrame, conflicts: DataFrame, invalid: DataFrame, p: ScanParams, at: int) -> DataFrame:
    """symbol, name, status and reason as ``measurements`` gives them, without percentiles, priors or values.

    This is what the accounting of a whole population needs; the windows of activity are not read.
    """
    rows, ladder = _facts(universe, bars, intervals, conflicts, invalid, p, at), _ladders(p, at)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), ladder[n][0].alias("status"), ladder[n][1].alias("reason")) for n in STATUS_ONLY)))
    return rows.select("symbol", each.alias("e")).select("symbol", "e.*")


def trust_rank(status: Column) -> Column:
    return F.when(status == "current", 3).when(status == "warming", 2).when(status == "unavailable", 1).otherwise(0)


#: Fields that need the session's history; the second kind is unavailable without it even if it was invalid.
HISTORY = ("volume", "activity", "move")
HISTORY_ALWAYS = ("from_open", "day_range")


def without_history(fields: DataFrame, unknown: Column) -> DataFrame:
    """``fields`` (name, status, reason, value) where the history fields of symbols with unknown coverage are unavailable."""
    hit = unknown & (F.col("name").isin(*HISTORY_ALWAYS) | F.col("name").isin(*HISTORY) & (F.col("status") != "invalid"))
    masked = {"status": F.lit("unavailable"), "reason": F.lit("history_incomplete"), "value": F.lit(None)}
    return fields.select(*(F.when(hit, masked[c]).otherwise(F.col(c)).alias(c) if c in masked else F.col(c) for c in fields.columns))


# The reasons that each status may have.
REASONS = {
    "current": ("",),
    "warming": ("before_first_print", "history_incomplete", "rolling_warmup", "reference_warmup"),
    "unavailable": ("before_first_print", "history_incomplete", "zero_width", "prior_close_unavailable"),
    "invalid": ("historical_conflict", "invalid_input", "state_bound_exceeded"),
}


def pair_valid(status: Column, reason: Column) -> Column:
    out = F.lit(False)
    for name, reasons in REASONS.items():
        out = F.when(status == name, reason.isin(*reasons)).otherwise(out)
    return out

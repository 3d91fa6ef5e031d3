"""The qualification gate: facts of rolling windows at every end where a window could still pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.scalars import finite
from slotwise.params import GateParams


def candidate_ends(bars: DataFrame, gate: GateParams, last_end: int) -> DataFrame:
    """(symbol, end): a window that ends more than ``max_gap`` slots after a bar cannot pass."""
    ends = F.explode(F.sequence(F.col("slot") + 1, F.col("slot") + 1 + gate.max_gap))
    return bars.select("symbol", ends.alias("end")).where(F.col("end") <= last_end).distinct()


def gate_facts(bars: DataFrame, gate: GateParams, start: int, last_end: int) -> DataFrame:
    """Facts of [end - window, end) for each candidate end, from one sort of bars and ends together.

    Slots before the session count as missing, because only bars from ``start`` on are read.
    """
    inside = bars.where((F.col("slot") >= start) & (F.col("slot") < last_end))
    per_slot = inside.select(
        "symbol", "slot", F.lit(True).alias("is_bar"), "close", F.col("volume").cast("double").alias("volume"), "ats",
        (F.col("volume") / F.nullif(F.col("ats").cast("double"), F.lit(0.0))).alias("trades"),
        (F.col("volume") * F.col("vwap")).alias("dollars"),
    )
    ends = candidate_ends(inside, gate, last_end).select("symbol", F.col("end").alias("slot"), F.lit(False).alias("is_bar"))
    rows = per_slot.unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("slot")
    whole, short = order.rangeBetween(-gate.window, -1), order.rangeBetween(-gate.short_window, -1)
    n_bars = lambda w: F.count_if("is_bar").over(w)
    rated = lambda w: F.count_if(F.col("ats") > 0).over(w) == n_bars(w)
    facts = rows.select(
        "symbol", F.col("slot").alias("end"), "is_bar",
        n_bars(whole).alias("present"),
        F.last("close", ignorenulls=True).over(whole).alias("price"),
        F.when(rated(whole), F.sum("trades").over(whole)).alias("trades"),
        F.when(rated(short) , F.coalesce(F.sum("trades").over(short), F.lit(0.0))).alias("short_trades"),
        F.sum("dollars").over(whole).alias("dollar_volume"),
        (F.max("volume").over(whole) / F.nullif(F.sum("volume").over(whole), F.lit(0.0))).alias("concentration"),
        F.collect_list(F.when(F.col("is_bar"), F.col("slot"))).over(whole).alias("slots"),
    )
    return facts.where(~F.col("is_bar")).withColumn("longest_gap", longest_gap(F.col("slots"), F.col("end"), gate.window)).drop("slots", "is_bar")


def longest_gap(slots: Column, end: Column, window: int) -> Column:
    """The longest run of missing slots in [end - window, end), its edges included."""
    fenced = F.concat(F.array(end - window - 1), slots, F.array(end))
    n = F.size(fenced)
    return F.array_max(F.zip_with(F.slice(fenced, F.lit(2), n - 1), F.slice(fenced, F.lit(1), n - 1), lambda b, a: b - a - 1))


def passes(gate: GateParams) -> Column:
    return F.coalesce(
        (F.col("price") >= gate.min_price)
        & (F.col("present") >= gate.min_present)
        & (F.col("longest_gap") <= gate.max_gap)
        & finite(F.col("trades"))
        & (F.col("trades") >= gate.min_trades)
        & (F.col("short_trades") >= gate.min_short_trades)
        & finite(F.col("dollar_volume"))
        & (F.col("dollar_volume") >= gate.min_dollar_volume)
        & (F.col("concentration") <= gate.max_concentration),
        F.lit(False),
    )


def first_pass(facts: DataFrame, gate: GateParams, now_slot: int, horizon_slots: int) -> DataFrame:
    """Per symbol: the earliest passing end, the latest, their number, and the earliest that is final."""
    good = facts.where(passes(gate))
    final = F.when(F.lit(now_slot) > F.col("end") + horizon_slots, F.col("end"))
    return good.groupBy("symbol").agg(
        F.min("end").alias("first_pass"), F.max("end").alias("last_pass"), F.count(F.lit(1)).alias("proofs"), F.min(final).alias("finalized_at")
    )


def qualification_status(universe: DataFrame, proofs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Finalized, provisional, not yet passed (fully covered without a proof) or unresolved."""
    joined = universe.join(proofs, "symbol", "left").join(coverage, "symbol", "left")
    status = (
        F.when(F.col("finalized_at").isNotNull(), "finalized")
        .when(F.col("first_pass").isNotNull(), "provisional")
        .when(F.coalesce("exact", F.lit(False)), "not_yet_passed")
        .otherwise("unresolved")
    )
    return joined.select("symbol", status.alias("qualification"), "first_pass", "finalized_at")


def affected_ends(changed: DataFrame, gate: GateParams) -> DataFrame:
    """(symbol, lo, hi]: the ends whose facts a changed bar can alter, for incremental recomputation."""
    return changed.select("symbol", F.col("slot").alias("lo"), (F.col("slot") + gate.window).alias("hi")).distinct()

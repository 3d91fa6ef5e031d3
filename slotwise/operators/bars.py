"""Bars: one row per symbol and slot, from ticks or from wire rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.scalars import finite, finite_positive, floor_ratio


def from_ticks(ticks: DataFrame, slot_seconds: int) -> DataFrame:
    """OHLC, volume, vwap and average size of ticks (symbol, sec, seq, price, size) with a positive price.

    One partial and one final aggregate; ``seq`` orders the ticks of a slot.
    """
    slot = F.floor(F.col("sec") / slot_seconds)
    priced = ticks.where(finite_positive(F.col("price"))).withColumn("slot", slot)
    sums = priced.groupBy("symbol", "slot").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("size").alias("volume"),
        F.sum(F.col("price") * F.col("size")).alias("turnover"),
        F.count(F.lit(1)).alias("n"),
    )
    vwap = F.col("turnover") / F.nullif(F.col("volume").cast("double"), F.lit(0.0))
    return sums.withColumn("vwap", vwap).withColumn("ats", floor_ratio(F.col("volume"), F.col("n"))).drop("turnover")


def reject_reason(start: Column, end: Column, session_start: Column, session_end: Column) -> Column:
    """The first structural rule that a bar breaks; null for a valid bar."""
    prices = [F.col(c) for c in ("open", "high", "low", "close", "vwap")]
    positive = finite_positive(prices[0])
    for p in prices[1:]:
        positive = positive & finite_positive(p)
    inside = F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high"))
    return (
        F.when(end - start != 1, "window_length")
        .when((start < session_start) | (end > session_end), "outside_session")
        .when(~positive, "price")
        .when(~finite(F.col("volume").cast("double")) | (F.col("volume") < 0), "volume")
        .when(~inside, "price_order")
        .when(F.col("ats").isNull() | (F.col("ats") < 0), "average_trade_size")
    )


def cumulative_volume(bars: DataFrame) -> DataFrame:
    """``bars`` with the running volume of each symbol."""
    from pyspark.sql import Window

    running = Window.partitionBy("symbol").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bars.withColumn("cumulative", F.sum("volume").over(running))


def folded_prefix(bars: DataFrame, before: int) -> DataFrame:
    """What is left of a symbol's bars older than ``before``: volume, prints, first open, extrema and the latest bar."""
    return bars.where(F.col("slot") < before).groupBy("symbol").agg(
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("prints"), F.min("slot").alias("first_slot"), F.min_by("open", "slot").alias("first_open"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.max("slot").alias("latest_slot"), F.max_by("close", "slot").alias("latest_close"),
    )


def continued(prefix: DataFrame, tail: DataFrame) -> DataFrame:
    """A prefix joined with the fold of the bars after it: the same as a fold of them all.

    A prefix from which bars were withdrawn stays in doubt where it was, but for a latest close that is newer.
    """
    flags = ("open_trusted", "extrema_trusted", "latest_trusted")
    doubted = "extrema_trusted" in prefix.columns
    sides = [df if "extrema_trusted" in df.columns else df.select("*", *(F.lit(True).alias(f) for f in flags)) for df in (prefix, tail)]
    each = sides[0].unionByName(sides[1])
    sound = F.bool_and("extrema_trusted")
    folded = each.groupBy("symbol").agg(
        F.sum("volume").alias("volume"), F.sum("prints").alias("prints"), F.min("first_slot").alias("first_slot"), F.min_by("first_open", "first_slot").alias("first_open"),
        F.when(sound, F.max("high")).alias("high"), F.when(sound, F.min("low")).alias("low"), F.max("latest_slot").alias("latest_slot"), F.max_by("latest_close", "latest_slot").alias("latest_close"),
        F.min_by("open_trusted", "first_slot").alias("open_trusted"), sound.alias("extrema_trusted"), F.max_by("latest_trusted", "latest_slot").alias("latest_trusted"),
    )
    return folded if doubted else folded.drop(*flags)


def without_withdrawn(prefix: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """A prefix after some of the bars folded into it were withdrawn, with what can still be trusted.

    The bars are gone, so that the opening, the extrema or the latest close that a withdrawn bar gave cannot
    be replaced: it becomes null and its flag false, for good. Its place stays, so that ``continued`` folds on. A prefix has a
    row per symbol; withdrawals are summed first, and what was never there takes nothing away.
    """
    facts = prefix.select("symbol", "first_slot", F.col("high").alias("highest"), F.col("low").alias("lowest"), "latest_slot")
    hit = withdrawn.join(facts, "symbol").groupBy("symbol").agg(
        F.sum("volume").alias("less"), F.count(F.lit(1)).alias("fewer"), F.max(F.col("slot") == F.col("first_slot")).alias("opening"),
        F.max((F.col("high") == F.col("highest")) | (F.col("low") == F.col("lowest"))).alias("extreme"), F.max(F.col("slot") == F.col("latest_slot")).alias("ending"),
    )
    rows = prefix.join(hit, "symbol", "left")
    trusted = {name: ~F.coalesce(name, F.lit(False)) for name in ("opening", "extreme", "ending")}
    given = {"first_open": "opening", "high": "extreme", "low": "extreme", "latest_close": "ending"}
    return rows.select(
        "symbol", F.greatest(F.col("volume") - F.coalesce("less", F.lit(0)), F.lit(0)).alias("volume"), F.greatest(F.col("prints") - F.coalesce("fewer", F.lit(0)), F.lit(0)).alias("prints"),
        *(F.when(trusted[by], F.col(name)).alias(name) for name, by in given.items()), "first_slot", "latest_slot",
        trusted["opening"].alias("open_trusted"), trusted["extreme"].alias("extrema_trusted"), trusted["ending"].alias("latest_trusted"),
    )

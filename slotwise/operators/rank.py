"""Ranking, its mode, and how ranks moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_ranked(rows: DataFrame, by: str, top: int = 20) -> DataFrame:
    """The ``top`` rows by ``by`` descending, then symbol ascending by bytes, with their rank.

    The limit runs first (a bounded heap per task), so that only ``top`` rows reach the window.
    """
    best = rows.where(F.col(by).isNotNull()).orderBy(F.col(by).desc(), F.col("symbol").asc()).limit(top)
    order = Window.orderBy(F.col(by).desc(), F.col("symbol").asc())
    return best.withColumn("rank", F.row_number().over(order))


def population_bucket(has_prior: Column, known: Column, mark: Column, no_print: Column, invalid: Column, min_price: float) -> Column:
    """The one bucket of the population that a symbol falls in."""
    return (
        F.when(~has_prior, "invalid_or_missing_prior_close")
        .when(~known, "unknown_due_failure_or_fence")
        .when(mark.isNull() & no_print, "no_print_through_t")
        .when(mark.isNull() & invalid, "invalid_mark")
        .when(mark.isNull(), "unknown_due_failure_or_fence")
        .when(mark < min_price, "trusted_below_price_mark")
        .otherwise("trusted_rankable_mark")
    )


def ranking_mode(lifecycle: Column, unknown: Column, unresolved: Column, rankable: Column, only_bootstrap: Column, lost: Column | None = None) -> Column:
    """mode and reason of a ranking from population counts; stale when its connection was lost while live."""
    live = lifecycle.isin("live", "hydrating")
    why = F.when(unknown != 0, "incomplete_population").otherwise("qualification_pending")
    stale = F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))
    return (
        F.when(stale, F.struct(F.lit("stale").alias("mode"), F.lit("").alias("reason")))
        .when(~live, F.struct(F.lit("unavailable").alias("mode"), F.lit("no_committed_watermark").alias("reason")))
        .when((unknown == 0) & (unresolved == 0), F.struct(F.lit("qualified_current").alias("mode"), F.lit("").alias("reason")))
        .when((lifecycle == "hydrating") & (rankable > 0) & only_bootstrap, F.struct(F.lit("degraded_bootstrap").alias("mode"), why.alias("reason")))
        .when(rankable > 0, F.struct(F.lit("degraded_current").alias("mode"), why.alias("reason")))
        .otherwise(F.struct(F.lit("unavailable").alias("mode"), F.lit("no_trusted_marks").alias("reason")))
    )


def movement(now: Column, before: Column, shown: int = 5) -> Column:
    """'NEW', or ranks gained, cut off at ``shown`` both ways."""
    gained = before - now
    return F.when(before.isNull(), "NEW").when(gained >= shown, f"+{shown}").when(gained <= -shown, f"-{shown}").when(gained > 0, F.concat(F.lit("+"), gained.cast("string"))).otherwise(gained.cast("string"))


def contingency(fields: DataFrame) -> DataFrame:
    """Counts of (name, status, reason) with marginals, one cube per measurement name."""
    sets = fields.groupingSets([["name", "status", "reason"], ["name", "status"], ["name", "reason"], ["name"]], "name", "status", "reason")
    return sets.agg(F.count(F.lit(1)).alias("n"))


def membership_changes(desired: DataFrame, members: DataFrame) -> DataFrame:
    """symbol and change: what to remove from the members and what to add to reach the desired set."""
    gone = members.join(desired, "symbol", "left_anti").select("symbol", F.lit("remove").alias("change"))
    new = desired.join(members, "symbol", "left_anti").select("symbol", F.lit("add").alias("change"))
    return gone.unionByName(new)

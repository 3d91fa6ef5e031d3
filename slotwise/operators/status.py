"""Operational facts: pressure modes with hysteresis, readiness, latency and accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(samples: DataFrame, condition: Column, name: str) -> DataFrame:
    """``samples`` (key, at) with the length of the run of samples up to each one for which ``condition`` held."""
    order = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = F.coalesce(condition, F.lit(False))
    broken = F.sum(F.when(met, 0).otherwise(1)).over(order)
    numbered = samples.withColumn("_met", met).withColumn("_run", broken)
    within = Window.partitionBy("key", "_run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.withColumn(name, F.sum(F.col("_met").cast("int")).over(within)).drop("_met", "_run")


def pressure_modes(samples: DataFrame, degraded_percent: int = 10, aggregate_percent: int = 25, recovery_percent: int = 1, needed: tuple[int, int, int] = (2, 3, 5)) -> DataFrame:
    """The mode after each sample (key, at, waiting, capacity): the last of the three rules that fired.

    Recovery counts healthy samples only since the last mode change, which a run of healthy samples is,
    because any sample that raises the mode is not healthy.
    """
    load = F.col("waiting") * 100
    rows = streaks(samples, load >= F.col("capacity") * degraded_percent, "high")
    rows = streaks(rows, load >= F.col("capacity") * aggregate_percent, "full")
    rows = streaks(rows, load < F.col("capacity") * recovery_percent, "healthy")
    event = F.when(F.col("full") >= needed[1], "aggregate_only").when(F.col("healthy") >= needed[2], "normal").when(F.col("high") >= needed[0], "degraded")
    order = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("event", event)
    # 'degraded' raises only the normal mode: it counts if no 'aggregate_only' came since the last 'normal'.
    since = F.sum(F.when(F.col("event") == "normal", 1).otherwise(0)).over(order)
    spell = Window.partitionBy("key", "_spell").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    worst = F.max(F.when(F.col("event") == "aggregate_only", 2).when(F.col("event") == "degraded", 1).otherwise(0)).over(spell)
    moded = marked.withColumn("_spell", since).withColumn("_worst", worst)
    mode = F.when(F.col("_worst") == 2, "aggregate_only").when(F.col("_worst") == 1, "degraded").otherwise("normal")
    return moded.select("key", "at", "waiting", "capacity", "high", "full", "healthy", mode.alias("mode"))


# Reasons in order of precedence.
READINESS = (
    ("runtime_unavailable", "not process_live"),
    ("suppressed", "suppressed"),
    ("binding_mismatch", "not binding_matches"),
    ("not_live_mode", "not live_mode"),
    ("lifecycle", "lifecycle not in ('live', 'hydrating')"),
    ("aggregate_unacknowledged", "not acknowledged"),
    ("fence_pending", "not fence_reconciled"),
    ("ranking_noncurrent", "not ranking_current"),
    ("watermark_missing", "watermark is null"),
    ("watermark_stale", "target - watermark > tolerance"),
    ("accounting", "not accounting_valid"),
)


def readiness_reason() -> Column:
    out = None
    for reason, rule in READINESS:
        out = F.when(F.expr(rule), reason) if out is None else out.when(F.expr(rule), reason)
    return out.otherwise("none")


def latency(deliveries: DataFrame, last_seconds: int = 1) -> DataFrame:
    """Mean, maximum and recent maximum of receipt minus event time, by family."""
    lag = F.col("receipt_s") - F.col("event_s")
    newest = deliveries.groupBy("family").agg(F.max("receipt_s").alias("newest"))
    recent = F.col("receipt_s") > F.col("newest") - last_seconds
    return deliveries.join(newest, "family").groupBy("family").agg(
        F.avg(lag).alias("mean_lag"), F.max(lag).alias("max_lag"), F.max(F.when(recent, lag)).alias("recent_max_lag"), F.count(F.lit(1)).alias("n")
    )


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """name and n of each reconciliation check that returns rows."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def watermark(state: DataFrame) -> Column:
    """The committed time after a cycle: advances to the target only if all four conditions hold."""
    ready = F.col("epoch_active") & F.col("fence_reconciled") & (F.col("support") >= F.col("target")) & F.col("accounting_valid")
    return F.when(ready, F.greatest("target", F.coalesce("committed", "target"))).otherwise(F.col("committed"))

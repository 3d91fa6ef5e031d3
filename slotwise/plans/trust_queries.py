"""Registered queries of the live fence, later marks, withdrawals from a folded prefix and sealed bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators import bars, coverage, merge
from slotwise.plans.queries import AT, HOUR, START, bars_cte, hourly, query
from slotwise.sources.tables import read, ticks

FENCE = AT - 24


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.from_ticks(ticks(spark, sf_dir, "user_id"), HOUR)


def _interval(symbols: DataFrame, a: int, b: int) -> DataFrame:
    return symbols.select("symbol", F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"))


@query(f"""WITH {bars_cte("user_id")}, m AS (SELECT symbol, count(*) FILTER (slot < {FENCE}) AS before, count(*) AS n FROM bars WHERE slot >= {START} AND slot < {AT} GROUP BY symbol)
SELECT c_custkey AS symbol, CASE WHEN c_custkey % 13 = 0 THEN 'unknown_failure_or_fence' WHEN c_custkey % 11 = 0 OR c_custkey % 7 = 0 OR NOT (c_custkey % 3 <> 0 OR coalesce(before, 0) = {FENCE - START}) THEN 'unknown_post_bootstrap'
  WHEN n IS NULL THEN 'no_print_through_t' ELSE 'none' END AS consequence FROM customer LEFT JOIN m ON symbol = c_custkey""")
def live_fence_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day proven for all users: a third has an incomplete past, some a rejected bar, a conflict or an older uncertainty."""
    symbols, b, s = _symbols(spark, sf_dir), _users(spark, sf_dir), F.col("symbol")
    known = coverage.islands(b.where(F.col("slot") < FENCE)).unionByName(_interval(symbols.where(s % 3 != 0), START, FENCE))
    conflicts = _interval(symbols.where(s % 7 == 0), START + 5, START + 9)
    invalid = symbols.where(s % 11 == 0).withColumn("slot", F.lit(AT - 10).cast("bigint"))
    universe = symbols.withColumn("unknown", F.when(s % 13 == 0, "unknown_failure_or_fence"))
    return coverage.extended(universe, known, conflicts, invalid, b, START, FENCE, AT)


RECONCILED = f"""{bars_cte("user_id")}, m AS (SELECT symbol, count(*) FILTER (slot < {FENCE}) AS before, count(*) AS n FROM bars WHERE slot >= {START} AND slot < {AT} GROUP BY symbol),
k AS (SELECT unnest(['bootstrap', 'recovery']) AS purpose, unnest(['unknown_failure_or_fence', 'unknown_post_bootstrap']) AS unknown),
r AS (SELECT purpose, c_custkey AS symbol, CASE WHEN c_custkey % 17 = 0 OR c_custkey % 13 = 0 OR c_custkey % 11 = 0 OR c_custkey % 7 = 0 OR NOT (c_custkey % 3 <> 0 OR coalesce(before, 0) = {FENCE - START}) THEN unknown
  WHEN n IS NULL THEN 'no_print_through_t' ELSE 'none' END AS consequence FROM k, customer LEFT JOIN m ON symbol = c_custkey WHERE c_acctbal > 0)"""


def _reconciled(spark: SparkSession, sf_dir: str, recovery: bool) -> DataFrame:
    symbols, b, s = _symbols(spark, sf_dir), _users(spark, sf_dir), F.col("symbol")
    known = coverage.islands(b.where(F.col("slot") < FENCE)).unionByName(_interval(symbols.where(s % 3 != 0), START, FENCE))
    conflicts = _interval(symbols.where(s % 7 == 0), START + 5, START + 9)
    invalid = symbols.where(s % 11 == 0).withColumn("slot", F.lit(AT - 10).cast("bigint"))
    outcome = F.when(s % 13 == 0, "failed").when(s % 19 == 0, "not_needed").otherwise("complete")
    requests = symbols.where(s % 17 != 0).withColumn("outcome", outcome)
    universe = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("symbol"))
    return coverage.reconciled(universe, requests, known, conflicts, invalid, b, START, FENCE, AT, recovery)


@query(f"WITH {RECONCILED} SELECT * FROM r")
def fence_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last day's history means for each user with a valid prior close, at the start and after a gap."""
    both = [_reconciled(spark, sf_dir, recovery).select(F.lit(name).alias("purpose"), "symbol", "consequence") for name, recovery in (("bootstrap", False), ("recovery", True))]
    return both[0].unionByName(both[1])


@query(f"WITH {RECONCILED} SELECT purpose, count(*) FILTER (consequence LIKE 'unknown%') AS n_unknown, n_unknown = 0 OR purpose = 'bootstrap' AS reconciled FROM r GROUP BY 1")
def fence_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the fence is reconciled then."""
    both = [coverage.settled(_reconciled(spark, sf_dir, recovery), recovery).withColumn("purpose", F.lit(name)) for name, recovery in (("bootstrap", False), ("recovery", True))]
    return both[0].unionByName(both[1])


@query(f"""WITH {bars_cte("user_id")}, m AS (SELECT symbol, max(slot) AS mark FROM bars WHERE slot >= {START} AND slot < {AT} GROUP BY symbol)
SELECT c_custkey AS symbol, CASE WHEN c_custkey % 9 = 0 THEN 'not_applicable' WHEN mark IS NULL THEN 'no_later_eligible_mark' WHEN (c_custkey + mark) % 4 = 0 THEN 'latest_mark_not_live'
  WHEN c_custkey % 5 = 0 AND mark < {AT - 30} THEN 'conflict_at_or_after_mark' WHEN c_custkey % 11 = 0 AND mark <= {AT - 20} THEN 'invalid_at_or_after_mark'
  WHEN mark < {AT - 1} AND NOT (c_custkey % 3 <> 0 AND mark + 1 >= {AT - 100}) THEN 'incomplete_post_mark_coverage' ELSE 'trusted_by_later_live_mark' END AS decision
FROM customer LEFT JOIN m ON symbol = c_custkey""")
def later_mark_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an unknown past, ranked only if all is known from a live mark on."""
    symbols, b, s = _symbols(spark, sf_dir), _users(spark, sf_dir), F.col("symbol")
    known = coverage.merged(coverage.islands(b).unionByName(_interval(symbols.where(s % 3 != 0), AT - 100, AT)))
    conflicts = _interval(symbols.where(s % 5 == 0), AT - 40, AT - 30)
    invalid = symbols.where(s % 11 == 0).withColumn("slot", F.lit(AT - 20).cast("bigint"))
    marks = b.select("symbol", "slot", ((s + F.col("slot")) % 4 != 0).alias("live"))
    return coverage.later_mark_decision(symbols.withColumn("unknown", s % 9 != 0), known, conflicts, invalid, marks, START, AT)


@query(f"""WITH {bars_cte("user_id")}, b AS (SELECT * FROM bars WHERE slot < {AT}), p AS (SELECT symbol, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS prints, min(slot) AS first_slot, arg_min(open, slot) AS first_open,
  max(high) AS high, min(low) AS low, max(slot) AS latest_slot, arg_max(close, slot) AS latest_close FROM b GROUP BY symbol),
w AS (SELECT p.symbol, CAST(sum(b.volume) AS BIGINT) AS less, count(*) AS fewer, bool_or(b.slot = p.first_slot) AS o, bool_or(b.high = p.high OR b.low = p.low) AS e, bool_or(b.slot = p.latest_slot) AS l
  FROM b JOIN p ON b.symbol = p.symbol AND b.slot % 17 = p.symbol % 17 GROUP BY p.symbol)
SELECT p.symbol, volume - coalesce(less, 0) AS volume, prints - coalesce(fewer, 0) AS prints, CASE WHEN NOT coalesce(o, false) THEN first_open END AS first_open, CASE WHEN NOT coalesce(e, false) THEN high END AS high,
  CASE WHEN NOT coalesce(e, false) THEN low END AS low, CASE WHEN NOT coalesce(l, false) THEN latest_close END AS latest_close, NOT coalesce(o, false) AS open_trusted, NOT coalesce(e, false) AS extrema_trusted, NOT coalesce(l, false) AS latest_trusted
FROM p LEFT JOIN w ON w.symbol = p.symbol""")
def withdrawn_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' folded bars after one slot in seventeen was withdrawn."""
    b = _users(spark, sf_dir).where(F.col("slot") < AT)
    gone = b.where(F.col("slot") % 17 == F.col("symbol") % 17).select("symbol", "slot", "volume", "high", "low")
    return bars.without_withdrawn(bars.folded_prefix(b, AT), gone).drop("first_slot", "latest_slot")


@query(f"""WITH {bars_cte()} SELECT symbol, CASE WHEN slot % 3 <> 0 THEN 'unmatched' WHEN slot % 7 = 0 THEN 'different' ELSE 'equal' END AS comparison, count(*) AS n FROM bars GROUP BY 1, 2""")
def sealed_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical bars, of which some differ in their volume, against a third of the slots that were sealed live."""
    b = hourly(spark, sf_dir)
    bar = lambda volume: F.struct("open", "high", "low", "close", volume.alias("volume"), "vwap", "ats")
    historical = b.select("symbol", "slot", bar(F.col("volume") + F.when(F.col("slot") % 7 == 0, 1).otherwise(0)).alias("bar"))
    sealed = b.where(F.col("slot") % 3 == 0).select("symbol", "slot", bar(F.col("volume") + 0).alias("bar"))
    return merge.against_sealed(historical, sealed).groupBy("symbol", "comparison").agg(F.count(F.lit(1)).alias("n"))

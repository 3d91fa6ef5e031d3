"""Registered queries of the population's evaluation, its identities, and the masking by a stale watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators import bars, population, rank
from slotwise.params import GateParams, ScanParams
from slotwise.plans.queries import AT, DAY, HOUR, QUERIES, SQL, START, TICKS, bars_cte, query
from slotwise.sources.tables import read, ticks

GROUP = 1  # customers to a symbol
GATE = GateParams(window=10, short_window=3, min_price=10.0, min_present=9, max_gap=2, min_trades=28.0, min_short_trades=8.0, min_dollar_volume=500.0, max_concentration=0.5)
DAYS = ScanParams(start=START // 24, end=START // 24 + 30, slot_seconds=24 * HOUR, gate=GATE)
HORIZON = 4


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = read(spark, sf_dir, "customer").select(F.expr(f"c_custkey div {GROUP}").alias("symbol")).distinct()
    b = bars.from_ticks(ticks(spark, sf_dir, "user_id").withColumn("symbol", F.expr(f"symbol div {GROUP}")), 24 * HOUR)
    scan = population.scanned(b, DAYS, DAY, DAY, HORIZON)
    s = F.col("symbol")
    priors = people.where(s % 9 != 0).select("symbol", F.when(s % 17 == 0, float("inf")).otherwise(40.0 + s % 20).alias("prior_close"))
    coverage = people.select(
        "symbol", F.when(s % 7 == 0, "post_bootstrap_gap").when(s % 11 == 0, "bootstrap_origin").alias("unknown"), (s % 2 == 0).alias("trusted"), (s % 5 == 0).alias("no_print"), (s % 3 != 0).alias("exact")
    )
    invalid = people.where(s % 4 == 1).select("symbol", F.lit(DAY - 2).alias("slot"))
    return population.evaluated(people, scan, priors, coverage, invalid, DAY, GATE.min_price)


POPULATION = f"""{bars_cte(f"user_id // {GROUP}", 24 * HOUR)}, inside AS (SELECT * FROM bars WHERE slot >= {START // 24} AND slot < {DAY}), ends AS (SELECT DISTINCT symbol, slot + unnest(range(1, 4)) AS "end" FROM inside),
win AS (SELECT e.symbol, e."end", b.* EXCLUDE (symbol), b.slot - lag(b.slot) OVER (PARTITION BY e.symbol, e."end" ORDER BY b.slot) - 1 AS gap FROM ends e JOIN inside b ON b.symbol = e.symbol AND b.slot >= e."end" - 10 AND b.slot < e."end" WHERE e."end" <= {DAY}),
facts AS (SELECT symbol, "end", count(*) AS present, arg_max(close, slot) AS price, CASE WHEN min(ats) > 0 THEN sum(volume / CAST(ats AS DOUBLE)) END AS trades,
  coalesce(sum(volume / nullif(CAST(ats AS DOUBLE), 0)) FILTER (slot >= "end" - 3), 0) AS short_trades, sum(volume * vwap) AS dollars, max(volume) / nullif(CAST(sum(volume) AS DOUBLE), 0) AS concentration,
  greatest(coalesce(max(gap), 0), min(slot) - ("end" - 10), "end" - 1 - max(slot)) AS longest FROM win GROUP BY 1, 2),
ok AS (SELECT symbol, min("end") AS first_pass, max("end") AS last_pass, count(*) AS proofs, min("end") FILTER ({DAY} > "end" + {HORIZON}) AS finalized_at FROM facts
  WHERE price >= 10 AND present >= 9 AND longest <= 2 AND trades >= 28 AND short_trades >= 8 AND dollars >= 500 AND concentration <= 0.5 GROUP BY 1),
m AS (SELECT symbol, arg_max(close, slot) AS last, max(slot) AS slot, CAST(sum(volume) AS DOUBLE) AS volume, arg_min(open, slot) AS first_open, max(high) AS high, min(low) AS low FROM inside GROUP BY 1),
u AS (SELECT DISTINCT c_custkey // {GROUP} AS symbol FROM customer),
j AS (SELECT u.symbol, last, slot, first_pass, finalized_at, u.symbol % 9 <> 0 AS prior, CASE WHEN u.symbol % 9 <> 0 AND u.symbol % 17 <> 0 THEN 100 * (last / (40.0::DOUBLE + u.symbol % 20) - 1) END AS day_pct,
  CASE WHEN u.symbol % 7 = 0 THEN 'post_bootstrap_gap' WHEN u.symbol % 11 = 0 THEN 'bootstrap_origin' END AS unknown FROM u LEFT JOIN m USING (symbol) LEFT JOIN ok USING (symbol)),
b AS (SELECT *, CASE WHEN NOT prior THEN 'invalid_or_missing_prior_close' WHEN unknown IS NOT NULL AND symbol % 2 <> 0 THEN 'unknown_due_failure_or_fence' WHEN last IS NULL AND symbol % 5 = 0 THEN 'no_print_through_t'
  WHEN last IS NULL AND symbol % 4 = 1 THEN 'invalid_mark' WHEN last IS NULL THEN 'unknown_due_failure_or_fence' WHEN last < 10 THEN 'trusted_below_price_mark' ELSE 'trusted_rankable_mark' END AS bucket,
  CASE WHEN finalized_at IS NOT NULL THEN 'finalized' WHEN first_pass IS NOT NULL THEN 'provisional' WHEN symbol % 3 <> 0 THEN 'not_yet_passed' ELSE 'unresolved' END AS q FROM j),
pop AS (SELECT symbol, bucket, CASE WHEN bucket = 'unknown_due_failure_or_fence' THEN CASE WHEN unknown IS NOT NULL AND symbol % 2 <> 0 THEN unknown ELSE 'local_invalid' END WHEN bucket = 'trusted_rankable_mark' AND q = 'unresolved' THEN coalesce(unknown, 'local_invalid') END AS origin,
  CASE WHEN bucket = 'trusted_rankable_mark' THEN q END AS qualification, last, {DAY} - slot - 1 AS mark_age, day_pct, bucket = 'trusted_rankable_mark' AND day_pct IS NOT NULL AS known_rankable,
  bucket = 'trusted_rankable_mark' AND day_pct IS NOT NULL AND q IN ('provisional', 'finalized') AS passer FROM b)"""


@query(f"WITH {POPULATION} SELECT symbol, bucket, origin, qualification, last, CAST(mark_age AS DOUBLE) AS mark_age, round(day_pct, 6) AS day_pct, known_rankable, passer FROM pop")
def population_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's bucket, qualification and rank value, from one pass over the events' bars."""
    return _rows(spark, sf_dir).withColumn("mark_age", F.col("mark_age").cast("double")).withColumn("day_pct", F.round("day_pct", 6))


@query(f"WITH {POPULATION} SELECT m.symbol, CAST(first_pass AS DOUBLE) AS first_pass, CAST(last_pass AS DOUBLE) AS last_pass, coalesce(proofs, 0) AS proofs, CAST(finalized_at AS DOUBLE) AS finalized_at, volume, first_open, high, low, last FROM m LEFT JOIN ok USING (symbol)")
def population_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs, totals and marks of all symbols in one pass."""
    b = bars.from_ticks(ticks(spark, sf_dir, "user_id").withColumn("symbol", F.expr(f"symbol div {GROUP}")), 24 * HOUR)
    scan = population.scanned(b, DAYS, DAY, DAY, HORIZON)
    return scan.select("symbol", *(F.col(c).cast("double").alias(c) for c in ("first_pass", "last_pass")), "proofs", F.col("finalized_at").cast("double").alias("finalized_at"), "volume", "first_open", "high", "low", F.col("mark.close").alias("last"))


def _counts_sql() -> str:
    each = [f"count(*) FILTER (bucket = '{b}') AS {b}" for b in population.BUCKETS] + [f"count(*) FILTER (qualification = '{q}') AS {q}" for q in population.QUALIFICATIONS] + [f"count(*) FILTER (origin = '{o}') AS {o}" for o in population.ORIGINS]
    return f"""SELECT count(*) AS universe_total, {", ".join(each)}, count(*) FILTER (passer) AS total_passers, count(*) FILTER (known_rankable) AS known_rankable,
  count(*) FILTER (bucket = 'trusted_rankable_mark' AND NOT known_rankable) AS day_invalid, count(*) FILTER (qualification IN ('provisional', 'finalized') AND NOT known_rankable) AS qualified_day_invalid FROM pop"""


@query(f"""WITH {POPULATION} SELECT *, CASE WHEN known_rankable > 0 AND unknown_due_failure_or_fence + unresolved > 0 THEN 'degraded_current' WHEN unknown_due_failure_or_fence + unresolved = 0 THEN 'qualified_current' ELSE 'unavailable' END AS mode,
  CASE WHEN unknown_due_failure_or_fence + unresolved = 0 THEN '' WHEN known_rankable = 0 THEN 'no_trusted_marks' WHEN unknown_due_failure_or_fence <> 0 THEN 'incomplete_population' ELSE 'qualification_pending' END AS reason FROM ({_counts_sql()})""")
def population_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols fell where, with passers, unsound days and origins of uncertainty."""
    return population.accounting(_rows(spark, sf_dir))


@query(f"""WITH {POPULATION}, c AS (SELECT * FROM ({_counts_sql()})) SELECT x AS "check", n FROM (SELECT unnest(['accounting.population', 'accounting.rankable']) AS x, 1 AS n) WHERE (SELECT trusted_rankable_mark FROM c) > 0
UNION ALL SELECT 'accounting.qualification', 1 FROM c WHERE trusted_rankable_mark > 0""")
def evaluation_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that fail: none for the evaluation itself, and those that a copy with a bucket lost must break."""
    counts = population.accounting(_rows(spark, sf_dir))
    sound = population.broken_identities(counts)
    broken = population.broken_identities(counts.withColumn("trusted_rankable_mark", F.lit(0).cast("bigint")))
    return sound.unionByName(broken).groupBy("check").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(f"""WITH f AS (SELECT * FROM ({SQL["measurement_fields"]})), planted AS (SELECT symbol, name, status, 'no_mark' AS reason, value FROM f WHERE name = 'volume'
  UNION ALL SELECT symbol, name, 'current', '', CAST(NULL AS DOUBLE) FROM f WHERE name = 'move' UNION ALL SELECT symbol, name, 'warming', 'rolling_warmup', CAST('infinity' AS DOUBLE) FROM f WHERE name = 'from_open')
SELECT symbol, name, 'status_reason' AS "check" FROM planted WHERE name = 'volume' UNION ALL SELECT symbol, name, 'value_presence' FROM planted WHERE name IN ('move', 'from_open') UNION ALL SELECT symbol, name, 'value_finite' FROM planted WHERE name = 'from_open'""")
def closed_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose status, reason and value do not go together: none that are measured, and those planted in copies."""
    fields = QUERIES["measurement_fields"](spark, sf_dir)
    wrong = fields.where("name = 'volume'").withColumn("reason", F.lit("no_mark"))
    absent = fields.where("name = 'move'").withColumns({"status": F.lit("current"), "reason": F.lit(""), "value": F.lit(None).cast("double")})
    endless = fields.where("name = 'from_open'").withColumns({"status": F.lit("warming"), "reason": F.lit("rolling_warmup"), "value": F.lit(float("inf"))})
    return population.open_tuples(fields.unionByName(wrong).unionByName(absent).unionByName(endless)).select("symbol", "name", "check")


@query(f"""WITH f AS (SELECT * FROM ({SQL["feature_contingency"]})), t AS (SELECT count(DISTINCT event_type) AS n FROM events)
SELECT name, n AS pairs, n + 1 AS statuses, n AS reasons FROM (SELECT DISTINCT name FROM f WHERE name IN ('volume', 'move')) CROSS JOIN t""")
def contingency_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements whose marginals do not add up to the universe: those with one symbol counted twice in a status."""
    fields = QUERIES["feature_contingency"](spark, sf_dir)
    total = read(spark, sf_dir, "events").agg(F.countDistinct("event_type").alias("total"))
    first = F.min("status").over(rank.Window.partitionBy("name"))
    twice = F.col("name").isin("volume", "move") & F.col("status").isNotNull() & F.col("reason").isNull() & (F.col("status") == first)
    planted = fields.withColumn("n", F.col("n") + twice.cast("int"))
    sums = population.unreconciled(planted, -1).join(F.broadcast(total))  # one row
    return sums.where("pairs <> total or statuses <> total or reasons <> total").select("name", "pairs", "statuses", "reasons")


@query(f"""WITH RECURSIVE {TICKS}, s AS (SELECT event_type AS key, seq, sec // {HOUR} AS at, sec // {HOUR} - CASE WHEN price < 30 THEN 9 ELSE 0 END AS w, price > 250 AS stale, size % 101 <> 0 AS ready, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS rn FROM ticks),
f AS (SELECT key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, false AS hold, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS boundary FROM (SELECT DISTINCT key FROM s)
  UNION ALL SELECT f.key, s.rn, s.seq,
    CASE WHEN s.stale THEN true WHEN f.hold AND s.ready THEN NOT (f.since IS NOT NULL AND s.at - f.since >= 5 AND s.w >= f.boundary + 5) ELSE f.hold END,
    CASE WHEN s.stale THEN NULL WHEN f.hold AND s.ready THEN coalesce(f.since, s.at) WHEN f.hold THEN NULL ELSE f.since END,
    CASE WHEN s.stale THEN NULL WHEN f.hold AND s.ready THEN CASE WHEN f.since IS NULL THEN s.w ELSE f.boundary END WHEN f.hold THEN NULL ELSE f.boundary END
  FROM f JOIN s ON s.key = f.key AND s.rn = f.rn + 1)
SELECT key, seq, hold FROM f WHERE rn > 0""")
def stale_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots of each type's service: masked from a stale watermark until it has moved for five hours."""
    hour = F.expr(f"sec div {HOUR}")
    snapshots = ticks(spark, sf_dir).select(
        F.col("symbol").alias("key"), "seq", hour.alias("sampled_s"), (F.col("price") > 250).alias("stale"), (F.col("size") % 101 != 0).alias("ready"), (hour - F.when(F.col("price") < 30, 9).otherwise(0)).alias("watermark_s")
    )
    return population.masked_by_stale_watermark(snapshots).select("key", "seq", "hold")

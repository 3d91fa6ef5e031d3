"""The registered queries: each operator over the event tables, with the SQL that must give the same rows.

Events become hourly bars; a session is January 2024 (720 slots), evaluated as of its slot 600. Symbols
are event types, or users where a query needs many of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.functions import scalars
from slotwise.operators import asof, bars, coverage, dims, features, gate, merge, rank, status, tape
from slotwise.params import GateParams, ScanParams
from slotwise.sources.folders import shared_folder
from slotwise.sources.tables import epoch_seconds, read, ticks
from slotwise.streaming import scan

HOUR = 3600
START = 473_352  # 2024-01-01T00 in hours since 1970
AT = START + 600
GATE = GateParams(min_trades=60.0, min_short_trades=5.0, min_dollar_volume=10_000.0)
PARAMS = ScanParams(start=START, end=START + 720, slot_seconds=HOUR, gate=GATE)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.from_ticks(ticks(spark, sf_dir), HOUR)


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.from_ticks(ticks(spark, sf_dir, "user_id"), 24 * HOUR)


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


TICKS = """ticks AS (
  SELECT event_id AS seq, event_type, user_id, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size,
         CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"""


def bars_cte(symbol: str = "event_type", width: int = HOUR) -> str:
    return f"""{TICKS}, bars AS (
  SELECT {symbol} AS symbol, sec // {width} AS slot, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
         CAST(sum(size) AS BIGINT) AS volume, CAST(count(*) AS BIGINT) AS n, sum(price * size) / nullif(CAST(sum(size) AS DOUBLE), 0) AS vwap,
         CAST(sum(size) // count(*) AS BIGINT) AS ats
  FROM ticks WHERE price > 0 GROUP BY 1, 2)"""


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {bars_cte()} SELECT symbol, slot, open, high, low, close, volume, n, round(vwap + 1e-9, 6) AS vwap, ats FROM bars")
def bars_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("symbol", "slot", "open", "high", "low", "close", "volume", "n", F.round(F.col("vwap") + 1e-9, 6).alias("vwap"), "ats")


@query(f"""WITH {bars_cte("user_id")}, judged AS (
  SELECT CASE WHEN slot < {START + 24} OR slot + 1 > {START + 600} THEN 'outside_session' WHEN vwap IS NULL THEN 'price' WHEN volume < 0 THEN 'volume'
              WHEN open < low OR open > high OR close < low OR close > high THEN 'price_order' WHEN ats < 0 THEN 'average_trade_size' ELSE 'valid' END AS reason FROM bars)
SELECT reason, count(*) AS n FROM judged GROUP BY reason""")
def bars_valid_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.from_ticks(ticks(spark, sf_dir, "user_id"), HOUR)
    reason = bars.reject_reason(F.col("slot"), F.col("slot") + 1, F.lit(START + 24), F.lit(START + 600))
    return b.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN NOT (c_acctbal >= 0) THEN 'inactive' WHEN NOT (c_mktsegment <> 'MACHINERY') THEN 'other_market' WHEN NOT (n_regionkey IN (0, 1, 2)) THEN 'other_locale'
  WHEN NOT (c_custkey % 3 <> 0) THEN 'other_type' ELSE 'eligible' END AS bucket, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def universe_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nations are a table of 25 rows.
    people = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    records = people.select(
        (F.col("c_acctbal") >= 0).alias("active"), F.when(F.col("c_mktsegment") != "MACHINERY", "stocks").otherwise("other").alias("market"),
        F.when(F.col("n_regionkey").isin(0, 1, 2), "us").otherwise("other").alias("locale"), F.when(F.col("c_custkey") % 3 != 0, "CS").otherwise("ETF").alias("type"),
    )
    return records.groupBy(dims.universe_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


DAY = (START + 600) // 24


def _prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last close of each user's session before the evaluated day; users with an odd number of events twice."""
    closes = user_days(spark, sf_dir).select("symbol", F.col("slot").alias("day"), (F.col("close") - 5).alias("close"))
    return dims.prior_session(closes, F.lit(DAY))


@query(f"""WITH {bars_cte("user_id", 24 * HOUR)}, prior AS (SELECT symbol, arg_max(close - 5, slot) AS close FROM bars WHERE slot < {DAY} GROUP BY symbol)
SELECT c_custkey AS symbol, CASE WHEN p.symbol IS NULL THEN 'missing' WHEN close <= 0 THEN 'invalid' ELSE 'valid' END AS status,
       CASE WHEN close > 0 THEN close END AS close, CASE WHEN p.symbol IS NULL THEN 'absent' WHEN close <= 0 THEN 'nonpositive' ELSE '' END AS reason
FROM customer LEFT JOIN prior p ON c_custkey = p.symbol""")
def prior_close_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    universe = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"))
    return dims.prior_closes(universe, _prior(spark, sf_dir))


@query(f"WITH {bars_cte()} SELECT symbol, slot, CAST(sum(volume) OVER (PARTITION BY symbol ORDER BY slot) AS BIGINT) AS cumulative FROM bars WHERE slot >= {START} AND slot < {AT}")
def session_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = hourly(spark, sf_dir).where((F.col("slot") >= START) & (F.col("slot") < AT))
    return bars.cumulative_volume(inside).select("symbol", "slot", "cumulative")


SESSION = f"""agg AS (
  SELECT symbol, CAST(sum(volume) AS DOUBLE) AS volume, arg_min(open, slot) AS first_open, max(high) AS high, min(low) AS low, arg_max(close, slot) AS last, max(slot) AS last_slot
  FROM bars WHERE slot >= {START} AND slot < {AT} GROUP BY symbol)"""


@query(f"""WITH {bars_cte()}, {SESSION} SELECT symbol, volume, last, round(100 * (last / first_open - 1), 6) AS from_open,
  CASE WHEN high > low THEN round(100 * (last - low) / (high - low), 6) END AS day_range FROM agg""")
def from_open_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = features.session_aggregates(hourly(spark, sf_dir), PARAMS, AT).withColumn("last", F.col("mark.close"))
    opened, position = scalars.percent_change(F.col("last"), F.col("first_open")), scalars.range_position(F.col("last"), F.col("low"), F.col("high"))
    return a.select("symbol", "volume", "last", F.round(opened, 6).alias("from_open"), F.round(position, 6).alias("day_range"))


@query(f"""WITH {bars_cte()}, b AS (SELECT DISTINCT symbol, {START} + 7 * unnest(range(0, 100)) AS boundary FROM bars)
SELECT b.symbol, b.boundary, CAST(m.slot AS DOUBLE) AS mark_slot, m.close AS mark_close FROM b LEFT JOIN bars m
ON m.symbol = b.symbol AND m.slot = (SELECT max(x.slot) FROM bars x WHERE x.symbol = b.symbol AND x.slot < b.boundary)""")
def mark_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir)
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: (F.lit(START) + i * 7).cast("bigint")))
    boundaries = b.select("symbol").distinct().select("symbol", steps.alias("boundary"))
    return asof.marks_before(b, boundaries).withColumn("mark_slot", F.col("mark_slot").cast("double"))


@query(f"""WITH {bars_cte("user_id")}, m AS (SELECT symbol, arg_max(close, slot) AS target, arg_max(close, slot) FILTER (slot < {AT - 30}) AS base FROM bars WHERE slot >= {START} AND slot < {AT} GROUP BY symbol)
SELECT symbol, CASE WHEN base IS NULL OR target IS NULL THEN 'warming' ELSE 'current' END AS status, CASE WHEN base IS NULL THEN 'before_first_print' ELSE '' END AS reason,
       round((target - base) / base * 100, 6) AS move FROM m""")
def move_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = features.session_aggregates(bars.from_ticks(ticks(spark, sf_dir, "user_id"), HOUR), PARAMS, AT)
    base, target = F.col("base_mark.close"), F.col("mark.close")
    known = base.isNotNull() & target.isNotNull()
    return a.select(
        "symbol", F.when(known, "current").otherwise("warming").alias("status"), F.when(base.isNull(), "before_first_print").otherwise("").alias("reason"),
        F.round(scalars.percent_move(target, base), 6).alias("move"),
    )


@query(f"""WITH {bars_cte()}, k AS (SELECT unnest(range(0, 55)) AS k), s AS (SELECT DISTINCT symbol FROM bars WHERE slot >= {AT - 330} AND slot < {AT}),
refs AS (SELECT s.symbol, k.k, coalesce(sum(b.volume), 0) / 30.0 AS mean FROM s CROSS JOIN k LEFT JOIN bars b ON b.symbol = s.symbol AND b.slot >= {AT} - 60 - 5 * k.k AND b.slot < {AT} - 30 - 5 * k.k GROUP BY 1, 2),
tgt AS (SELECT s.symbol, coalesce(sum(b.volume), 0) / 30.0 AS target FROM s LEFT JOIN bars b ON b.symbol = s.symbol AND b.slot >= {AT - 30} AND b.slot < {AT} GROUP BY 1)
SELECT symbol, round(target, 6) AS target, round(100.0 * count(*) FILTER (mean <= target) / 55, 6) AS percentile FROM refs JOIN tgt USING (symbol) GROUP BY symbol, target""")
def activity_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.activity_percentile(hourly(spark, sf_dir), PARAMS, AT).select("symbol", *r6("target", "percentile"))


FACTS = f"""inside AS (SELECT * FROM bars WHERE slot >= {START} AND slot < {AT}), ends AS (SELECT DISTINCT symbol, slot + unnest(range(1, 5)) AS "end" FROM inside),
win AS (SELECT e.symbol, e."end", b.*  EXCLUDE (symbol), b.slot - lag(b.slot) OVER (PARTITION BY e.symbol, e."end" ORDER BY b.slot) - 1 AS gap
  FROM ends e JOIN inside b ON b.symbol = e.symbol AND b.slot >= e."end" - 60 AND b.slot < e."end" WHERE e."end" <= {AT}),
facts AS (SELECT symbol, "end", count(*) AS present, arg_max(close, slot) AS price,
  CASE WHEN min(ats) > 0 THEN sum(volume / CAST(ats AS DOUBLE)) END AS trades,
  CASE WHEN count(*) FILTER (slot >= "end" - 5 AND ats <= 0) = 0 THEN coalesce(sum(volume / nullif(CAST(ats AS DOUBLE), 0)) FILTER (slot >= "end" - 5), 0) END AS short_trades,
  sum(volume * vwap) AS dollar_volume, max(volume) / nullif(CAST(sum(volume) AS DOUBLE), 0) AS concentration,
  CAST(greatest(coalesce(max(gap), 0), min(slot) - ("end" - 60), "end" - 1 - max(slot)) AS BIGINT) AS longest_gap FROM win GROUP BY symbol, "end")"""
PASS = "price >= 0.25 AND present >= 45 AND longest_gap <= 3 AND trades >= 60 AND short_trades >= 5 AND dollar_volume >= 10000 AND concentration <= 0.5"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate_facts(hourly(spark, sf_dir), GATE, START, AT)


@query(f"""WITH {bars_cte()}, {FACTS} SELECT symbol, "end", present, price, round(trades, 6) AS trades, round(short_trades, 6) AS short_trades, round(dollar_volume, 4) AS dollar_volume,
  round(concentration, 6) AS concentration, longest_gap FROM facts""")
def gate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    return f.select("symbol", "end", "present", "price", *r6("trades", "short_trades"), F.round("dollar_volume", 4).alias("dollar_volume"), *r6("concentration"), "longest_gap")


@query(f'WITH {bars_cte()}, {FACTS} SELECT symbol, "end", present, longest_gap FROM facts WHERE {PASS}')
def gate_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).where(gate.passes(GATE)).select("symbol", "end", "present", "longest_gap")


@query(f'WITH {bars_cte()}, {FACTS} SELECT symbol, min("end") AS first_pass, max("end") AS last_pass, count(*) AS proofs, CAST(min("end") FILTER ({AT} > "end" + 16) AS DOUBLE) AS finalized_at FROM facts WHERE {PASS} GROUP BY symbol')
def gate_first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.first_pass(_facts(spark, sf_dir), GATE, AT, 16).withColumn("finalized_at", F.col("finalized_at").cast("double"))


LAST = f"""p AS (SELECT symbol, arg_max(close, slot) AS prior FROM bars WHERE slot < {DAY - 3} GROUP BY symbol),
l AS (SELECT symbol, arg_max(close, slot) AS last FROM bars WHERE slot >= {DAY - 3} AND slot < {DAY} GROUP BY symbol)"""


def _day_pct(spark: SparkSession, sf_dir: str, until: int = DAY) -> DataFrame:
    return day_pct_of(user_days(spark, sf_dir), until)


def day_pct_of(b: DataFrame, until: int) -> DataFrame:
    """Symbols by percent change of the last close in the three days before ``until`` from the close before."""
    prior = F.max_by("close", F.when(F.col("slot") < until - 3, F.col("slot")))
    last = F.max_by("close", F.when((F.col("slot") >= until - 3) & (F.col("slot") < until), F.col("slot")))
    marks = b.groupBy("symbol").agg(prior.alias("prior"), last.alias("last"))
    return marks.select("symbol", "prior", "last", scalars.percent_change(F.col("last"), F.col("prior")).alias("day_pct"))


@query(f"""WITH {bars_cte("user_id", 24 * HOUR)}, {LAST}, d AS (SELECT symbol, last, 100.0 * (last / prior - 1.0) AS day_pct FROM p JOIN l USING (symbol))
SELECT CAST(row_number() OVER (ORDER BY day_pct DESC, symbol) AS INTEGER) AS rank, symbol, last, round(day_pct, 6) AS day_pct FROM d ORDER BY day_pct DESC, symbol LIMIT 20""")
def rank_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top_ranked(_day_pct(spark, sf_dir), "day_pct").select("rank", "symbol", "last", *r6("day_pct"))


def _ranked_sql(until: int, name: str) -> str:
    return f"""{name} AS (SELECT symbol, CAST(row_number() OVER (ORDER BY day_pct DESC, symbol) AS INTEGER) AS rank FROM (
      SELECT symbol, 100.0 * (arg_max(close, slot) FILTER (slot >= {until - 3} AND slot < {until}) / arg_max(close, slot) FILTER (slot < {until - 3}) - 1.0) AS day_pct FROM bars GROUP BY symbol)
      WHERE day_pct IS NOT NULL ORDER BY day_pct DESC, symbol LIMIT 20)"""


@query(f"""WITH {bars_cte("user_id", 24 * HOUR)}, {_ranked_sql(DAY, "a")}, {_ranked_sql(DAY - 1, "b")}
SELECT a.symbol, a.rank, CAST(b.rank AS DOUBLE) AS rank_before, CASE WHEN b.rank IS NULL THEN 'NEW' WHEN b.rank - a.rank >= 5 THEN '+5' WHEN b.rank - a.rank <= -5 THEN '-5'
  WHEN b.rank > a.rank THEN '+' || (b.rank - a.rank) ELSE CAST(b.rank - a.rank AS VARCHAR) END AS movement FROM a LEFT JOIN b ON a.symbol = b.symbol""")
def rank_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = rank.top_ranked(_day_pct(spark, sf_dir), "day_pct").select("symbol", "rank")
    history = None
    for day in (DAY - 1, DAY - 4):
        one = rank.top_ranked(_day_pct(spark, sf_dir, day), "day_pct").select(F.lit(day).alias("at"), "symbol", "rank")
        history = one if history is None else history.unionByName(one)
    joined = asof.nearest(now, history, DAY - 1, 2)
    moved = joined.withColumn("movement", rank.movement(F.col("rank"), F.col("rank_before")))
    return moved.withColumn("rank_before", F.col("rank_before").cast("double"))


@query(f"""WITH {bars_cte("user_id", 24 * HOUR)}, {LAST}
SELECT CASE WHEN p.prior IS NULL OR p.prior <= 0 THEN 'invalid_or_missing_prior_close' WHEN c_custkey % 7 = 0 THEN 'unknown_due_failure_or_fence'
  WHEN l.last IS NULL AND c_custkey % 5 = 0 THEN 'no_print_through_t' WHEN l.last IS NULL AND c_custkey % 5 = 1 THEN 'invalid_mark' WHEN l.last IS NULL THEN 'unknown_due_failure_or_fence'
  WHEN l.last < 20 THEN 'trusted_below_price_mark' ELSE 'trusted_rankable_mark' END AS bucket, count(*) AS n
FROM customer LEFT JOIN p ON c_custkey = p.symbol LEFT JOIN l ON c_custkey = l.symbol GROUP BY 1""")
def population_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    universe = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"))
    rows = universe.join(_day_pct(spark, sf_dir), "symbol", "left")
    bucket = rank.population_bucket(
        F.coalesce(F.col("prior") > 0, F.lit(False)), F.col("symbol") % 7 != 0, F.col("last"), F.col("symbol") % 5 == 0, F.col("symbol") % 5 == 1, 20.0
    )
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _coverage(spark: SparkSession, sf_dir: str, b: DataFrame) -> DataFrame:
    """Present slots, and the first twenty hours of each day as proven absent where no bar is."""
    days = F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.struct((F.lit(START) + i * 24).alias("a"), (F.lit(START) + i * 24 + 20).alias("b"))))
    fenced = b.select("symbol").distinct().select("symbol", days.alias("d")).select("symbol", F.col("d.a").cast("bigint").alias("a"), F.col("d.b").cast("bigint").alias("b"))
    return coverage.merged(coverage.islands(b).unionByName(fenced))


@query(f"""WITH {bars_cte()}, g AS (SELECT symbol, slot, slot - row_number() OVER (PARTITION BY symbol ORDER BY slot) AS run FROM bars)
SELECT symbol, min(slot) AS a, max(slot) + 1 AS b FROM g GROUP BY symbol, run""")
def coverage_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.islands(hourly(spark, sf_dir))


@query(f"""WITH {bars_cte()}, spans AS (SELECT DISTINCT symbol, {START} + 48 * i AS lo, {START} + 48 * i + 13 * (i % 4 + 1) AS hi FROM bars, (SELECT unnest(range(0, 14)) AS i)),
slots AS (SELECT s.symbol, s.lo, s.hi, unnest(range(s.lo, s.hi)) AS slot FROM spans s)
SELECT s.symbol, lo, hi, count(*) FILTER (b.slot IS NOT NULL OR (s.slot - {START}) % 24 < 20) AS covered,
  bool_and(b.slot IS NOT NULL OR (s.slot - {START}) % 24 < 20) AND NOT bool_or(s.slot >= {START + 100} AND s.slot < {START + 110}) AS exact,
  bool_or(s.slot >= {START + 100} AND s.slot < {START + 110}) AS conflicted
FROM slots s LEFT JOIN bars b ON b.symbol = s.symbol AND b.slot = s.slot GROUP BY 1, 2, 3""")
def coverage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir)
    names = b.select("symbol").distinct()
    spans = names.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("i")).select(
        "symbol", (F.lit(START) + F.col("i") * 48).cast("bigint").alias("lo"), (F.lit(START) + F.col("i") * 48 + 13 * (F.col("i") % 4 + 1)).cast("bigint").alias("hi")
    )
    conflicts = names.select("symbol", F.lit(START + 100).cast("bigint").alias("a"), F.lit(START + 110).cast("bigint").alias("b"))
    return coverage.covered(_coverage(spark, sf_dir, b), conflicts, spans)


@query(f"""WITH {bars_cte()}, d AS (SELECT DISTINCT symbol, {START} + 24 * i + h AS slot FROM bars, (SELECT unnest(range(0, 30)) AS i), (SELECT unnest(range(0, 20)) AS h)),
left_ AS (SELECT symbol, slot FROM d EXCEPT SELECT symbol, slot FROM bars), g AS (SELECT *, slot - row_number() OVER (PARTITION BY symbol ORDER BY slot) AS run FROM left_)
SELECT symbol, min(slot) AS a, max(slot) + 1 AS b FROM g GROUP BY symbol, run""")
def absence_minus_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir)
    days = F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: (F.lit(START) + i * 24).cast("bigint")))
    fenced = b.select("symbol").distinct().select("symbol", days.alias("a")).withColumn("b", F.col("a") + 20)
    return coverage.subtracted(fenced, coverage.islands(b))


@query(f"""WITH {bars_cte()}, s AS (SELECT DISTINCT symbol, {START} + unnest(range(0, 720)) AS slot FROM bars)
SELECT s.symbol, CASE WHEN s.slot >= {START + 100} AND s.slot < {START + 110} THEN 'conflict' WHEN b.slot IS NOT NULL THEN 'present' WHEN (s.slot - {START}) % 24 < 20 THEN 'proven_absent' ELSE 'unknown' END AS class,
  count(*) AS n FROM s LEFT JOIN bars b ON b.symbol = s.symbol AND b.slot = s.slot GROUP BY 1, 2""")
def coverage_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir)
    names = b.select("symbol").distinct()
    slots = names.select("symbol", F.explode(F.sequence(F.lit(START).cast("bigint"), F.lit(START + 719).cast("bigint"))).alias("slot"))
    days = F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: (F.lit(START) + i * 24).cast("bigint")))
    fenced = names.select("symbol", days.alias("a")).withColumn("b", F.col("a") + 20)
    conflict = names.select("symbol", F.lit(START + 100).cast("bigint").alias("a"), F.lit(START + 110).cast("bigint").alias("b"))
    return coverage.slot_class(coverage.islands(b), fenced, conflict, slots).groupBy("symbol", "class").agg(F.count(F.lit(1)).alias("n"))


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Names, bars, covered slots, conflicts and invalid slots of the hourly bars."""
    b = hourly(spark, sf_dir)
    names = b.select("symbol").distinct()
    conflicts = names.where("symbol = 'click'").select("symbol", F.lit(START + 100).cast("bigint").alias("a"), F.lit(START + 110).cast("bigint").alias("b"))
    invalid = names.where("symbol = 'error'").select("symbol", F.lit(AT - 100).cast("bigint").alias("slot"))
    return names, b, _coverage(spark, sf_dir, b), conflicts, invalid


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _evidence(spark, sf_dir)
    priors = found[1].groupBy("symbol").agg(F.min_by("close", "slot").alias("prior_close")).where("symbol <> 'view'")
    return features.measurements(*found, priors, PARAMS, AT)


# The same ladders over flags counted slot by slot: covered = a bar or an hour before 20; 'click' is in
# conflict on slots 100 to 109, 'error' has a rejected bar at T - 100, 'view' has no prior close.
MEASURED = f"""{SESSION}, pr AS (SELECT symbol, arg_min(close, slot) AS prior FROM bars WHERE symbol <> 'view' GROUP BY symbol),
fl AS (SELECT symbol, min(slot) AS first_slot, arg_max(slot, slot) AS mark_slot, arg_max(slot, slot) FILTER (slot < {AT - 30}) AS base_slot, arg_max(close, slot) FILTER (slot < {AT - 30}) AS base FROM bars WHERE slot >= {START} AND slot < {AT} GROUP BY symbol),
sl AS (SELECT DISTINCT symbol, {START} + unnest(range(0, 600)) AS slot FROM bars),
cv AS (SELECT sl.symbol, sl.slot, b.slot IS NOT NULL OR (sl.slot - {START}) % 24 < 20 AS ok FROM sl LEFT JOIN bars b ON b.symbol = sl.symbol AND b.slot = sl.slot),
tr AS (SELECT cv.symbol, bool_and(ok) AS s_ok, coalesce(bool_and(ok) FILTER (slot >= {AT - 330}), true) AS a_ok, coalesce(bool_and(ok) FILTER (slot < first_slot), true) AS o_ok,
  coalesce(bool_and(ok) FILTER (slot > mark_slot), true) AS m_ok, coalesce(bool_and(ok) FILTER (slot > base_slot AND slot < {AT - 30}), true) AS b_ok FROM cv JOIN fl USING (symbol) GROUP BY cv.symbol),
ms AS (SELECT *, symbol = 'click' AS c, symbol = 'error' AS bad FROM agg JOIN fl USING (symbol) JOIN tr USING (symbol) LEFT JOIN pr USING (symbol)),
fields AS (
  SELECT symbol, 'volume' AS name, CASE WHEN bad OR c THEN 'invalid' WHEN NOT s_ok THEN 'unavailable' ELSE 'current' END AS status,
    CASE WHEN bad THEN 'invalid_input' WHEN c THEN 'historical_conflict' WHEN NOT s_ok THEN 'history_incomplete' ELSE '' END AS reason, volume AS value FROM ms
  UNION ALL SELECT symbol, 'from_close', CASE WHEN prior IS NULL OR prior <= 0 THEN 'unavailable' WHEN bad AND {AT - 100} > mark_slot THEN 'invalid' ELSE 'current' END,
    CASE WHEN prior IS NULL OR prior <= 0 THEN 'prior_close_unavailable' WHEN bad AND {AT - 100} > mark_slot THEN 'invalid_input' ELSE '' END, 100 * (last / prior - 1) FROM ms
  UNION ALL SELECT symbol, 'from_open', CASE WHEN bad AND {AT - 100} > mark_slot THEN 'invalid' WHEN NOT o_ok THEN 'unavailable' ELSE 'current' END,
    CASE WHEN bad AND {AT - 100} > mark_slot THEN 'invalid_input' WHEN NOT o_ok THEN 'history_incomplete' ELSE '' END, 100 * (last / first_open - 1) FROM ms
  UNION ALL SELECT symbol, 'day_range', CASE WHEN bad OR c THEN 'invalid' WHEN NOT s_ok OR high = low THEN 'unavailable' ELSE 'current' END,
    CASE WHEN bad THEN 'invalid_input' WHEN c THEN 'historical_conflict' WHEN NOT s_ok THEN 'history_incomplete' WHEN high = low THEN 'zero_width' ELSE '' END, 100 * (last - low) / nullif(high - low, 0) FROM ms
  UNION ALL SELECT symbol, 'move', CASE WHEN bad AND {AT - 100} > coalesce(base_slot, -1) THEN 'invalid' WHEN base IS NULL THEN 'warming' WHEN NOT b_ok OR NOT m_ok THEN 'unavailable' ELSE 'current' END,
    CASE WHEN bad AND {AT - 100} > coalesce(base_slot, -1) THEN 'invalid_input' WHEN base IS NULL THEN 'before_first_print' WHEN NOT b_ok OR NOT m_ok THEN 'history_incomplete' ELSE '' END, (last - base) / base * 100 FROM ms)"""
FIELDS = ("volume", "from_close", "from_open", "day_range", "move")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("f")) for n in FIELDS)))
    return _measured(spark, sf_dir).select("symbol", each.alias("e")).select("symbol", "e.name", "e.f.status", "e.f.reason", F.round("e.f.value", 6).alias("value"))


@query(f"WITH {bars_cte()}, {MEASURED} SELECT symbol, name, status, reason, CASE WHEN status = 'current' THEN round(value, 6) END AS value FROM fields")
def measurement_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir)


@query(f"WITH {bars_cte()}, {MEASURED} SELECT name, status, reason, count(*) AS n FROM fields GROUP BY GROUPING SETS ((name, status, reason), (name, status), (name, reason), (name))")
def feature_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.contingency(_fields(spark, sf_dir))


MODES = """modes AS (SELECT o_orderpriority AS case_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'hydrating' WHEN o_orderpriority LIKE '5%' THEN 'bootstrapping' ELSE 'live' END AS lifecycle,
  count(*) FILTER (o_orderstatus = 'P') AS unknown, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority NOT LIKE '3%') AS unresolved,
  count(*) FILTER (o_orderstatus = 'O') AS rankable, o_orderpriority LIKE '1%' AS boot FROM orders GROUP BY o_orderpriority)"""


@query(f"""WITH {MODES} SELECT case_id, CASE WHEN case_id LIKE '2%' THEN 'stale' WHEN lifecycle NOT IN ('live', 'hydrating') THEN 'unavailable' WHEN unknown = 0 AND unresolved = 0 THEN 'qualified_current'
  WHEN lifecycle = 'hydrating' AND rankable > 0 AND boot THEN 'degraded_bootstrap' WHEN rankable > 0 THEN 'degraded_current' ELSE 'unavailable' END AS mode,
  CASE WHEN case_id LIKE '2%' THEN '' WHEN lifecycle NOT IN ('live', 'hydrating') THEN 'no_committed_watermark' WHEN unknown = 0 AND unresolved = 0 THEN '' WHEN rankable > 0 AND unknown <> 0 THEN 'incomplete_population'
  WHEN rankable > 0 THEN 'qualification_pending' ELSE 'no_trusted_marks' END AS reason FROM modes""")
def ranking_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    lifecycle = F.when(p.startswith("1"), "hydrating").when(p.startswith("5"), "bootstrapping").otherwise("live")
    counts = read(spark, sf_dir, "orders").groupBy(p.alias("case_id"), lifecycle.alias("lifecycle"), p.startswith("1").alias("boot")).agg(
        F.count_if(s == "P").alias("unknown"), F.count_if((s == "F") & ~p.startswith("3")).alias("unresolved"), F.count_if(s == "O").alias("rankable")
    )
    mode = rank.ranking_mode(F.col("lifecycle"), F.col("unknown"), F.col("unresolved"), F.col("rankable"), F.col("boot"), F.col("case_id").startswith("2"))
    return counts.select("case_id", mode.alias("m")).select("case_id", "m.mode", "m.reason")


DELIVERIES = """deliveries AS (SELECT l_partkey AS symbol, CAST(l_linenumber % 3 AS BIGINT) AS slot, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_returnflag = 'N' THEN 'historical' ELSE 'live' END AS source,
  CASE WHEN l_returnflag <> 'N' THEN l_suppkey % 4 END AS position, CAST(l_quantity AS BIGINT) % 3 AS bar, l_orderkey * 10 AS admission_s, l_orderkey * 10 - CASE WHEN l_linestatus = 'F' AND l_tax > 0.06 THEN 1000 WHEN l_tax > 0.07 THEN -5 ELSE 10 END AS end_s FROM lineitem)"""


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions made from order lines: a part is a symbol, its lines are deliveries in order of their order."""
    live = F.col("l_returnflag") != "N"
    admission = F.col("l_orderkey") * 10
    age = F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06), 1000).when(F.col("l_tax") > 0.07, -5).otherwise(10)
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("symbol"), (F.col("l_linenumber") % 3).cast("bigint").alias("slot"), (admission + F.col("l_linenumber")).alias("seq"),
        F.when(live, "live").otherwise("historical").alias("source"), F.when(live, F.col("l_suppkey") % 4).alias("position"),
        F.struct((F.col("l_quantity").cast("bigint") % 3).alias("value")).alias("bar"), admission.alias("admission_s"), (admission - age).alias("end_s"),
    )


MERGED = f"""RECURSIVE {DELIVERIES}, d AS (SELECT *, row_number() OVER (PARTITION BY symbol, slot ORDER BY seq, source, position NULLS FIRST, bar, admission_s, end_s) AS rn FROM deliveries),
f AS (
  SELECT symbol, slot, 0 AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS xb, CAST(NULL AS VARCHAR) AS xs, CAST(NULL AS BIGINT) AS xp, false AS conflict, '' AS outcome FROM (SELECT DISTINCT symbol, slot FROM d)
  UNION ALL
  SELECT symbol, slot, rn, seq,
    CASE WHEN o IN ('inserted', 'revised') THEN bar WHEN o LIKE 'withdrawn%' THEN NULL ELSE xb END,
    CASE WHEN o IN ('inserted', 'revised') OR (o = 'exact_duplicate' AND source = 'live') THEN source WHEN o LIKE 'withdrawn%' THEN NULL ELSE xs END,
    CASE WHEN o IN ('inserted', 'revised') THEN position WHEN o = 'exact_duplicate' AND source = 'live' THEN greatest(xp, position) WHEN o LIKE 'withdrawn%' THEN NULL ELSE xp END,
    CASE WHEN o IN ('inserted', 'revised') AND source = 'live' THEN false WHEN o = 'withdrawn_conflict' THEN true ELSE conflict END, o
  FROM (SELECT f.symbol, f.slot, d.rn, d.seq, d.bar, d.source, d.position, f.xb, f.xs, f.xp, f.conflict,
    CASE WHEN d.end_s > d.admission_s THEN 'rejected:future_event_time'
      WHEN d.source = 'live' AND d.admission_s - d.end_s > 960 AND (f.xb IS NULL OR f.xs <> 'live') THEN 'rejected:too_late'
      WHEN d.source <> 'live' AND f.xb IS NULL AND f.conflict THEN 'rejected:historical_historical_conflict'
      WHEN f.xb = d.bar THEN 'exact_duplicate' WHEN d.source = 'live' AND d.admission_s - d.end_s > 960 THEN 'rejected:too_late'
      WHEN f.xb IS NULL THEN 'inserted' WHEN d.source = 'live' AND f.xs <> 'live' THEN 'revised' WHEN d.source = 'live' AND d.position < f.xp THEN 'rejected:nonprecedent'
      WHEN d.source = 'live' AND d.position = f.xp THEN 'withdrawn_integrity' WHEN d.source = 'live' THEN 'revised' WHEN f.xs = 'live' THEN 'rejected:historical_live_conflict' ELSE 'withdrawn_conflict' END AS o
    FROM f JOIN d ON d.symbol = f.symbol AND d.slot = f.slot AND d.rn = f.rn + 1))"""


@query(f"WITH {MERGED} SELECT symbol, slot, seq, split_part(outcome, ':', 1) AS disposition, split_part(outcome, ':', 2) AS reason FROM f WHERE rn > 0")
def merge_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.dispositions(_deliveries(spark, sf_dir))


@query(f"WITH {MERGED}, z AS (SELECT *, row_number() OVER (PARTITION BY symbol, slot ORDER BY rn DESC) AS back FROM f) SELECT symbol, slot, xs AS source, xb AS value FROM z WHERE back = 1 AND xb IS NOT NULL")
def merge_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.canonical(_deliveries(spark, sf_dir))


@query(f"WITH {MERGED} SELECT split_part(outcome, ':', 1) AS disposition, split_part(outcome, ':', 2) AS reason, count(*) AS n FROM f WHERE rn > 0 GROUP BY 1, 2")
def merge_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.dispositions(_deliveries(spark, sf_dir)).groupBy("disposition", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TICKS}, t AS (SELECT user_id, size, min(seq) AS seq, arg_min(event_type, seq) AS kind, count(*) AS copies, min(event_type) <> max(event_type) AS unequal FROM ticks GROUP BY 1, 2)
SELECT user_id, size, seq, kind, copies, unequal FROM t""")
def trade_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = read(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("size"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return tape.distinct_trades(trades, ["user_id", "size"], ["kind"])


TAPE_WINDOW = 6 * HOUR


@query(f"""WITH {TICKS}, tg AS (SELECT DISTINCT event_type AS symbol, ({START} + 24 * unnest(range(1, 30))) * {HOUR} AS "at" FROM ticks),
c AS (SELECT symbol, "at", CASE WHEN symbol = 'view' THEN NULL WHEN symbol = 'click' THEN "at" - 3 * {HOUR} ELSE {START * HOUR} END AS covered_from FROM tg)
SELECT c.symbol, c."at", CASE WHEN covered_from IS NULL THEN 'unavailable' WHEN "at" - covered_from < {TAPE_WINDOW} THEN 'warming' ELSE 'current' END AS status,
  CASE WHEN covered_from IS NULL THEN 'channel_unconfirmed' WHEN "at" - covered_from < {TAPE_WINDOW} THEN 'five_second_warming' ELSE 'qualifying_original_prints' END AS reason,
  CASE WHEN "at" - covered_from >= {TAPE_WINDOW} THEN round(count(t.seq) / {float(TAPE_WINDOW)}, 9) END AS rate,
  CASE WHEN count(*) FILTER (t.seq % 2 = 0) > 0 AND count(*) FILTER (t.seq % 2 = 1) > 0 THEN 'mixed' WHEN count(*) FILTER (t.seq % 2 = 0) > 0 THEN 'participant' WHEN count(*) FILTER (t.seq % 2 = 1) > 0 THEN 'sip_fallback' ELSE 'none' END AS basis
FROM c LEFT JOIN ticks t ON t.event_type = c.symbol AND t.sec >= c."at" - {TAPE_WINDOW} AND t.sec < c."at" AND t.size % 5 <> 0 GROUP BY c.symbol, c."at", covered_from""")
def tape_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    trades = t.select("symbol", "sec", (F.col("size") % 5 != 0).alias("qualifying"), F.when(F.col("seq") % 2 == 0, "participant").otherwise("sip_fallback").alias("basis"))
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.lit(29)), lambda i: ((F.lit(START) + i * 24) * HOUR).cast("bigint")))
    targets = t.select("symbol").distinct().select("symbol", steps.alias("at"))
    start = F.when(F.col("symbol") == "click", F.col("at") - 3 * HOUR).when(F.col("symbol") != "view", F.lit(START * HOUR)).cast("bigint")
    rates = tape.tape_rate(trades, targets.withColumn("covered_from", start), TAPE_WINDOW)
    return rates.withColumn("rate", F.round("rate", 9))


@query("""WITH q AS (SELECT l_suppkey AS symbol, l_orderkey * 10 + l_linenumber AS seq, l_orderkey AS sec, CASE WHEN l_tax > 0.01 THEN l_extendedprice END AS bid, CASE WHEN l_discount < 0.09 THEN l_extendedprice * (1.02 - l_discount) END AS ask FROM lineitem),
m AS (SELECT symbol, max(seq) AS seq, max(seq) FILTER (ask >= bid) AS valid_seq FROM q GROUP BY symbol), s AS (SELECT q.*, m.valid_seq, 61000 - q.sec AS age0 FROM q JOIN m ON q.symbol = m.symbol AND q.seq = m.seq),
z AS (SELECT *, greatest(age0, 0) AS age1, CASE WHEN bid IS NULL OR ask IS NULL THEN 'unavailable' WHEN ask < bid THEN 'invalid' WHEN greatest(age0, 0) > 46500 THEN 'stale' ELSE 'current' END AS status FROM s)
SELECT symbol, status, CASE status WHEN 'unavailable' THEN 'one_sided_quote' WHEN 'invalid' THEN 'crossed_quote' WHEN 'stale' THEN 'stale_quote' ELSE '' END AS reason, CAST(CASE WHEN status IN ('stale', 'current') THEN age1 END AS DOUBLE) AS age,
  CASE WHEN status IN ('stale', 'current') THEN round(100 * (ask - bid), 4) END AS cents, CASE WHEN status IN ('stale', 'current') THEN round(10000 * (ask - bid) / ((ask + bid) / 2), 4) END AS basis_points, valid_seq FROM z""")
def latest_valid_quote_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    quotes = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_orderkey").alias("sec"),
        F.when(F.col("l_tax") > 0.01, price).alias("bid"), F.when(F.col("l_discount") < 0.09, price * (F.lit(1.02) - F.col("l_discount"))).alias("ask"),
    )
    s = tape.spread(quotes, F.lit(61_000), 46_500)
    return s.withColumn("age", F.col("age").cast("double")).withColumn("cents", F.round("cents", 4)).withColumn("basis_points", F.round("basis_points", 4))


@query("""WITH q AS (SELECT p_partkey, p_size % 7 > 0 AS classified, [p_size - 1, p_size - 3] AS conditions, CASE WHEN p_size % 2 = 0 THEN [p_size] ELSE [] END AS indicators FROM part)
SELECT CASE WHEN NOT classified OR len(list_filter(conditions, lambda x: x <= 0)) > 0 AND p_partkey % 2 = 0 THEN 'unclassified' WHEN p_partkey % 2 = 1 AND len(indicators) = 0 THEN 'reviewed_ordinary' ELSE 'known_special' END AS quality, count(*) AS n FROM q GROUP BY 1""")
def quote_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, none = F.col("p_size"), F.array().cast("array<int>")
    conditions = F.when(F.col("p_partkey") % 2 == 0, F.array(size - 1, size - 3)).otherwise(none)
    indicators = F.when(size % 2 == 0, F.array(size)).otherwise(none)
    quality = scalars.quote_quality(size % 7 > 0, conditions, indicators)
    return read(spark, sf_dir, "part").groupBy(quality.alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT l_orderkey, list(CAST(l_linenumber AS BIGINT) * 3 ORDER BY l_linenumber) AS c FROM lineitem GROUP BY l_orderkey),
e AS (SELECT l_orderkey, list_filter(list_transform(c, lambda x: CASE WHEN x IN (3, 6, 9) THEN NULL WHEN x = 12 THEN 'no_volume' ELSE 'unknown' END), lambda s: s IS NOT NULL) AS s FROM t)
SELECT coalesce(s[1], 'eligible') AS eligibility, count(*) AS n FROM e GROUP BY 1""")
def condition_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(3, True, True), (6, True, True), (9, True, True), (12, False, True), (15, True, False)], "id bigint, updates_volume boolean, reviewed boolean")
    trades = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("bigint") * 3)).alias("c"))
    return trades.groupBy(tape.eligibility(F.col("c"), rules).alias("eligibility")).agg(F.count(F.lit(1)).alias("n"))


def _float_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a float row, of its customer if it is pending and of a symbol outside the universe if not; some have no sound value."""
    shares = F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_totalprice")).when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice"))
    symbol = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")).otherwise(-F.col("o_orderkey"))
    return read(spark, sf_dir, "orders").select(symbol.alias("symbol"), shares.alias("free_float"))


FLOATS = """r AS (SELECT CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE -o_orderkey END AS symbol, CASE WHEN o_orderkey % 7 = 0 THEN -o_totalprice WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS shares FROM orders)"""


@query(f"""WITH {FLOATS}, f AS (SELECT symbol, max(shares) AS free_float FROM r WHERE symbol IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY symbol HAVING count(*) = 1)
SELECT symbol, free_float FROM f WHERE free_float > 0""")
def float_semi_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("symbol"))
    return dims.unambiguous_float(_float_rows(spark, sf_dir), known)


@query(f"""WITH {FLOATS}, f AS (SELECT symbol, max(shares) AS free_float FROM r GROUP BY symbol HAVING count(*) = 1 AND max(shares) > 0)
SELECT c_custkey AS symbol, free_float, CASE WHEN free_float IS NULL THEN 'unavailable' WHEN c_custkey % 2 = 0 THEN 'current' ELSE 'stale' END AS float_status,
  CASE WHEN free_float IS NULL THEN 'not_available' WHEN c_custkey % 2 = 0 THEN '' ELSE 'cached_fallback' END AS float_reason FROM customer LEFT JOIN f ON c_custkey = symbol""")
def float_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    universe = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"))
    floats = dims.unambiguous_float(_float_rows(spark, sf_dir), universe).withColumn("provenance", F.when(F.col("symbol") % 2 == 0, "fresh").otherwise("cached"))
    return dims.float_status(universe, floats).select("symbol", "free_float", "float_status", "float_reason")


@query(f"""WITH {bars_cte("user_id", 24 * HOUR)}, {_ranked_sql(DAY, "a")}, {_ranked_sql(DAY - 1, "b")}
SELECT symbol, 'remove' AS change FROM b WHERE symbol NOT IN (SELECT symbol FROM a) UNION ALL SELECT symbol, 'add' FROM a WHERE symbol NOT IN (SELECT symbol FROM b)""")
def membership_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired = rank.top_ranked(_day_pct(spark, sf_dir), "day_pct").select("symbol")
    members = rank.top_ranked(_day_pct(spark, sf_dir, DAY - 1), "day_pct").select("symbol")
    return rank.membership_changes(desired, members)


@query("""WITH d AS (SELECT o_orderkey * 10 AS admission_s, o_orderkey * 10 - o_custkey % 2000 + 100 AS end_s, o_orderstatus <> 'O' AS live FROM orders)
SELECT CASE WHEN end_s > admission_s THEN 'future_event_time' WHEN live AND admission_s - end_s > 960 THEN 'too_late' ELSE 'mutable' END AS lateness, count(*) AS n FROM d GROUP BY 1""")
def too_late_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    admission = F.col("o_orderkey") * 10
    end = admission - F.col("o_custkey") % 2000 + 100
    lateness = F.when(end > admission, "future_event_time").when((F.col("o_orderstatus") != "O") & (admission - end > PARAMS.correction_seconds), "too_late").otherwise("mutable")
    return read(spark, sf_dir, "orders").groupBy(lateness.alias("lateness")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_retailprice > 0 THEN CASE WHEN v >= 5 THEN 1.0 WHEN v >= 2 THEN 0.8 WHEN v >= 1 THEN 0.6 WHEN v >= 0.5 THEN 0.4 WHEN v >= 0.25 THEN 0.2 ELSE 0.0 END END AS DOUBLE) AS turnover,
  CAST(CASE WHEN f < 2e6 THEN 1.0 WHEN f < 5e6 THEN 0.85 WHEN f < 10e6 THEN 0.65 WHEN f < 20e6 THEN 0.45 WHEN f < 50e6 THEN 0.2 ELSE 0.0 END AS DOUBLE) AS float_size
FROM (SELECT p_partkey, p_retailprice, CAST(p_size AS DOUBLE) * 60 / p_retailprice AS v, p_retailprice * p_size * 1000 AS f FROM part)""")
def turnover_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return read(spark, sf_dir, "part").select(
        "p_partkey", scalars.turnover_intensity(F.col("p_size").cast("double") * 60, price).alias("turnover"), scalars.float_intensity(price * F.col("p_size") * 1000).alias("float_size")
    )


@query(f"""WITH RECURSIVE {bars_cte("event_type", 6 * HOUR)}, s AS (SELECT symbol AS key, slot AS "at", n AS waiting, row_number() OVER (PARTITION BY symbol ORDER BY slot) AS rn FROM bars),
f AS (SELECT key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS "at", 0 AS high, 0 AS full_, 0 AS healthy, 'normal' AS mode FROM (SELECT DISTINCT key FROM s)
  UNION ALL SELECT key, rn, "at", h, u, y, CASE WHEN u >= 3 THEN 'aggregate_only' WHEN mode = 'normal' AND h >= 2 THEN 'degraded' WHEN mode <> 'normal' AND y >= 5 THEN 'normal' ELSE mode END
  FROM (SELECT f.key, s.rn, s."at", f.mode, CASE WHEN s.waiting * 100 >= 40 * 30 THEN f.high + 1 ELSE 0 END AS h, CASE WHEN s.waiting * 100 >= 40 * 45 THEN f.full_ + 1 ELSE 0 END AS u,
    CASE WHEN s.waiting * 100 < 40 * 29 THEN f.healthy + 1 ELSE 0 END AS y FROM f JOIN s ON s.key = f.key AND s.rn = f.rn + 1))
SELECT key, "at", mode FROM f WHERE rn > 0""")
def pressure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.from_ticks(ticks(spark, sf_dir), 6 * HOUR)
    samples = b.select(F.col("symbol").alias("key"), F.col("slot").alias("at"), F.col("n").alias("waiting"), F.lit(40).alias("capacity"))
    return status.pressure_modes(samples, 30, 45, 29).select("key", "at", "mode")


@query("""WITH v AS (SELECT o_orderkey AS id, o_orderkey % 29 > 0 AS a, o_orderkey % 23 = 0 AS b, o_orderkey % 19 > 0 AS c, o_orderkey % 17 > 0 AS d, CASE WHEN o_orderstatus = 'P' THEN 'suppressed' ELSE 'live' END AS l,
  o_orderkey % 13 > 0 AS e, o_orderkey % 11 > 0 AS f, o_orderkey % 7 > 0 AS g, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS w, 1000 AS t, o_orderkey % 3 > 0 AS h FROM orders)
SELECT CASE WHEN NOT a THEN 'runtime_unavailable' WHEN b THEN 'suppressed' WHEN NOT c THEN 'binding_mismatch' WHEN NOT d THEN 'not_live_mode' WHEN l NOT IN ('live', 'hydrating') THEN 'lifecycle' WHEN NOT e THEN 'aggregate_unacknowledged'
  WHEN NOT f THEN 'fence_pending' WHEN NOT g THEN 'ranking_noncurrent' WHEN w IS NULL THEN 'watermark_missing' WHEN t - w > 500 THEN 'watermark_stale' WHEN NOT h THEN 'accounting' ELSE 'none' END AS reason, count(*) AS n FROM v GROUP BY 1""")
def readiness_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    view = read(spark, sf_dir, "orders").select(
        (k % 29 > 0).alias("process_live"), (k % 23 == 0).alias("suppressed"), (k % 19 > 0).alias("binding_matches"), (k % 17 > 0).alias("live_mode"),
        F.when(F.col("o_orderstatus") == "P", "suppressed").otherwise("live").alias("lifecycle"), (k % 13 > 0).alias("acknowledged"), (k % 11 > 0).alias("fence_reconciled"),
        (k % 7 > 0).alias("ranking_current"), F.when(k % 5 > 0, F.col("o_custkey")).alias("watermark"), F.lit(1000).alias("target"), F.lit(500).alias("tolerance"), (k % 3 > 0).alias("accounting_valid"),
    )
    return view.groupBy(status.readiness_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT sha256(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_name, c_mktsegment)) AS h FROM customer), p AS (SELECT h[1:3] AS prefix, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY prefix)) AS identity FROM p""")
def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.content_identity(read(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("""WITH days AS (SELECT CAST(unnest(range(TIMESTAMP '1992-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY)) AS DATE) AS date), td AS (SELECT date FROM days WHERE isodow(date) < 6 AND NOT (month(date) = 12 AND day(date) = 25)),
w AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), z AS (SELECT day, (SELECT min(date) FROM td WHERE date >= day) AS session, (SELECT max(date) FROM td WHERE date < day) AS prior FROM w)
SELECT CAST(day AS VARCHAR) AS day, CAST(session AS VARCHAR) AS session, CAST(prior AS VARCHAR) AS prior, CAST(epoch(timezone('America/New_York', session + INTERVAL 4 HOUR)) AS BIGINT) AS open_s, CAST(epoch(timezone('America/New_York', session + INTERVAL 20 HOUR)) AS BIGINT) AS close_s FROM z""")
def schedule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = [f"{y}-12-25" for y in range(1992, 2002)]
    days = dims.trading_days("1992-01-01", "2001-12-31", closed, [])
    wanted = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    found = asof.next_date(days, wanted)
    open_s, close_s = dims.session_bounds(F.col("session"))
    return found.select(*(F.col(c).cast("string").alias(c) for c in ("day", "session", "prior")), open_s.alias("open_s"), close_s.alias("close_s"))


@query(f"""WITH d AS (SELECT event_type AS family, CAST(floor(epoch(ts)) AS BIGINT) AS event_s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(json_extract_string(props, '$.k') AS BIGINT) AS receipt_s FROM events),
m AS (SELECT family, max(receipt_s) AS newest FROM d GROUP BY family)
SELECT family, round(avg(receipt_s - event_s), 6) AS mean_lag, max(receipt_s - event_s) AS max_lag, max(receipt_s - event_s) FILTER (receipt_s > newest - {24 * HOUR}) AS recent_max_lag, count(*) AS n FROM d JOIN m USING (family) GROUP BY family""")
def delivery_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = epoch_seconds()
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("family"), sec.alias("event_s"), (sec + F.get_json_object("props", "$.k").cast("bigint")).alias("receipt_s"))
    return status.latency(rows, 24 * HOUR).withColumn("mean_lag", F.round("mean_lag", 6))


@query("""SELECT o_orderkey, floor(o_totalprice / (o_custkey + 1)) AS q FROM orders""")
def exact_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = scalars.floor_ratio(F.col("o_totalprice"), F.col("o_custkey") + 1)
    return read(spark, sf_dir, "orders").select("o_orderkey", q.cast("double").alias("q"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS turn FROM events) SELECT user_id, event_id FROM r WHERE turn <= 14""")
def retained_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.latest_ranked(read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 14)


SHARES = "o_totalprice / 99999.7 * power(10, o_orderkey % 14)"


@query(f"""WITH f AS (SELECT o_orderkey, {SHARES} AS v FROM orders),
u AS (SELECT *, CASE WHEN v >= 1e12 THEN 1e12 WHEN v >= 1e9 THEN 1e9 WHEN v >= 1e6 THEN 1e6 WHEN v >= 1e3 THEN 1e3 ELSE 1 END AS unit FROM f),
r AS (SELECT o_orderkey, unit, v, round(v / unit, 1) AS n FROM u)
SELECT o_orderkey, CASE WHEN unit = 1 THEN regexp_replace(regexp_replace(printf('%.2f', v), '0+$', ''), '\\.$', '') WHEN n >= 1000 AND unit < 1e12 THEN '1' || CASE unit WHEN 1e3 THEN 'M' WHEN 1e6 THEN 'B' ELSE 'T' END
  ELSE regexp_replace(printf('%.1f', n), '\\.0$', '') || CASE unit WHEN 1e3 THEN 'K' WHEN 1e6 THEN 'M' WHEN 1e9 THEN 'B' ELSE 'T' END END AS shares FROM r""")
def share_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of every size, from less than a share to trillions."""
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.share_text(F.expr(SHARES)).alias("shares"))


@query(SQL["rank_top20"])
def stream_rank_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of the last micro-batch of a stream over the events: the same rows as the batch query's."""
    def evaluate(log: DataFrame, at: int) -> DataFrame:
        b = bars.from_ticks(log, 24 * HOUR)
        return rank.top_ranked(day_pct_of(b, min(at // (24 * HOUR), DAY)), "day_pct")

    size = F.get_json_object("props", "$.k").cast("bigint")
    stream = scan.event_stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("symbol"), epoch_seconds().alias("sec"), F.col("event_id").alias("seq"), F.col("value").alias("price"), size.alias("size")
    )
    snapshots = scan.SnapshotStream(f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", evaluate, "sec")
    snapshots.start(stream).awaitTermination()
    return snapshots.latest(spark).select("rank", "symbol", "last", *r6("day_pct"))


@query(f"SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) // {6 * HOUR} * {6 * HOUR} AS start_s, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of a stream with a watermark, in update mode: the last update of each window."""
    stream = scan.event_stream(spark, sf_dir, "events").select("event_type", F.timestamp_seconds(epoch_seconds()).alias("at"))
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/updates/batch_id={batch_id}")

    counts = scan.windowed_counts(stream, "event_type", 6 * HOUR, 24 * HOUR)
    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(f"{root}/updates")
    return updates.groupBy("event_type", "start_s").agg(F.max_by("n", "batch_id").alias("n"))


MATURE, SECONDS = 5694, 961


def mature_population(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One evaluation of a full population: 5,694 symbols with 961 generated one-second bars each, two of them empty.

    It reads no table, so that it is timed by the bench but not registered; ``population_evaluation`` is the query.
    """
    i, q = F.col("id") % MATURE, F.floor(F.col("id") / MATURE)  # q seconds after the first bar
    close = F.lit(10.0) + F.pmod(i + q - SECONDS, F.lit(MATURE)) / F.lit(8192.0)
    b = spark.range(MATURE * SECONDS).where(~i.isin(5, 6)).select(
        F.concat(F.lit("S"), F.lpad(i.cast("string"), 4, "0")).alias("symbol"), q.alias("slot"), (close - 1 / 8192.0).alias("open"), (close + 2 / 8192.0).alias("high"),
        (close - 2 / 8192.0).alias("low"), close.alias("close"), (F.lit(1500) + i % 17).alias("volume"),
    )
    a = features.session_aggregates(b, ScanParams(start=0, end=SECONDS), SECONDS).withColumn("last", F.col("mark.close"))
    top = rank.top_ranked(a.withColumn("day_pct", scalars.percent_change(F.col("last"), F.lit(10.0))), "day_pct")
    opened, position = scalars.percent_change(F.col("last"), F.col("first_open")), scalars.range_position(F.col("last"), F.col("low"), F.col("high"))
    return top.select("symbol", "rank", "last", "volume", F.round(opened, 6).alias("from_open"), F.round(position, 6).alias("day_range"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 users by percent change, with volume, from-open, day range and whether their type of event qualifies."""
    ranked = rank.top_ranked(_day_pct(spark, sf_dir), "day_pct")
    b = user_days(spark, sf_dir)
    few = b.join(F.broadcast(ranked.select("symbol")), "symbol", "left_semi")  # 20 symbols
    p = ScanParams(start=START // 24, end=START // 24 + 30, slot_seconds=24 * HOUR, gate=GateParams(window=10, short_window=3, min_present=2, max_gap=9, min_trades=1.0, min_short_trades=0.0, min_dollar_volume=1.0, max_concentration=1.0))
    a = features.session_aggregates(few, p, DAY).withColumn("last_close", F.col("mark.close"))
    facts = gate.first_pass(gate.gate_facts(few, p.gate, p.start, DAY), p.gate, DAY, 1)
    rows = ranked.join(a, "symbol", "left").join(facts.select("symbol", "first_pass"), "symbol", "left")
    return rows.select(
        "rank", "symbol", "last", *r6("day_pct"), "volume", F.round(scalars.percent_change(F.col("last_close"), F.col("first_open")), 6).alias("from_open"),
        F.round(scalars.range_position(F.col("last_close"), F.col("low"), F.col("high")), 6).alias("day_range"), F.col("first_pass").isNotNull().alias("qualified"),
    )


@query(f"""WITH {bars_cte()}, {FACTS}, ok AS (SELECT symbol, min("end") AS first_pass, min("end") FILTER ({AT} > "end" + 16) AS finalized_at FROM facts WHERE {PASS} GROUP BY symbol)
SELECT DISTINCT b.symbol, CASE WHEN finalized_at IS NOT NULL THEN 'finalized' WHEN first_pass IS NOT NULL THEN 'provisional' ELSE 'unresolved' END AS qualification, CAST(first_pass AS DOUBLE) AS first_pass, CAST(finalized_at AS DOUBLE) AS finalized_at FROM bars b LEFT JOIN ok ON b.symbol = ok.symbol""")
def qualification_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir)
    names = b.select("symbol").distinct()
    spans = names.select("symbol", F.lit(START - 1).cast("bigint").alias("lo"), F.lit(AT).cast("bigint").alias("hi"))
    none = spans.select("symbol", F.col("lo").alias("a"), F.col("hi").alias("b")).where("false")
    exact = coverage.covered(_coverage(spark, sf_dir, b), none, spans).select("symbol", "exact")
    found = gate.qualification_status(names, gate.first_pass(gate.gate_facts(b, GATE, START, AT), GATE, AT, 16), exact)
    return found.select("symbol", "qualification", F.col("first_pass").cast("double").alias("first_pass"), F.col("finalized_at").cast("double").alias("finalized_at"))


@query(f"""WITH {bars_cte()} SELECT symbol, slot, CAST(rank() OVER (PARTITION BY symbol ORDER BY volume DESC) AS INTEGER) AS volume_rank,
  CASE WHEN max(volume) OVER (PARTITION BY symbol) > min(volume) OVER (PARTITION BY symbol) THEN round((volume - min(volume) OVER (PARTITION BY symbol)) / CAST(max(volume) OVER (PARTITION BY symbol) - min(volume) OVER (PARTITION BY symbol) AS DOUBLE), 6) END AS scaled FROM bars""")
def scaled_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = Window.partitionBy("symbol")
    low, high = F.min("volume").over(every), F.max("volume").over(every)
    scaled = F.when(high > low, F.round((F.col("volume") - low) / (high - low).cast("double"), 6))
    return hourly(spark, sf_dir).select("symbol", "slot", F.rank().over(every.orderBy(F.col("volume").desc())).alias("volume_rank"), scaled.alias("scaled"))

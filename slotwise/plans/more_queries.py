"""Registered queries of admission, folded prefixes, masked fields, status counts and the clock scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import scalars
from slotwise.operators import admission, bars, features, status
from slotwise.plans.queries import AT, HOUR, MEASURED, QUERIES, SQL, START, TICKS, _measured, bars_cte, hourly, query
from slotwise.sources.tables import epoch_seconds, read, ticks

FROM, TO, COMMITTED, HORIZON = START * HOUR, (START + 700) * HOUR, AT * HOUR, 300 * HOUR


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades whose frames jump back now and then; a third of the users is not selected."""
    e = F.col("seq")
    events = ticks(spark, sf_dir, "user_id").select(
        "symbol", "seq", F.when(e % 50 == 0, 2).otherwise(1).alias("epoch"), (F.floor(e / 8) - F.when(e % 9 == 0, 60).otherwise(0)).alias("frame"),
        (e % 8).alias("idx"), F.col("sec").alias("event_s"), (F.col("sec") + e % 4).alias("received_s"),
    )
    members = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(
        F.col("c_custkey").alias("symbol"), F.lit(1).alias("member_epoch"), (F.col("c_custkey") % 10 * 7).alias("boundary")
    )
    return admission.judged(events, members, FROM, TO, F.lit(COMMITTED), HORIZON)


OUTCOMES = f"""{TICKS}, e AS (SELECT user_id AS symbol, seq, CASE WHEN seq % 50 = 0 THEN 2 ELSE 1 END AS epoch, (seq // 8 - CASE WHEN seq % 9 = 0 THEN 60 ELSE 0 END) * 8 + seq % 8 AS position,
  seq // 8 - CASE WHEN seq % 9 = 0 THEN 60 ELSE 0 END AS frame, sec, sec + seq % 4 AS received FROM ticks),
o AS (SELECT e.*, c_custkey IS NOT NULL AND epoch = 1 AND frame > c_custkey % 10 * 7 AS ours FROM e LEFT JOIN customer ON c_custkey = symbol AND c_custkey % 3 <> 0),
p AS (SELECT *, max(CASE WHEN ours THEN position END) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM o),
outcomes AS (SELECT *, CASE WHEN NOT ours OR position <= reached THEN 'fenced' WHEN sec < {FROM} OR sec >= {TO} OR sec < {COMMITTED - HORIZON} THEN 'rejected' ELSE 'admitted' END AS outcome FROM p)"""


@query(f"WITH {OUTCOMES} SELECT symbol, seq, outcome FROM outcomes")
def tape_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("symbol", "seq", "outcome")


@query(f"WITH {OUTCOMES} SELECT symbol, least(greatest(arg_min(received, seq), {FROM}), {TO}) AS covered_from FROM outcomes WHERE outcome <> 'fenced' GROUP BY symbol")
def tape_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.coverage_starts(_outcomes(spark, sf_dir), FROM, TO)


@query(f"""WITH {bars_cte()} SELECT symbol, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS prints, min(slot) AS first_slot, arg_min(open, slot) AS first_open, max(high) AS high, min(low) AS low,
  max(slot) AS latest_slot, arg_max(close, slot) AS latest_close FROM bars WHERE slot < {AT} GROUP BY symbol""")
def folded_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars folded up to slot 300 and continued to the evaluated one."""
    b = hourly(spark, sf_dir)
    tail = bars.folded_prefix(b.where(F.col("slot") >= START + 300), AT)
    return bars.continued(bars.folded_prefix(b, START + 300), tail)


@query(f"""SELECT symbol, name, CASE WHEN hit THEN 'unavailable' ELSE status END AS status, CASE WHEN hit THEN 'history_incomplete' ELSE reason END AS reason, CASE WHEN NOT hit THEN value END AS value,
  CASE WHEN hit OR status = 'unavailable' THEN 1 WHEN status = 'current' THEN 3 WHEN status = 'warming' THEN 2 ELSE 0 END AS trust, true AS valid
FROM (SELECT *, symbol IN ('click', 'error', 'view') AND (name IN ('from_open', 'day_range') OR name IN ('volume', 'activity', 'move') AND status <> 'invalid') AS hit FROM ({SQL["measurement_fields"]}))""")
def masked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of symbols with unknown coverage, the rank of their trust, and whether status and reason go together."""
    fields = features.without_history(QUERIES["measurement_fields"](spark, sf_dir), F.col("symbol").isin("click", "error", "view"))
    return fields.withColumn("trust", features.trust_rank(F.col("status"))).withColumn("valid", features.pair_valid(F.col("status"), F.col("reason")))


COUNTED = {"prior_close": ("prior_close_facts", "status"), "float": ("float_left_join", "float_status"), "qualification": ("qualification_status", "qualification")}


@query(" UNION ALL ".join(f"SELECT '{family}' AS family, {column} AS status, count(*) AS n FROM ({SQL[name]}) GROUP BY 2" for family, (name, column) in COUNTED.items()))
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols have each status of their prior close, float and qualification."""
    out = None
    for family, (name, column) in COUNTED.items():
        one = QUERIES[name](spark, sf_dir).groupBy(F.lit(family).alias("family"), F.col(column).alias("status")).agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""SELECT r.rank, r.symbol, r.day_pct, coalesce(q.status, 'unselected') AS spread_status, coalesce(q.reason, '') AS spread_reason, q.cents, f.free_float, f.float_status
FROM ({SQL["rank_top20"]}) r LEFT JOIN ({SQL["latest_valid_quote_spread"]}) q ON q.symbol = r.symbol LEFT JOIN ({SQL["float_left_join"]}) f ON f.symbol = r.symbol""")
def enriched_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked rows with their spread and float; a row without a quote is unselected. Only twenty rows are joined."""
    top = F.broadcast(QUERIES["rank_top20"](spark, sf_dir).select("rank", "symbol", "day_pct"))
    spread = QUERIES["latest_valid_quote_spread"](spark, sf_dir).select("symbol", "status", "reason", "cents")
    floats = QUERIES["float_left_join"](spark, sf_dir).select("symbol", "free_float", "float_status")
    joined = top.join(spread.join(F.broadcast(top.select("symbol")), "symbol", "left_semi"), "symbol", "left").join(floats.join(F.broadcast(top.select("symbol")), "symbol", "left_semi"), "symbol", "left")
    return joined.select("rank", "symbol", "day_pct", F.coalesce("status", F.lit("unselected")).alias("spread_status"), F.coalesce("reason", F.lit("")).alias("spread_reason"), "cents", "free_float", "float_status")


STOPS = [(0, "#8F9AA3"), (5, "#8F9AA3"), (15, "#B8793E"), (50, "#E98212"), (100, "#FF8A00")]


def _gradient_sql(value: str) -> str:
    cases = []
    for (low, start), (high, end) in zip(STOPS, STOPS[1:], strict=False):
        channels = [(int(start[k : k + 2], 16), int(end[k : k + 2], 16)) for k in (1, 3, 5)]
        mixed = " || ".join(f"printf('%02X', CAST(floor({a} + (v - {low}) / {high - low}.0::DOUBLE * {b - a} + 0.5::DOUBLE) AS BIGINT))" for a, b in channels)
        cases.append(f"WHEN v <= {high} THEN '#' || {mixed}")
    return f"CASE {' '.join(cases)} END".replace("v <=", f"{value} <=").replace("(v -", f"({value} -")


@query(f"""SELECT event_id, least(greatest(CAST(ceil(epoch_us(ts) / 1000000.0::DOUBLE) AS BIGINT), {FROM}), {AT * HOUR}) AS acknowledged, least(greatest(CAST(floor(epoch(ts)) AS BIGINT) - 4, {FROM}), {AT * HOUR}) AS target,
  regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z' AS received, CAST(event_id AS VARCHAR) AS counter, CASE WHEN event_id % 5 <> 0 THEN value + 1 END AS checked, {_gradient_sql("least(value, 100.0::DOUBLE)")} AS colour FROM events""")
def clock_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    other = F.when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    return events.select(
        "event_id", scalars.acknowledged_second(micros, FROM, AT * HOUR).alias("acknowledged"),
        scalars.clamp_target(epoch_seconds(), F.lit(FROM), F.lit(AT * HOUR), 4).alias("target"), scalars.rfc3339(ts).alias("received"),
        F.col("event_id").cast("string").alias("counter"), scalars.checked_sum(F.col("value"), other).alias("checked"), scalars.gradient(F.col("value"), STOPS).alias("colour"),
    )


@query(f"""WITH {bars_cte()}, {MEASURED} SELECT symbol, last, {AT} - mark_slot - 1 AS mark_age, CASE WHEN bad THEN 'invalid' WHEN NOT a_ok THEN 'unavailable' ELSE 'current' END AS status,
  CASE WHEN bad THEN 'invalid_input' WHEN NOT a_ok THEN 'history_incomplete' ELSE '' END AS reason, CASE WHEN NOT bad AND a_ok THEN percentile END AS value
FROM ms LEFT JOIN ({SQL["activity_percentile"]}) a USING (symbol)""")
def activity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity with its status, the mark and its age."""
    rows = _measured(spark, sf_dir)
    return rows.select("symbol", "last", "mark_age", "activity.status", "activity.reason", F.round("activity.value", 6).alias("value"))


@query("""SELECT o_orderkey AS cycle, CAST(CASE WHEN o_orderstatus <> 'F' AND o_custkey % 4 <> 0 AND o_custkey % 7 >= 3 AND o_totalprice > 60000 THEN greatest(o_orderkey + 3, coalesce(prior, o_orderkey + 3)) ELSE prior END AS DOUBLE) AS committed
FROM (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + o_custkey % 5 END AS prior FROM orders)""")
def committed_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed time after a cycle: it advances only if connection, fence, support and accounting allow it, and never back."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    state = read(spark, sf_dir, "orders").select(
        o.alias("cycle"), (F.col("o_orderstatus") != "F").alias("epoch_active"), (c % 4 != 0).alias("fence_reconciled"), (o + c % 7).alias("support"), (o + 3).alias("target"),
        (F.col("o_totalprice") > 60_000).alias("accounting_valid"), F.when(o % 3 != 0, o + c % 5).alias("committed"),
    )
    return state.select("cycle", status.watermark(state).cast("double").alias("committed"))


@query("""SELECT 'deep_discount' AS "check", count(*) AS n FROM lineitem WHERE l_discount > 0.09 HAVING count(*) > 0
UNION ALL SELECT 'no_quantity', count(*) FROM lineitem WHERE l_quantity <= 0 HAVING count(*) > 0
UNION ALL SELECT 'orders_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0
UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) HAVING count(*) > 0""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that find rows, with their number; a check that holds leaves no row."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    checks = {
        "deep_discount": lines.where(F.col("l_discount") > 0.09),
        "no_quantity": lines.where("l_quantity <= 0"),
        "orders_without_lines": orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"),
        "lines_without_order": lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"),
    }
    return status.violations(checks)

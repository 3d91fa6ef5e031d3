"""Registered queries of what is carried on: marks from batch to batch, and rejected bars into the measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators import asof, bars, coverage, features, ledger
from slotwise.params import ScanParams
from slotwise.plans.queries import AT, HOUR, PARAMS, SQL, START, TICKS, _evidence, query
from slotwise.plans.wire_queries import FROM, KEPT, PER_FRAME, TO, _elements
from slotwise.sources import wire
from slotwise.sources.folders import kept
from slotwise.sources.tables import ticks

#: Committed times of three batches, of which each brings a third of the ticks of every hour.
TIMES = (START + 200, START + 400, START + 600)


@query(f"""WITH {TICKS}, k AS (SELECT unnest([0, 1, 2]) AS step, unnest([{", ".join(map(str, TIMES))}]) AS "at"),
b AS (SELECT step, "at", user_id AS symbol, sec // {HOUR} AS slot, arg_max(price, seq) AS close FROM k JOIN ticks ON seq % 3 <= step AND price > 0 AND sec // {HOUR} < "at" GROUP BY ALL)
SELECT step, symbol, max(slot) AS mark_slot, arg_max(close, slot) AS mark_close FROM b GROUP BY 1, 2""")
def marks_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mark of every user after each of three batches, each from the marks of the one before."""
    every = ticks(spark, sf_dir, "user_id")
    marks, before, out = None, START, None
    for step, at in enumerate(TIMES):
        now = bars.from_ticks(every.where(F.col("seq") % 3 <= step), HOUR)
        if marks is None:
            marks = now.select("symbol", F.col("slot").alias("mark_slot"), F.col("close").alias("mark_close")).where("false")
            before = -(1 << 40)
        changed = every.where(F.col("seq") % 3 == step).select("symbol", F.floor(F.col("sec") / HOUR).alias("slot")).distinct()
        marks = kept(asof.marks_carried(marks, now, changed, before, at), "marks")
        before = at
        one = marks.select(F.lit(step).alias("step"), "symbol", "mark_slot", "mark_close")
        out = one if out is None else out.unionByName(one)
    return out


SPAN = ScanParams(start=FROM, end=TO, activity_window=30 * HOUR, activity_stride=5 * HOUR, move_window=30 * HOUR)
_NUMBER = "CAST(substr(symbol, 2) AS BIGINT)"
STRUCTURAL = ("price", "volume", "price_order", "average_trade_size")


@query(f"""WITH {KEPT}, w AS (SELECT seq, sym AS symbol, CAST(substr(sym, 2) AS BIGINT) AS id, sec AS slot, price AS open, price * CASE WHEN seq % 11 = 0 THEN 0.9::DOUBLE ELSE 2 END AS high, price * 0.5::DOUBLE AS low, price * 1.5::DOUBLE AS close, size + CASE WHEN seq % 3 = 0 THEN 0.25::DOUBLE ELSE 0 END AS volume,
  CASE WHEN seq % 19 = 0 OR seq % 65 = 0 OR seq % 55 = 0 OR sec < {FROM} OR sec + 1 > {TO} THEN 'context' WHEN seq % 20 = 0 OR price <= 0 OR seq % 11 = 0 OR seq % 35 = 0 THEN 'evidence' END AS reject FROM kept WHERE seq % 5 = 0),
-- The later bar of a second stands.
g AS (SELECT * FROM w WHERE reject IS NULL QUALIFY row_number() OVER (PARTITION BY symbol, slot ORDER BY seq DESC) = 1),
i AS (SELECT DISTINCT symbol, slot FROM w r WHERE reject = 'evidence' AND NOT EXISTS (SELECT 1 FROM w a WHERE a.symbol = r.symbol AND a.reject IS NULL AND a.seq > r.seq AND a.slot >= r.slot)),
t AS (SELECT symbol, sum(volume) AS volume, arg_min(open, slot) AS first_open, max(high) AS high, min(low) AS low, arg_max(close, slot) AS last, max(slot) AS mark, min(slot) AS first_slot FROM g GROUP BY 1),
u AS (SELECT DISTINCT symbol, id FROM w), b AS (SELECT symbol, max(slot) AS bad FROM i GROUP BY 1),
z AS (SELECT u.*, t.* EXCLUDE (symbol), bad IS NOT NULL AS bad_session, coalesce(bad > coalesce(mark, -1), false) AS bad_mark, id % 3 <> 0 AS whole, CASE WHEN id % 5 <> 0 THEN 50.0::DOUBLE END AS prior FROM u LEFT JOIN t USING (symbol) LEFT JOIN b USING (symbol)),
f AS (SELECT symbol, 'volume' AS name, CASE WHEN bad_session THEN 'invalid' WHEN NOT whole THEN 'unavailable' ELSE 'current' END AS status, CASE WHEN bad_session THEN 'invalid_input' WHEN NOT whole THEN 'history_incomplete' ELSE '' END AS reason, coalesce(volume, 0) AS value FROM z
  UNION ALL SELECT symbol, 'from_close', CASE WHEN prior IS NULL OR mark IS NULL THEN 'unavailable' WHEN bad_mark THEN 'invalid' ELSE 'current' END, CASE WHEN prior IS NULL THEN 'prior_close_unavailable' WHEN mark IS NULL THEN 'before_first_print' WHEN bad_mark THEN 'invalid_input' ELSE '' END, 100 * (last / prior - 1) FROM z
  UNION ALL SELECT symbol, 'from_open', CASE WHEN bad_mark THEN 'invalid' WHEN mark IS NULL OR NOT whole AND first_slot > {FROM} THEN 'unavailable' ELSE 'current' END,
    CASE WHEN bad_mark THEN 'invalid_input' WHEN mark IS NULL THEN 'before_first_print' WHEN NOT whole AND first_slot > {FROM} THEN 'history_incomplete' ELSE '' END, 100 * (last / first_open - 1) FROM z
  UNION ALL SELECT symbol, 'day_range', CASE WHEN bad_session THEN 'invalid' WHEN NOT whole OR mark IS NULL OR high = low THEN 'unavailable' ELSE 'current' END,
    CASE WHEN bad_session THEN 'invalid_input' WHEN NOT whole THEN 'history_incomplete' WHEN mark IS NULL THEN 'before_first_print' WHEN high = low THEN 'zero_width' ELSE '' END, 100 * (last - low) / nullif(high - low, 0) FROM z)
SELECT symbol, name, status, reason, CASE WHEN status = 'current' THEN round(value, 6) END AS value FROM f""")
def wire_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields measured over bars as they came over the wire; the rejects of the wire, and none else, make them invalid."""
    found = _wire_evidence(spark, sf_dir)
    priors = found[0].where(F.expr(_NUMBER) % 5 != 0).withColumn("prior_close", F.lit(50.0))
    fields = features.measurements(*found, priors, SPAN, AT * HOUR)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("f")) for n in ("volume", "from_close", "from_open", "day_range"))))
    return fields.select("symbol", each.alias("e")).select("symbol", "e.name", "e.f.status", "e.f.reason", F.round("e.f.value", 6).alias("value"))


def _wire_evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Symbols, standing bars, covered slots, conflicts (none) and standing rejects of the wire."""
    found = wire.live_bars(_elements(spark, sf_dir), FROM, TO).withColumn("seq", F.col("position.frame") * PER_FRAME + F.col("position.idx"))
    # Written once: what follows reads it some ten times, and decoding the wire costs more than all of it.
    decoded = found.select(
        "symbol", "slot", "seq", "open", "high", "low", "close", "volume", F.coalesce(F.col("reject").isin(*STRUCTURAL), F.lit(False)).alias("evidence"), F.when(F.col("reject").isNull(), "inserted").otherwise("rejected").alias("disposition")
    )
    log = kept(decoded, "wire-log")
    rejects = ledger.standing_rejects(log)
    stands = log.where("disposition = 'inserted'").groupBy("symbol", "slot").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "seq").alias("bar")).select("symbol", "slot", "bar.*")
    universe = log.select("symbol").distinct()
    since = F.when(F.expr(_NUMBER) % 3 != 0, FROM).otherwise(TO - 100 * HOUR).cast("bigint")
    known = universe.select("symbol", since.alias("a"), F.lit(TO).cast("bigint").alias("b"))
    intervals = coverage.merged(coverage.islands(stands).unionByName(known))
    return universe, stands, intervals, intervals.where("false"), rejects


@query(f"""SELECT symbol, name, status, reason FROM ({SQL["wire_measurements"]}) WHERE name <> 'from_close'""")
def wire_field_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of the fields over bars of the wire, without their values."""
    return features.statuses(*_wire_evidence(spark, sf_dir), SPAN, AT * HOUR).where(F.col("name").isin("volume", "from_open", "day_range"))


@query(f"""SELECT symbol, name, status, reason FROM ({SQL["measurement_fields"]}) WHERE name <> 'from_close'""")
def field_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of the fields over the hourly bars, without their values."""
    return features.statuses(*_evidence(spark, sf_dir), PARAMS, AT).where("name <> 'activity'")

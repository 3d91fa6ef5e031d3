"""Registered queries of the full merge: order lines as deliveries of eight-field bars, under control states of their own.

A part is a symbol, its lines are deliveries in order of their order. Each twenty thousand ticks are a
connection: not yet acknowledged, then live or hydrating, then lost, then recovering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators import ledger
from slotwise.plans.queries import query
from slotwise.sources.tables import read

SPAN = 20_000  # ticks: ten times the order, plus the line
ARRIVALS = 10**10  # arrivals a tick, told apart by part and supplier
SESSION = ledger.Session("s", 1000, 5000, horizon_s=960)
LIVE_SOURCE, REST_SOURCE = ledger.PROVENANCES


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    seq = (k * 10 + n).cast("bigint")  # a tick; rules go by it
    kind = F.when(seq % 107 == 0, "other").when(F.col("l_returnflag") == "N", "historical").otherwise("live")
    live = kind == "live"
    rough = F.col("l_tax") >= 0.07
    epoch = F.expr(f"(l_orderkey * 10 + l_linenumber) div {SPAN}") + 1 - F.when(seq % 37 == 0, 1).otherwise(0)
    frame = F.when(seq % 131 == 0, 0).when(rough, F.expr("l_orderkey div 8 * 8") * 8).when(seq % 5 == 0, (k - 300) * 8 + n).otherwise(k * 8 + n)
    base = 10.0 + F.col("l_quantity").cast("bigint") % 3
    slot = (F.lit(2000) + F.col("l_partkey") % 500 + n % 3).cast("bigint")
    age = F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06), 1000).when(F.col("l_tax") > 0.07, -5).otherwise(10)
    bar = F.struct(
        base.alias("open"), F.when(seq % 113 == 0, base - 5).otherwise(base + 2).alias("high"), (base - 1).alias("low"), (base + 1).alias("close"),
        (F.col("l_quantity").cast("bigint") % 3 * 100).cast("double").alias("volume"), (base + 0.5).alias("vwap"), F.lit(7).cast("bigint").alias("ats"), F.when(seq % 2 == 0, LIVE_SOURCE).otherwise(REST_SOURCE).alias("provenance"),
    )
    request = F.struct((F.expr("l_orderkey div 1500") + 1).alias("generation"), F.when(seq % 41 == 0, "").otherwise("t").alias("token"), n.cast("bigint").alias("ordinal"), F.lit(1000).cast("bigint").alias("a"), F.lit(5000).cast("bigint").alias("b"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("symbol"), slot.alias("slot"), F.when(seq % 109 == 0, 2).otherwise(1).alias("seconds"), (seq * ARRIVALS + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("seq"), kind.alias("source"),
        F.when(live, F.struct(epoch.cast("bigint").alias("epoch"), frame.cast("bigint").alias("frame"), n.cast("bigint").alias("idx"))).alias("position"), F.when(~live, request).alias("request"),
        F.when(seq % 101 == 0, 2).otherwise(1).alias("schema_version"), F.when(seq % 103 == 0, "other").otherwise("s").alias("binding"), F.when(seq % 127 != 0, k).alias("delivered"), bar.alias("bar"), (slot + 1 + age).alias("admission_s"),
    )


#: Since and until within a connection, lifecycle (for even and odd ones), active, acknowledged.
PHASES = ((0, 400, "awaiting", "awaiting", True, False), (400, 18_000, "live", "hydrating", True, True), (18_000, 19_000, "live", "live", False, True), (19_000, SPAN, "recovering", "recovering", True, True))


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = read(spark, sf_dir, "orders").select(F.expr(f"o_orderkey * 10 div {SPAN}").alias("e")).distinct()
    e, since = F.col("e"), F.col("e") * SPAN
    phases = [
        F.struct(((since + a) * ARRIVALS).alias("since"), ((since + b) * ARRIVALS).alias("until"), F.when(e % 2 == 0, even).otherwise(odd).alias("lifecycle"), F.lit(on).alias("active"), F.lit(known).alias("acknowledged"))
        for a, b, even, odd, on, known in PHASES
    ]
    ack = F.struct((e + 1).alias("epoch"), F.expr(f"(e * {SPAN} div 10 + 80) * 8").alias("frame"), F.lit(0).cast("bigint").alias("idx"))
    return spans.select((e + 1).alias("epoch"), ack.alias("ack"), F.explode(F.array(*phases)).alias("p")).select("p.*", "epoch", "ack")


def _log(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    universe = read(spark, sf_dir, "part").where("p_size <> 50").select(F.col("p_partkey").alias("symbol"))
    return ledger.dispositions(_lines(spark, sf_dir), _controls(spark, sf_dir), universe, SESSION, 1000 * ARRIVALS, ["symbol", "slot", "seq", *also])


LOG = f"""RECURSIVE l AS (SELECT *, l_orderkey * 10 + l_linenumber AS tick, (l_orderkey * 10 + l_linenumber) * {ARRIVALS} + l_partkey * 10000 + l_suppkey AS seq, (l_orderkey * 10 + l_linenumber) // {SPAN} AS e, (l_orderkey * 10 + l_linenumber) % {SPAN} AS phase,
  CAST(l_quantity AS BIGINT) % 3 AS q, 2000 + l_partkey % 500 + l_linenumber % 3 AS slot, CASE WHEN l_linestatus = 'F' AND l_tax > 0.06 THEN 1000 WHEN l_tax > 0.07 THEN -5 ELSE 10 END AS age FROM lineitem),
d AS (SELECT *, CASE WHEN tick % 107 = 0 THEN 'other' WHEN l_returnflag = 'N' THEN 'historical' ELSE 'live' END AS source, e + 1 - CASE WHEN tick % 37 = 0 THEN 1 ELSE 0 END AS epoch,
  CASE WHEN tick % 131 = 0 THEN 0 WHEN l_tax >= 0.07 THEN l_orderkey // 8 * 64 WHEN tick % 5 = 0 THEN (l_orderkey - 300) * 8 + l_linenumber ELSE l_orderkey * 8 + l_linenumber END AS frame,
  l_orderkey // 1500 + 1 AS generation, q * 2 + tick % 2 AS bar, age > 960 AS late, p_partkey IS NOT NULL AS known FROM l LEFT JOIN part ON p_partkey = l_partkey AND p_size <> 50),
c AS (SELECT *, CASE WHEN source = 'live' THEN (epoch, frame, l_linenumber) END AS position,
  CASE WHEN source = 'live' AND (phase >= 18000 AND phase < 19000 OR epoch <> e + 1) THEN 'fenced:stale_live_epoch'
    WHEN CASE WHEN source <> 'live' THEN NOT (phase >= 19000 OR phase >= 400 AND phase < 18000 AND e % 2 = 1) ELSE phase < 400 END THEN 'rejected:lifecycle'
    WHEN tick % 101 = 0 THEN 'rejected:schema' WHEN tick % 103 = 0 THEN 'fenced:binding' WHEN source = 'other' THEN 'rejected:run_source' WHEN NOT known THEN 'rejected:symbol' WHEN tick % 109 = 0 THEN 'rejected:window' END AS early,
  CASE WHEN tick % 127 = 0 THEN 'rejected:delivery_evidence' WHEN source = 'live' AND frame <= 0 THEN 'rejected:source_position'
    WHEN source = 'live' AND (epoch, frame, l_linenumber) <= (e + 1, (e * {SPAN} // 10 + 80) * 8, 0) THEN 'rejected:aggregate_at_or_before_ack'
    WHEN source <> 'live' AND tick % 41 = 0 THEN 'fenced:historical_context' WHEN age < 0 THEN 'rejected:future_event_time' END AS behind FROM d),
g AS (SELECT *, coalesce(early, CASE WHEN tick % 113 = 0 THEN 'rejected:structural' END, behind) AS refused, early IS NULL AND tick % 113 = 0 AND behind IS NULL AS evidence FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, slot ORDER BY seq) AS rn FROM g WHERE refused IS NULL),
f AS (SELECT l_partkey, slot, 0 AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS xb, false AS xl, CAST(NULL AS STRUCT(epoch BIGINT, frame BIGINT, idx BIGINT)) AS xp, CAST(NULL AS BIGINT) AS xg, false AS conflict, CAST(NULL AS BIGINT) AS first_seq, CAST(NULL AS BIGINT) AS set_seq, '' AS outcome FROM (SELECT DISTINCT l_partkey, slot FROM s)
  UNION ALL SELECT l_partkey, slot, rn, seq,
    CASE WHEN o IN ('inserted:', 'revised:') THEN bar WHEN o LIKE 'withdrawn%' OR o LIKE 'integrity%' THEN NULL ELSE xb END,
    CASE WHEN o IN ('inserted:', 'revised:') THEN live WHEN o = 'exact_duplicate:' AND live THEN true WHEN o LIKE 'withdrawn%' OR o LIKE 'integrity%' THEN false ELSE xl END,
    CASE WHEN o IN ('inserted:', 'revised:') THEN position WHEN o = 'exact_duplicate:' AND live THEN greatest(coalesce(xp, position), position) WHEN o LIKE 'withdrawn%' OR o LIKE 'integrity%' THEN NULL ELSE xp END,
    CASE WHEN o IN ('inserted:', 'revised:') THEN CASE WHEN NOT live THEN generation END WHEN o LIKE 'withdrawn%' THEN NULL ELSE xg END,
    CASE WHEN o IN ('inserted:', 'revised:') AND live THEN false WHEN o LIKE 'withdrawn%' THEN true ELSE conflict END,
    CASE WHEN o = 'inserted:' THEN seq ELSE first_seq END, CASE WHEN o IN ('inserted:', 'revised:') THEN seq ELSE set_seq END, o
  FROM (SELECT f.l_partkey, f.slot, s.rn, s.seq, s.bar, s.generation, s.source = 'live' AS live, CAST(ROW(s.epoch, s.frame, s.l_linenumber) AS STRUCT(epoch BIGINT, frame BIGINT, idx BIGINT)) AS position, xb, xl, xp, xg, conflict, first_seq, set_seq,
    CASE WHEN s.source = 'live' AND s.late AND NOT xl THEN 'rejected:too_late'
      WHEN s.source <> 'live' AND xb IS NOT NULL AND NOT xl AND s.late AND s.generation IS DISTINCT FROM xg THEN 'fenced:historical_context'
      WHEN s.source <> 'live' AND xb IS NULL AND conflict THEN 'rejected:historical_historical_conflict'
      WHEN xb = s.bar THEN 'exact_duplicate:' WHEN s.source = 'live' AND s.late THEN 'rejected:too_late' WHEN xb IS NULL THEN 'inserted:'
      WHEN s.source <> 'live' THEN CASE WHEN xl THEN 'rejected:historical_live_conflict' ELSE 'withdrawn_conflict:historical_historical_conflict' END
      WHEN NOT xl THEN 'revised:' WHEN (s.epoch, s.frame, s.l_linenumber) < (xp.epoch, xp.frame, xp.idx) THEN 'rejected:nonprecedent'
      WHEN (s.epoch, s.frame, s.l_linenumber) = (xp.epoch, xp.frame, xp.idx) THEN 'integrity:repeated_position_unequal' ELSE 'revised:' END AS o
    FROM f JOIN s ON s.l_partkey = f.l_partkey AND s.slot = f.slot AND s.rn = f.rn + 1)),
br AS (SELECT coalesce(min(seq), 9000000000000000000) AS break_seq FROM f WHERE outcome LIKE 'integrity%'),
log AS (SELECT g.*, CASE WHEN g.seq > br.break_seq THEN 'integrity:repeated_position_unequal' ELSE coalesce(refused, f.outcome) END AS outcome FROM g CROSS JOIN br LEFT JOIN f ON f.seq = g.seq)"""


@query(f"WITH {LOG} SELECT seq, l_partkey AS symbol, slot, split_part(outcome, ':', 1) AS disposition, split_part(outcome, ':', 2) AS reason FROM log")
def bar_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every delivery, under all conditions of admission."""
    return _log(spark, sf_dir).select("seq", "symbol", "slot", "disposition", "reason")


@query(f"""WITH {LOG}, z AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, slot ORDER BY rn DESC) AS back FROM f CROSS JOIN br WHERE rn = 0 OR seq <= break_seq)
SELECT l_partkey AS symbol, slot, 10.0::DOUBLE + xb // 2 AS open, CASE WHEN xb % 2 = 0 THEN '{LIVE_SOURCE}' ELSE '{REST_SOURCE}' END AS provenance, CASE WHEN xl THEN 'live' ELSE 'historical' END AS source,
  CAST(CASE WHEN xl THEN xp.frame END AS DOUBLE) AS frame, first_seq, set_seq AS seq FROM z WHERE back = 1 AND xb IS NOT NULL""")
def bar_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that stand, with whose they are, their first evidence and the delivery of their value."""
    return ledger.canonical(_log(spark, sf_dir, "source", "position", "bar")).select("symbol", "slot", "bar.open", "bar.provenance", "source", F.col("position.frame").cast("double").alias("frame"), "first_seq", "seq")


@query(f"""WITH {LOG} SELECT DISTINCT r.l_partkey AS symbol, r.slot FROM log r CROSS JOIN br WHERE r.evidence AND r.seq <= br.break_seq
  AND NOT EXISTS (SELECT 1 FROM log a WHERE a.l_partkey = r.l_partkey AND a.outcome IN ('inserted:', 'revised:') AND a.slot >= r.slot AND a.seq > r.seq)""")
def standing_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused bars that no later accepted bar at or after their slot has lifted."""
    return ledger.standing_rejects(_log(spark, sf_dir), 1000 * ARRIVALS)

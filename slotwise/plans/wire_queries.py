"""The wire formats as registered queries: events written as frames and pages, and decoded again.

A frame holds eight events in order. Every fifth kind of event is a bar, a trade, a quote, a status or
something unknown, some of them broken by rule. A bar without a sound symbol fences the rest of its frame; an
element that repeats a member it knows is refused alone. The SQL never sees JSON: it states what each event must decode to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators import bars
from slotwise.plans.queries import AT, HOUR, START, TICKS, bars_cte, query
from slotwise.sources import wire
from slotwise.sources.tables import ticks

FROM, TO = START * HOUR, AT * HOUR
PER_FRAME = 8
STATUSES = ("connected", "auth_success", "success", "auth_failed", "unheard")


def _every(n: int) -> Column:
    return F.col("seq") % n == 0


def _payload() -> Column:
    """The JSON text of one event."""
    ms, price, size = F.col("sec") * 1000, F.col("price"), F.col("size")
    symbol = F.when(_every(85), "").otherwise(F.concat(F.lit("u"), "symbol")).alias("sym")
    start = (ms + F.when(_every(65), 1).otherwise(0)).alias("s")
    bar = F.to_json(F.struct(
        F.lit("A").alias("ev"), symbol, start, (start + F.when(_every(55), 2000).otherwise(1000)).alias("e"), price.alias("o"),
        (price * F.when(_every(11), 0.9).otherwise(2.0)).alias("h"), (price * 0.5).alias("l"), (price * 1.5).alias("c"), size.alias("v"),
        F.when(_every(3), F.concat(size, F.lit(".25"))).alias("dv"), F.when(_every(20), 0.0).otherwise(price).alias("vw"), F.when(~_every(35), size).alias("z"),
    ))
    exact = F.when(_every(3), F.concat(size, F.lit(".5"))).when(F.col("seq") % 15 == 1, "x")
    trade = F.to_json(F.struct(
        F.lit("T").alias("ev"), symbol, F.when(_every(31), "").otherwise(F.col("seq").cast("string")).alias("i"), F.when(_every(27), 0).otherwise(4).alias("x"), F.when(_every(33), 2e9).otherwise(price).alias("p"), size.alias("s"), exact.alias("ds"),
        F.array(F.col("seq") % 50, F.lit(12)).alias("c"), (ms + 40).alias("t"), F.when(~_every(2), ms - 40).alias("pt"), F.when(_every(7), 12).alias("e"),
    ))
    quote = F.to_json(F.struct(F.lit("Q").alias("ev"), symbol, F.when(~_every(2), price - 0.05).alias("bp"), F.when(~_every(3), price + 0.05).alias("ap"), ms.alias("t")))
    status = F.to_json(F.struct(F.lit("status").alias("ev"), F.element_at(F.array(*map(F.lit, STATUSES)), F.floor(F.col("seq") / 5 % 5).cast("int") + 1).alias("status")))
    kind = F.col("seq") % 5
    # A repeated member of the family, and a repeated one that the family does not know.
    again = lambda text: F.when(_every(19), F.concat(F.lit('{"t":1,"t":2,"o":1,"o":2,'), F.substr(text, F.lit(2)))).when(_every(23), F.concat(F.lit('{"zz":1,"zz":2,'), F.substr(text, F.lit(2)))).otherwise(text)
    bar, trade, quote = again(bar), again(trade), again(quote)
    return F.when(_every(97), F.lit('{"ev":"A","sym":"u1","sym":"u2"}')).when(_every(89), F.lit("7")).when(kind == 0, bar).when(kind == 1, trade).when(kind == 2, quote).when(kind == 3, status).otherwise('{"ev":"N"}')


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ticks(spark, sf_dir, "user_id").withColumn("element", _payload())
    # A frame is received a minute before its last event, so that some events are ahead of their receipt.
    frames = events.groupBy(F.floor(F.col("seq") / PER_FRAME).alias("frame")).agg(
        (F.max("sec") - 60).cast("double").alias("received_s"), F.array_sort(F.collect_list(F.struct("seq", "element"))).alias("parts")
    )
    text = F.concat(F.lit("["), F.array_join("parts.element", ","), F.lit("]"))
    return wire.elements(frames.select(F.lit(1).cast("bigint").alias("epoch"), "frame", "received_s", text.alias("payload")))


KEPT = f"""{TICKS}, fence AS (SELECT seq // {PER_FRAME} AS frame, min(seq) AS fence FROM ticks WHERE seq % 97 = 0 OR seq % 89 = 0 OR seq % 85 = 0 GROUP BY 1),
kept AS (SELECT t.*, t.seq // {PER_FRAME} AS frame, t.seq % {PER_FRAME} AS idx, CASE WHEN seq % 85 = 0 THEN '' ELSE 'u' || user_id END AS sym,
    max(sec) OVER (PARTITION BY t.seq // {PER_FRAME}) - 60 AS received
  FROM ticks t LEFT JOIN fence f ON f.frame = t.seq // {PER_FRAME} QUALIFY f.fence IS NULL OR t.seq < f.fence)"""


@query(f"""WITH {KEPT} SELECT frame, idx, CASE seq % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'T' WHEN 2 THEN 'Q' WHEN 3 THEN 'status' ELSE 'N' END AS family,
  CASE WHEN seq % 5 < 3 THEN sym END AS symbol FROM kept""")
def wire_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).select("frame", F.col("idx").cast("bigint").alias("idx"), "family", "symbol")


@query(f"""WITH {KEPT} SELECT frame, idx, sym AS symbol, sec AS slot, price AS open, price * CASE WHEN seq % 11 = 0 THEN 0.9::DOUBLE ELSE 2 END AS high, price * 0.5::DOUBLE AS low,
  price * 1.5::DOUBLE AS close, size + CASE WHEN seq % 3 = 0 THEN 0.25::DOUBLE ELSE 0 END AS volume, CASE WHEN seq % 20 = 0 THEN 0 ELSE price END AS vwap,
  CASE WHEN seq % 35 <> 0 THEN CAST(size AS DOUBLE) END AS ats,
  CASE WHEN seq % 19 = 0 THEN 'duplicate_recognized_member' WHEN seq % 65 = 0 THEN 'timestamp' WHEN seq % 55 = 0 THEN 'window_length' WHEN sec < {FROM} OR sec + 1 > {TO} THEN 'outside_session'
    WHEN seq % 20 = 0 THEN 'price' WHEN seq % 11 = 0 THEN 'price_order' WHEN seq % 35 = 0 THEN 'average_trade_size' END AS reject
FROM kept WHERE seq % 5 = 0""")
def wire_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wire.live_bars(_elements(spark, sf_dir), FROM, TO)
    return found.select("position.frame", F.col("position.idx").cast("bigint").alias("idx"), "symbol", "slot", "open", "high", "low", "close", "volume", "vwap", F.col("ats").cast("double").alias("ats"), "reject")


@query(f"""WITH {KEPT}, t AS (SELECT *, sec * 1000 + 40 AS sip, CASE WHEN seq % 2 <> 0 THEN sec * 1000 - 40 END AS pt FROM kept WHERE seq % 5 = 1),
v AS (SELECT *, sip >= {FROM * 1000} AND sip < {TO * 1000} AND sip <= received * 1000 + 250 AS sip_ok,
  coalesce(pt >= {FROM * 1000} AND pt < {TO * 1000} AND pt <= received * 1000 + 250, false) AS pt_ok,
  CASE WHEN seq % 3 = 0 THEN size + 0.5::DOUBLE WHEN seq % 15 = 1 THEN NULL WHEN size > 0 THEN CAST(size AS DOUBLE) END AS exact FROM t)
SELECT frame, idx, sym AS symbol, CASE WHEN seq % 31 = 0 THEN '' ELSE CAST(seq AS VARCHAR) END AS trade_id, CASE WHEN seq % 33 = 0 THEN 2e9 ELSE price END AS price, exact AS size, CAST(CASE WHEN pt_ok THEN pt WHEN sip_ok THEN sip END AS DOUBLE) AS event_ms,
  CASE WHEN pt_ok THEN 'participant' WHEN sip_ok THEN 'sip_fallback' END AS basis, CASE WHEN seq % 7 = 0 THEN 'unsupported_lifecycle' ELSE 'original' END AS lifecycle,
  least(seq % 50, 12) || ',' || greatest(seq % 50, 12) AS conditions,
  CASE WHEN seq % 19 = 0 THEN 'duplicate_recognized_member' WHEN seq % 27 = 0 OR seq % 31 = 0 OR seq % 33 = 0 OR price <= 0 THEN 'trade_identity' WHEN exact IS NULL THEN 'size' WHEN NOT (pt_ok OR sip_ok) THEN 'event_time' END AS reject FROM v""")
def wire_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wire.trades(_elements(spark, sf_dir), FROM, TO)
    codes = F.array_join(F.transform("conditions", lambda c: c.cast("string")), ",")
    return found.select("position.frame", F.col("position.idx").cast("bigint").alias("idx"), "symbol", "trade_id", "price", "size", F.col("event_ms").cast("double").alias("event_ms"), "basis", "lifecycle", codes.alias("conditions"), "reject")


@query(f"""WITH {KEPT}, q AS (SELECT *, CASE WHEN seq % 2 <> 0 AND price - 0.05::DOUBLE > 0 THEN price - 0.05::DOUBLE END AS bid, CASE WHEN seq % 3 <> 0 AND price + 0.05::DOUBLE > 0 THEN price + 0.05::DOUBLE END AS ask FROM kept WHERE seq % 5 = 2)
SELECT frame, idx, sym AS symbol, bid, ask, CASE WHEN seq % 19 = 0 THEN 'duplicate_recognized_member' WHEN NOT (sec >= {FROM} AND sec < {TO} AND sec * 1000 <= received * 1000 + 250) THEN 'event_time'
  WHEN seq % 2 <> 0 AND bid IS NULL OR seq % 3 <> 0 AND ask IS NULL THEN 'quote_price' WHEN bid IS NULL AND ask IS NULL THEN 'no_side' END AS reject FROM q""")
def wire_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.quotes(_elements(spark, sf_dir), FROM, TO).select("position.frame", F.col("position.idx").cast("bigint").alias("idx"), "symbol", "bid", "ask", "reject")


@query(f"""WITH {KEPT} SELECT frame, idx, CASE (seq // 5) % 5 WHEN 0 THEN 'connected' WHEN 1 THEN 'authenticated' WHEN 2 THEN 'subscribed' WHEN 3 THEN 'failed' ELSE 'other' END AS phase FROM kept WHERE seq % 5 = 3""")
def wire_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.statuses(_elements(spark, sf_dir)).select("frame", F.col("idx").cast("bigint").alias("idx"), "phase")


SINCE = START + 3


@query(f"""WITH {bars_cte("user_id")}, good AS (SELECT symbol FROM bars GROUP BY symbol HAVING bool_and(slot >= {SINCE} AND coalesce(vwap > 0, false)) AND symbol % 7 <> 0 AND symbol % 11 <> 0 AND symbol % 13 <> 0 AND (symbol % 5 <> 0 OR count(*) = 1))
SELECT 'u' || symbol AS symbol, slot * {HOUR} AS slot, CASE WHEN row_number() OVER w <= (count(*) OVER (PARTITION BY symbol) + 1) // 2 THEN CAST(0 AS BIGINT) ELSE 1 END AS page,
  CASE WHEN row_number() OVER w <= (count(*) OVER (PARTITION BY symbol) + 1) // 2 THEN row_number() OVER w - 1 ELSE row_number() OVER w - 1 - (count(*) OVER (PARTITION BY symbol) + 1) // 2 END AS ordinal, open, high, low, close, CAST(volume AS DOUBLE) AS volume,
  round(vwap + 1e-9, 6) AS vwap, ats FROM bars JOIN good USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY slot)""")
def wire_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of each user's hours; some descend, say they are adjusted, miscount their rows or have no trades."""
    b = bars.from_ticks(ticks(spark, sf_dir, "user_id"), HOUR)
    n = F.when(F.col("symbol") % 13 == 0, 0).otherwise(F.col("n"))
    row = F.struct((F.col("slot") * HOUR * 1000).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("vwap").alias("vw"), n.alias("n"))
    users = b.groupBy("symbol").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    half = F.ceil(F.size("rows") / 2).cast("int")
    results = F.when(F.col("symbol") % 5 == 0, F.reverse("half")).otherwise(F.col("half"))
    halves = users.select("symbol", F.posexplode(F.array(F.slice("rows", F.lit(1), half), F.slice("rows", half + 1, F.size("rows")))).alias("page", "half")).select("symbol", "page", results.alias("results"))
    # Users of a multiple of five have pages that descend, and come in the wrong order.
    page = F.when(F.col("symbol") % 5 == 0, 1 - F.col("page")).otherwise(F.col("page"))
    envelope = F.struct(
        (F.col("symbol") % 7 == 0).alias("adjusted"), F.lit("OK").alias("status"), F.concat(F.lit("u"), "symbol").alias("ticker"),
        (F.size("results") + F.when(F.col("symbol") % 11 == 0, 1).otherwise(0)).alias("resultsCount"), "results",
    )
    pages = halves.select(F.concat(F.lit("u"), "symbol").alias("symbol"), page.alias("page"), F.to_json(envelope).alias("body"))
    found = wire.historical_bars(pages, SINCE * HOUR, 1 << 40)
    return found.select("symbol", "slot", F.col("page").cast("bigint").alias("page"), F.col("ordinal").cast("bigint").alias("ordinal"), "open", "high", "low", "close", "volume", F.round(F.col("vwap") + 1e-9, 6).alias("vwap"), "ats")

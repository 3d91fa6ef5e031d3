"""Registered queries of whole chains: trades and quotes from admission to their measurement, feeds of pages, publications."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from slotwise.operators import admission, pages, tape
from slotwise.plans.more_queries import FROM, OUTCOMES, TO, _outcomes
from slotwise.plans.queries import AT, HOUR, TICKS, query
from slotwise.plans.state_queries import FILES, _split
from slotwise.sources.folders import shared_folder
from slotwise.sources.tables import read, ticks
from slotwise.streaming.published import PublishedStream

WINDOW = 5 * 24 * HOUR
LATEST = AT * HOUR


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(s.alias("symbol"), (s % 3 != 0).alias("requested"), (s % 19 == 0).alias("shed"), (s % 17 == 0).alias("control_error"))


MEMBERS = f"""{OUTCOMES}, cov AS (SELECT symbol, least(greatest(arg_min(received, seq), {FROM}), {TO}) AS covered_from FROM outcomes WHERE outcome <> 'fenced' GROUP BY symbol),
mem AS (SELECT c_custkey AS symbol, c_custkey % 3 <> 0 AS requested, c_custkey % 19 = 0 AS shed, c_custkey % 17 = 0 AS control_error, covered_from FROM customer LEFT JOIN cov ON symbol = c_custkey),
adm AS (SELECT t.*, t.user_id AS symbol FROM outcomes o JOIN ticks t USING (seq) WHERE o.outcome = 'admitted')"""


@query(f"""WITH {MEMBERS}, ids AS (SELECT symbol, size % 200 AS id, min(seq) AS seq, min(price > 5) <> max(price > 5) AS unequal FROM adm GROUP BY 1, 2),
bad AS (SELECT DISTINCT symbol FROM ids WHERE unequal), ok AS (SELECT a.* FROM adm a JOIN ids i ON i.symbol = a.symbol AND i.seq = a.seq WHERE a.seq % 7 <> 0 AND a.seq % 11 <> 0 AND (a.size % 5 + 1) * 3 <= 9 AND a.sec >= {LATEST - WINDOW} AND a.sec < {LATEST}),
n AS (SELECT symbol, count(*) AS n, bool_or(seq % 2 = 0) AS p, bool_or(seq % 2 = 1) AS s FROM ok GROUP BY 1),
v AS (SELECT m.*, coalesce(n, 0) AS n, coalesce(p, false) AS p, coalesce(s, false) AS s, b.symbol IS NOT NULL AS unequal, {LATEST} - covered_from AS age FROM mem m LEFT JOIN n ON n.symbol = m.symbol LEFT JOIN bad b ON b.symbol = m.symbol),
z AS (SELECT *, CASE WHEN shed THEN 'pressure_shed' WHEN control_error OR age IS NULL THEN 'unavailable' WHEN unequal THEN 'invalid' WHEN age < {WINDOW} THEN 'warming' ELSE 'current' END AS status,
  CASE WHEN shed THEN 'pressure' WHEN control_error THEN 'control_error' WHEN age IS NULL THEN CASE WHEN requested THEN 'channel_unconfirmed' ELSE 'coverage' END WHEN unequal THEN 'unequal_repeat'
    WHEN age < 1 THEN 'coverage_warming' WHEN age < {WINDOW} THEN 'five_second_warming' ELSE 'qualifying_original_prints' END AS reason FROM v)
SELECT symbol, status, reason, CASE WHEN status = 'current' THEN round(n / {float(WINDOW)}, 9) END AS rate, CASE WHEN p AND s THEN 'mixed' WHEN p THEN 'participant' WHEN s THEN 'sip_fallback' ELSE 'none' END AS basis FROM z""")
def tape_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade rate of every customer: events admitted, repeats told, conditions judged, and what closes a channel."""
    outcomes, s = _outcomes(spark, sf_dir), F.col("seq")
    events = ticks(spark, sf_dir, "user_id").select("symbol", "seq", "sec", "price", "size")
    admitted = outcomes.where("outcome = 'admitted'").select("symbol", "seq").join(events, ["symbol", "seq"])
    trades = admitted.select(
        "symbol", "seq", "sec", (F.col("size") % 200).alias("id"), (F.col("price") > 5).alias("high"), F.array((F.col("size") % 5 + 1) * 3).alias("conditions"),
        F.when(s % 7 == 0, "unsupported_lifecycle").otherwise("original").alias("lifecycle"), (s % 11 != 0).alias("identity_classified"), F.when(s % 2 == 0, "participant").otherwise("sip_fallback").alias("basis"),
    )
    rules = spark.createDataFrame([(3, True, True), (6, True, True), (9, True, True), (12, False, True), (15, True, False)], "id bigint, updates_volume boolean, reviewed boolean")
    once, unequal = tape.counted(trades, rules, ["symbol", "id"], ["high"])
    members = _members(spark, sf_dir).join(admission.coverage_starts(outcomes, FROM, TO), "symbol", "left").join(unequal.withColumn("unequal", F.lit(True)), "symbol", "left")
    # Seconds are hours here, so that a window is a few dozen of them.
    hours = once.withColumn("sec", F.expr(f"sec div {HOUR}"))
    targets = members.withColumn("at", F.lit(AT).cast("bigint")).withColumn("covered_from", (F.lit(AT) - (F.lit(LATEST) - F.col("covered_from")) / HOUR))
    rates = tape.tape_rate(hours, targets, WINDOW // HOUR)
    warm = F.when((F.col("reason") == "coverage_warming"), "five_second_warming").otherwise(F.col("reason"))
    return rates.select("symbol", "status", warm.alias("reason"), F.round(F.col("rate") / HOUR, 9).alias("rate"), "basis")


@query(f"""WITH {MEMBERS}, q AS (SELECT symbol, max(seq) AS seq FROM adm GROUP BY 1), l AS (SELECT a.*, CASE WHEN a.seq % 4 <> 0 THEN price END AS bid, CASE WHEN a.seq % 5 <> 0 THEN price + a.seq % 3 - 0.5::DOUBLE END AS ask FROM adm a JOIN q ON q.seq = a.seq),
v AS (SELECT m.*, l.seq, bid, ask, greatest({LATEST} - sec, 0) AS age FROM mem m LEFT JOIN l USING (symbol)),
z AS (SELECT *, CASE WHEN shed THEN 'pressure_shed' WHEN control_error OR covered_from IS NULL THEN 'unavailable' WHEN seq IS NULL THEN 'warming' WHEN bid IS NULL OR ask IS NULL THEN 'unavailable' WHEN ask < bid THEN 'invalid' WHEN age > {24 * HOUR} THEN 'stale' ELSE 'current' END AS status,
  CASE WHEN shed THEN 'pressure' WHEN control_error THEN 'control_error' WHEN covered_from IS NULL THEN CASE WHEN requested THEN 'channel_unconfirmed' ELSE 'coverage' END WHEN seq IS NULL THEN 'coverage_warming'
    WHEN bid IS NULL OR ask IS NULL THEN 'one_sided_quote' WHEN ask < bid THEN 'crossed_quote' WHEN age > {24 * HOUR} THEN 'stale_quote' ELSE '' END AS reason FROM v)
SELECT symbol, status, reason, CAST(CASE WHEN status IN ('current', 'stale') THEN age END AS DOUBLE) AS age, CASE WHEN status IN ('current', 'stale') THEN round(100 * (ask - bid), 4) END AS cents FROM z""")
def quote_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread of every customer from its admitted quotes, without coverage and without a quote included."""
    outcomes, s = _outcomes(spark, sf_dir), F.col("seq")
    events = ticks(spark, sf_dir, "user_id").select("symbol", "seq", "sec", "price")
    admitted = outcomes.where("outcome = 'admitted'").select("symbol", "seq").join(events, ["symbol", "seq"])
    quotes = admitted.select("symbol", "seq", "sec", F.when(s % 4 != 0, F.col("price")).alias("bid"), F.when(s % 5 != 0, F.col("price") + s % 3 - 0.5).alias("ask"))
    members = _members(spark, sf_dir).join(admission.coverage_starts(outcomes, FROM, TO), "symbol", "left").withColumn("covered", F.col("covered_from").isNotNull())
    found = tape.spread_of_members(members, quotes, F.lit(LATEST), 24 * HOUR)
    return found.select("symbol", "status", "reason", F.col("age").cast("double").alias("age"), F.round("cents", 4).alias("cents"))


A_PAGE, MOST_PAGES = 6, 12


def _feeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as ticker records in pages of six, a feed a nation; some feeds are broken by rule."""
    c, k = F.col("c_nationkey"), F.col("c_custkey")
    turn = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    people = read(spark, sf_dir, "customer").withColumn("turn", turn).withColumn("page", F.expr(f"turn div {A_PAGE}"))
    name = F.when((c == 5) & (F.col("turn") == 2 * A_PAGE), "T5-0").when((c == 6) & (F.col("turn") == 7), "").otherwise(F.concat(F.lit("T"), c, F.lit("-"), "turn"))
    record = F.struct(name.alias("ticker"), (F.col("c_acctbal") >= 0).alias("active"), F.when(F.col("c_mktsegment") == "MACHINERY", "otc").otherwise("stocks").alias("market"), F.lit("us").alias("locale"), F.when(k % 3 == 0, "ETF").otherwise("CS").alias("type"))
    text = F.to_json(record)
    odd = F.when((c == 7) & (F.col("turn") == 8), F.regexp_replace(text, '"active":(true|false)', '"active":"true"')).when((c == 8) & (F.col("turn") == 3), F.regexp_replace(text, '"market"', '"ticker":"X","market"')).otherwise(text)
    held = people.groupBy("c_nationkey", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", odd.alias("text")))), lambda x: x["text"]), ",").alias("records"), F.count(F.lit(1)).alias("n"))
    last = F.max("page").over(Window.partitionBy("c_nationkey")) == F.col("page")
    url = lambda page: F.concat(F.lit("https://feed/"), c, F.lit("/"), page)
    following = F.when(last & (c == 3), url(F.lit(1))).when(last & (c == 9), url(F.lit("none"))).when(~last, url(F.col("page") + 1))
    head = F.concat(F.lit('{"status":"'), F.when((c == 10) & (F.col("page") == 1), "LATE").otherwise("OK"), F.lit('","count":'), F.col("n") + F.when((c == 11) & (F.col("page") == 2), 1).otherwise(0))
    body = F.concat(head, F.when(following.isNotNull(), F.concat(F.lit(',"next_url":"'), following, F.lit('"'))).otherwise(""), F.lit(',"results":['), "records", F.lit("]}"))
    found = held.select(url(F.col("page")).alias("url"), body.alias("body"))
    starts = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("feed"), F.concat(F.lit("https://feed/"), "n_nationkey", F.lit("/0")).alias("url"))
    return found, starts


FEEDS = f"""p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS turn FROM customer), q AS (SELECT *, turn // {A_PAGE} AS page FROM p),
n AS (SELECT n_nationkey AS feed, coalesce(max(page) + 1, 0) AS pages, coalesce(max(turn) + 1, 0) AS rows_, count(*) FILTER (c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY' AND c_custkey % 3 <> 0) AS eligible FROM nation LEFT JOIN q ON c_nationkey = n_nationkey GROUP BY 1),
-- Where a reader would stop: the page of each break, and its place in the order of checks.
e AS (SELECT feed, {MOST_PAGES} AS place, 0 AS phase, 'too_many_pages' AS error FROM n WHERE pages > {MOST_PAGES} OR feed IN (3, 9) AND pages >= {MOST_PAGES}
  UNION ALL SELECT feed, pages, 1, 'pagination_cycle' FROM n WHERE feed = 3 AND pages > 1 UNION ALL SELECT feed, pages, 2, 'missing_page' FROM n WHERE feed = 9 OR pages = 0 OR feed = 3 AND pages = 1
  UNION ALL SELECT feed, 1, 3, 'malformed_page' FROM n WHERE feed = 10 AND pages > 1 UNION ALL SELECT feed, 2, 3, 'malformed_page' FROM n WHERE feed = 11 AND pages > 2
  UNION ALL SELECT feed, 8 // {A_PAGE}, 3, 'malformed_record' FROM n WHERE feed = 7 AND rows_ > 8 UNION ALL SELECT feed, 3 // {A_PAGE}, 3, 'malformed_record' FROM n WHERE feed = 8 AND rows_ > 3
  UNION ALL SELECT feed, 2, 5, 'duplicate_ticker' FROM n WHERE feed = 5 AND rows_ > {2 * A_PAGE} UNION ALL SELECT feed, 7 // {A_PAGE}, 5, 'ticker_identity' FROM n WHERE feed = 6 AND rows_ > 7),
verdict AS (SELECT feed, coalesce((SELECT error FROM e WHERE e.feed = n.feed ORDER BY place, phase LIMIT 1), CASE WHEN eligible = 0 THEN 'empty_universe' ELSE '' END) AS error FROM n)"""


@query(f"WITH {FEEDS} SELECT feed, error FROM verdict")
def ticker_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which feeds of ticker pages are sound, and what spoils the others."""
    return pages.ticker_feeds(*_feeds(spark, sf_dir), MOST_PAGES, A_PAGE)[1]


@query(f"""WITH {FEEDS} SELECT c_nationkey AS feed, CASE WHEN c_acctbal < 0 THEN 'inactive' WHEN c_mktsegment = 'MACHINERY' THEN 'other_market' WHEN c_custkey % 3 = 0 THEN 'other_type' ELSE 'eligible' END AS bucket, count(*) AS n
FROM q JOIN verdict ON feed = c_nationkey AND error = '' GROUP BY 1, 2""")
def ticker_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets of the records of sound feeds."""
    return pages.ticker_feeds(*_feeds(spark, sf_dir), MOST_PAGES, A_PAGE)[0].groupBy("feed", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TICKS}, k AS (SELECT unnest(range(0, {FILES})) AS batch), b AS (SELECT k.batch, event_type AS symbol, max(floor(price / 100)) AS top FROM k JOIN ticks ON seq % {FILES} <= k.batch GROUP BY 1, 2),
c AS (SELECT batch, string_agg(symbol || ':' || top, ',' ORDER BY symbol) AS content FROM b GROUP BY 1), d AS (SELECT batch, content IS DISTINCT FROM lag(content) OVER (ORDER BY batch) AS changed FROM c),
p AS (SELECT batch, CAST(count(*) FILTER (changed) OVER (ORDER BY batch) AS BIGINT) AS publication, changed FROM d)
SELECT p.publication, p.batch AS batch_id, b.symbol, CAST(b.top AS DOUBLE) AS top FROM p JOIN b USING (batch) WHERE changed""")
def stream_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest hundred of prices by type of event, published only after the batches that change one."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    tops = lambda log, at: log.groupBy("symbol").agg(F.max(F.floor(F.col("price") / 100)).cast("double").alias("top"))  # noqa: E731, ARG005
    publishing = PublishedStream(root, tops, "sec")
    publishing.start(_split(spark, sf_dir, "event_type", root)).awaitTermination()
    return publishing.publications(spark).select("publication", F.col("batch_id").cast("bigint").alias("batch_id"), "symbol", "top")

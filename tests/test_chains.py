"""Feeds of pages against a reader that follows them one by one, ladders of trades and quotes, and publications."""

import json
import random

import pytest
from pyspark.sql import functions as F

from slotwise.operators import pages, tape
from slotwise.streaming.published import PublishedStream

MOST, RECORDS = 9, 4


def record(name, **change):
    return {"ticker": name, "active": True, "market": "stocks", "locale": "us", "type": "CS", **change}


def read_on(feeds, start):
    """The error that reading page after page meets, and the tickers read."""
    visited, seen, url, n = set(), [], start, 0
    while url:
        if n >= MOST:
            return "too_many_pages", None
        if url in visited:
            return "pagination_cycle", None
        visited.add(url)
        if url not in feeds:
            return "missing_page", None
        page = json.loads(feeds[url])
        found = page.get("results")
        if page.get("status", "OK") != "OK" or not found or page.get("count", len(found)) != len(found):
            return "malformed_page", None
        kinds = {"ticker": str, "active": bool, "market": str, "locale": str, "type": str}
        if any(type(r.get(k)) is not t for r in found for k, t in kinds.items()):
            return "malformed_record", None
        if len(found) > RECORDS:
            return "too_many_records", None
        for r in found:
            if not 1 <= len(r["ticker"].encode()) <= 64:
                return "ticker_identity", None
            if r["ticker"] in seen:
                return "duplicate_ticker", None
            seen.append(r["ticker"])
        url, n = page.get("next_url"), n + 1
    return "", seen


@pytest.mark.parametrize("seed", range(2))
def test_feeds_are_read_as_page_by_page(spark, seed):
    r = random.Random(seed)
    feeds, starts = {}, []
    for feed in range(40):
        n = r.choice([1, 2, 3, 5, 8, 9, 10, 12])
        starts.append((feed, f"{feed}/0"))
        for k in range(n):
            following = f"{feed}/{k + 1}" if k + 1 < n else r.choice([None, None, None, f"{feed}/{r.randrange(n)}", "nowhere", "0/0"])
            found = [record(f"T{feed}-{k}-{i}") for i in range(r.choice([1, 2, 4]))]
            if r.random() < 0.06:
                found[0] = r.choice([record("x", active="true"), record(7), record("x", type=None), record(""), record("é" * 33), record(f"T{feed}-0-0"), {"ticker": "x"}])
            if r.random() < 0.02:
                found += [record(f"more{i}") for i in range(9)]
            page = {"status": "OK", "count": len(found), "results": found, "next_url": following}
            if r.random() < 0.04:
                page |= r.choice([{"status": "NO"}, {"count": 99}, {"results": []}, {"results": None}])
            feeds[f"{feed}/{k}"] = json.dumps({k: v for k, v in page.items() if v is not None or k == "results"})
    table = spark.createDataFrame(list(feeds.items()), "url string, body string")
    records, verdicts = pages.ticker_feeds(table, spark.createDataFrame(starts, "feed bigint, url string"), MOST, RECORDS)
    expected = {feed: read_on(feeds, url) for feed, url in starts}
    assert {x.feed: x.error for x in verdicts.collect()} == {f: e for f, (e, _) in expected.items()}
    got = {}
    for x in records.orderBy("feed", "place", "ordinal").collect():
        got.setdefault(x.feed, []).append(x.ticker)
    assert got == {f: seen for f, (e, seen) in expected.items() if not e} and got


def test_a_feed_without_eligible_records_and_no_feeds(spark):
    body = json.dumps({"results": [record("A", active=False)]})
    table = spark.createDataFrame([("u", body)], "url string, body string")
    assert [x.error for x in pages.ticker_feeds(table, spark.createDataFrame([(1, "u")], "feed bigint, url string"))[1].collect()] == ["empty_universe"]
    assert pages.ticker_feeds(table.where("false"), spark.createDataFrame([], "feed bigint, url string"))[1].collect() == []


def test_the_ladder_of_a_trade_rate(spark):
    trades = spark.createDataFrame([("A", 98, True, "participant")], "symbol string, sec bigint, qualifying boolean, basis string")
    rows = [
        ("A", 90, True, False, False, False), ("B", None, True, False, False, False), ("C", None, False, False, False, False), ("D", 90, True, True, False, False),
        ("E", 99, True, True, False, False), ("F", 97, True, False, False, False), ("G", 90, True, True, True, False), ("H", 90, True, True, True, True),
    ]
    targets = spark.createDataFrame(rows, "symbol string, covered_from bigint, requested boolean, unequal boolean, control_error boolean, shed boolean").withColumn("at", F.lit(100).cast("bigint"))
    got = {x.symbol: (x.status, x.reason, x.rate) for x in tape.tape_rate(trades, targets).collect()}
    assert got == {
        "A": ("current", "qualifying_original_prints", 0.2), "B": ("unavailable", "channel_unconfirmed", None), "C": ("unavailable", "coverage", None), "D": ("invalid", "unequal_repeat", None),
        "E": ("invalid", "unequal_repeat", None), "F": ("warming", "five_second_warming", None), "G": ("unavailable", "control_error", None), "H": ("pressure_shed", "pressure", None),
    }


def test_the_ladder_of_a_spread(spark):
    quotes = spark.createDataFrame([("A", 1, 99, 1.0, 2.0), ("C", 1, 99, None, 2.0), ("D", 1, 99, 3.0, 2.0), ("E", 1, 90, 1.0, 2.0), ("F", 1, 99, 1.0, 2.0)], "symbol string, seq bigint, sec bigint, bid double, ask double")
    members = spark.createDataFrame([(s, s != "F", False, False) for s in "ABCDEF"] + [("G", True, True, False), ("H", True, True, True)], "symbol string, covered boolean, control_error boolean, shed boolean")
    got = {x.symbol: (x.status, x.reason, x.cents) for x in tape.spread_of_members(members, quotes, F.lit(100)).collect()}
    assert got == {
        "A": ("current", "", 100.0), "B": ("warming", "coverage_warming", None), "C": ("unavailable", "one_sided_quote", None), "D": ("invalid", "crossed_quote", None), "E": ("stale", "stale_quote", 100.0),
        "F": ("unavailable", "channel_unconfirmed", None), "G": ("unavailable", "control_error", None), "H": ("pressure_shed", "pressure", None),
    }


def test_what_counts_of_repeated_trades(spark):
    trades = spark.createDataFrame(
        [("A", 1, 7, 1.0, [3], "original", True), ("A", 2, 7, 2.0, [3], "original", True), ("B", 3, 7, 1.0, [9], "original", True), ("B", 4, 8, 1.0, [3], "odd", True), ("B", 5, 9, 1.0, [3], "original", None), ("B", 6, 7, 1.0, [3], "original", True)],
        "symbol string, seq bigint, id bigint, price double, conditions array<bigint>, lifecycle string, identity_classified boolean",
    )
    rules = spark.createDataFrame([(3, True, True)], "id bigint, updates_volume boolean, reviewed boolean")
    once, unequal = tape.counted(trades, rules, ["symbol", "id"], ["price"])
    assert sorted((x.seq, x.qualifying) for x in once.collect()) == [(1, True), (3, False), (4, False), (5, False)]
    assert [x.symbol for x in unequal.collect()] == ["A"]


def test_only_changes_are_published_and_a_retry_repeats_itself(spark, tmp_path):
    root = str(tmp_path)
    publishing = PublishedStream(root, lambda log, at: log.groupBy("k").agg(F.max("v").alias("v")), "sec")
    batch = lambda *rows: spark.createDataFrame(rows, "k string, v bigint, sec bigint")
    batches = [batch(("a", 1, 1)), batch(("a", 0, 2)), batch(("a", 5, 3)), batch(("b", 1, 4)), batch(("b", 1, 5))]
    for k, rows in enumerate(batches):
        publishing.process(rows, k)
    found = lambda: sorted((x.publication, x.batch_id, x.k, x.v) for x in publishing.publications(spark).collect())
    expected = [(1, 0, "a", 1), (2, 2, "a", 5), (3, 3, "a", 5), (3, 3, "b", 1)]
    assert found() == expected
    publishing.process(batches[3], 3)
    publishing.process(batches[4], 4)
    assert found() == expected

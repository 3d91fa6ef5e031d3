import json

from helpers import rows
from pyspark.sql import functions as F

from slotwise.sources import caches, wire

S, E = 1_785_398_400, 1_785_398_400 + 57_600


def bar(t, **change):
    return {"ev": "A", "sym": "A", "s": t * 1000, "e": t * 1000 + 1000, "o": 10, "h": 10.2, "l": 9.9, "c": 10.1, "v": 5, "vw": 10.05, "z": 25, **change}


def frame(spark, *elements, raw=None):
    payload = raw or json.dumps(elements)
    return wire.elements(spark.createDataFrame([(1, 1, float(S + 100), payload)], "epoch bigint, frame bigint, received_s double, payload string"))


def test_bars_with_reasons(spark):
    found = wire.live_bars(frame(spark, bar(S), bar(S + 1, dv="7.25"), bar(S + 2, h=9), bar(S + 3, o=-1), bar(E), bar(S, s=S * 1000 + 1)), S, E)
    got = [(r.volume, r.reject) for r in found.orderBy("position").collect()]
    assert got == [(5.0, None), (7.25, None), (5.0, "price_order"), (5.0, "price"), (5.0, "outside_session"), (5.0, "timestamp")]


def test_a_bar_without_one_symbol_fences_the_rest_of_the_frame(spark):
    for bad in ('{"ev":"A","sym":"A","sym":"B"}', '{"ev":"A"}', '{"ev":"A","sym":""}', json.dumps({"ev": "A", "sym": "x" * 65}), '{"ev":"T","ev":"A"}', "7", '{"sym":"A"}'):
        raw = "[" + json.dumps(bar(S)) + f",{bad}," + json.dumps(bar(S + 1)) + "]"
        assert frame(spark, raw=raw).count() == 1


def test_a_repeated_member_refuses_its_element_alone(spark):
    twice = json.dumps(bar(S))[:-1] + ',"o":2}'
    unknown = json.dumps(bar(S + 1))[:-1] + ',"zz":1,"zz":2}'
    trade = '{"ev":"T","sym":"A","x":1,"i":"1","p":1,"p":2,"s":1,"t":' + str((S + 5) * 1000) + "}"
    quote = '{"ev":"Q","sym":"A","bp":1,"bp":2,"t":' + str((S + 5) * 1000) + "}"
    df = frame(spark, raw="[" + ",".join([twice, unknown, trade, quote, json.dumps(bar(S + 2))]) + "]")
    assert [(r.slot - S, r.reject) for r in wire.live_bars(df, S, E).orderBy("position").collect()] == [(0, wire.REPEATED), (1, None), (2, None)]
    assert [r.reject for r in wire.trades(df, S, E).collect()] == [r.reject for r in wire.quotes(df, S, E).collect()] == [wire.REPEATED]


def test_trade_identities_and_sizes(spark):
    good = {"ev": "T", "sym": "A", "x": 4, "i": "7", "p": 10.0, "s": 3, "t": (S + 5) * 1000}
    changes = [{}, {"sym": ""}, {"sym": None}, {"x": 0}, {"x": 1.5}, {"i": ""}, {"i": "x" * 129}, {"p": 2e9}, {"p": 0}, {"p": "no"}, {"s": 0}, {"s": -1}, {"s": 0, "ds": "0.5"}, {"trfi": 1}, {"trfi": 1, "trft": 2}]
    got = wire.trades(frame(spark, *({**good, **c} for c in changes)), S, E).orderBy("position").collect()
    assert [r.reject for r in got] == [None] + ["trade_identity"] * 9 + ["size", "size", None, None, None]
    assert [r.identity_classified for r in got[-3:]] == [True, False, True]


def test_trades_and_quotes(spark):
    trade = {"ev": "T", "sym": "A", "x": 4, "i": "7", "p": 10.0, "s": 3, "ds": "3.5", "c": [37, 12], "t": (S + 5) * 1000, "pt": (S + 4) * 1000}
    late = {**trade, "pt": (S + 500) * 1000}
    quote = {"ev": "Q", "sym": "A", "bp": 10.0, "ap": 0, "t": (S + 5) * 1000}
    one = {k: v for k, v in quote.items() if k != "ap"}
    df = frame(spark, trade, late, quote, {**quote, "bp": -1}, one, {k: v for k, v in one.items() if k != "bp"}, {**one, "sym": ""}, {"ev": "status", "status": "auth_success"})
    t = wire.trades(df, S, E).orderBy("position").collect()
    assert [(r.size, r.basis, r.conditions, r.reject) for r in t] == [(3.5, "participant", [12, 37], None), (3.5, "sip_fallback", [12, 37], None)]
    assert [(r.bid, r.ask, r.reject) for r in wire.quotes(df, S, E).orderBy("position").collect()] == [(10.0, None, "quote_price"), (None, None, "quote_price"), (10.0, None, None), (None, None, "no_side"), (10.0, None, "symbol")]
    assert [r.phase for r in wire.statuses(df).collect()] == ["authenticated"]


def page(symbol, results, **change):
    return symbol, json.dumps({"adjusted": False, "status": "OK", "ticker": symbol, "resultsCount": len(results), "results": results, **change})


def test_historical_pages(spark):
    good = [{"t": (S + i) * 1000, "o": 10, "h": 10.2, "l": 9.9, "c": 10.1, "v": v, "vw": 10.05, "n": n} for i, v, n in ((0, 100.75, 4), (1, 8.5, 10), (3, 50, 2))]
    pages = [page("A", good), page("B", [*good, {**good[0], "n": 0}]), page("C", good, adjusted=True), page("D", [good[0], good[0]]), page("E", []), page("F", good[::-1])]
    found = wire.historical_bars(spark.createDataFrame(pages, "symbol string, body string"), S, E)
    assert rows(found.select("symbol", "slot", "ats")) == [("A", S, 25), ("A", S + 1, 0), ("A", S + 3, 25)]


def test_pages_follow_each_other(spark):
    rows_ = [{"t": (S + i) * 1000, "o": 10, "h": 10.2, "l": 9.9, "c": 10.1, "v": 5, "vw": 10.05, "n": 1} for i in range(4)]
    pages = [(*page("A", rows_[:2]), 0), (*page("A", rows_[2:]), 1), (*page("B", rows_[2:]), 0), (*page("B", rows_[:2]), 1), (*page("C", rows_[:2]), 0), (*page("C", rows_[1:]), 1)]
    found = wire.historical_bars(spark.createDataFrame(pages, "symbol string, body string, page int"), S, E)
    assert [(r.symbol, r.slot - S, r.page, r.ordinal) for r in found.orderBy("symbol", "slot").collect()] == [("A", 0, 0, 0), ("A", 1, 0, 1), ("A", 2, 1, 0), ("A", 3, 1, 1)]


def test_dated_caches(spark, tmp_path):
    root = str(tmp_path / "cache")
    for day in ("2026-01-02", "2026-01-05"):
        caches.publish(spark.createDataFrame([("A", day)], "symbol string, note string"), root, day)
    assert rows(caches.exact(spark, root, "2026-01-02").select("note")) == [("2026-01-02",)]
    assert rows(caches.fallback(spark, root, "2026-01-06").select("note", "use")) == [("2026-01-05", "observable")]
    assert caches.fallback(spark, root, "2026-02-06").count() == 0
    assert caches.prune(spark, root, 1).select(F.col("date").cast("string")).collect()[0][0] == "2026-01-05"


def test_old_dates_are_removed(spark, tmp_path):
    root = str(tmp_path / "cache")
    for day in ("2026-01-02", "2026-01-05", "2026-01-06"):
        caches.publish(spark.createDataFrame([("A", day)], "symbol string, note string"), root, day)
    assert caches.remove_old(spark, root, 2) == ["2026-01-02"]
    assert rows(spark.read.parquet(root).select("note")) == [("2026-01-05",), ("2026-01-06",)]
    assert caches.remove_old(spark, root, 2) == []


def test_snapshot_documents(spark):
    one = F.struct(F.lit("current").alias("status"), F.lit("").alias("reason"), F.lit(12.5).alias("value")).alias("move")
    document = json.loads(caches.snapshot_json(spark.range(1).select(F.lit("A").alias("symbol"), one)).first()[0])
    assert document == {"symbol": "A", "move": {"status": "current", "reason": "", "value": 0.125}}

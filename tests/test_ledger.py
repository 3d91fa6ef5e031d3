"""The full merge against a plain engine that takes deliveries one after another."""

import random

import pytest

from slotwise.operators import ledger

SCHEMA = """symbol string, slot bigint, seconds int, seq bigint, source string, position struct<epoch:bigint,frame:bigint,idx:bigint>,
request struct<generation:bigint,token:string,ordinal:bigint,a:bigint,b:bigint>, schema_version int, binding string, delivered bigint,
bar struct<open:double,high:double,low:double,close:double,volume:double,vwap:double,ats:bigint,provenance:string>, admission_s bigint"""
CONTROLS = "since bigint, until bigint, epoch bigint, active boolean, acknowledged boolean, ack struct<epoch:bigint,frame:bigint,idx:bigint>, lifecycle string"
SESSION = ledger.Session("s", 1000, 5000)
LIVE, REST = ledger.PROVENANCES


def bar(value, provenance=LIVE, **other):
    made = {"open": value, "high": value + 2, "low": value - 1, "close": value + 1, "volume": 5.0, "vwap": value, "ats": 3, "provenance": provenance} | other
    return tuple(made.values())


def live(seq, slot, value, frame, age=10, symbol="A", epoch=1, **changed):
    row = {"symbol": symbol, "slot": slot, "seconds": 1, "seq": seq, "source": "live", "position": (epoch, frame, 0), "request": None, "schema_version": 1, "binding": "s", "delivered": 1, "bar": bar(value), "admission_s": slot + 1 + age}
    return row | changed


def historical(seq, slot, value, age=10, generation=1, **changed):
    return live(seq, slot, value, 1, age, **({"source": "historical", "position": None, "request": (generation, "t", 1, 1000, 5000)} | changed))


ALWAYS = [(0, 10_000, 1, True, True, (1, 0, 9), "hydrating")]


def found(spark, rows, controls=ALWAYS, universe=("A", "B")):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    known = spark.createDataFrame([(u,) for u in universe], "symbol string")
    return ledger.dispositions(df, spark.createDataFrame(controls, CONTROLS), known, SESSION, 64)


def outcomes(spark, rows, **more):
    return [(r.disposition, r.reason) for r in found(spark, rows, **more).orderBy("seq").collect()]


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        (live(1, 2000, 10.0, 5), ("inserted", "")),
        (live(1, 2000, 10.0, 5, epoch=2), ("fenced", "stale_live_epoch")),
        (live(1, 2000, 10.0, 5, source="odd"), ("rejected", "lifecycle")),
        (live(1, 2000, 10.0, 5, schema_version=2), ("rejected", "schema")),
        (live(1, 2000, 10.0, 5, binding="t"), ("fenced", "binding")),
        (historical(1, 2000, 10.0, source="odd"), ("rejected", "run_source")),
        (live(1, 2000, 10.0, 5, symbol="C"), ("rejected", "symbol")),
        (live(1, 2000, 10.0, 5, symbol=None), ("rejected", "symbol")),
        (live(1, 999, 10.0, 5), ("rejected", "window")),
        (live(1, 2000, 10.0, 5, seconds=2), ("rejected", "window")),
        (live(1, 2000, 10.0, 5, bar=bar(10.0, high=9.0)), ("rejected", "structural")),
        (live(1, 2000, 10.0, 5, bar=bar(10.0, provenance="guess")), ("rejected", "structural")),
        (live(1, 2000, 10.0, 5, bar=bar(float("nan"))), ("rejected", "structural")),
        (live(1, 2000, 10.0, 5, delivered=None), ("rejected", "delivery_evidence")),
        (live(1, 2000, 10.0, 0), ("rejected", "source_position")),
        (live(1, 2000, 10.0, 5, position=(1, 5, None)), ("rejected", "aggregate_at_or_before_ack")),
        (historical(1, 2000, 10.0, request=(1, "", 1, 1000, 5000)), ("fenced", "historical_context")),
        (historical(1, 2000, 10.0, request=(1, "t", 1, 1000, 2000)), ("fenced", "historical_context")),
        (live(1, 2000, 10.0, 5, age=-1), ("rejected", "future_event_time")),
        (live(1, 2000, 10.0, 5, age=961), ("rejected", "too_late")),
        (live(10_000, 2000, 10.0, 5), ("rejected", "lifecycle")),
    ],
)
def test_each_condition(spark, row, expected):
    ack = [(0, 10_000, 1, True, True, (1, 0, 9), "hydrating")]
    if row["position"] == (1, 5, None):
        ack = [(0, 10_000, 1, True, True, (1, 5, 0), "hydrating")]
    assert outcomes(spark, [row], controls=ack) == [expected]


def test_historical_needs_a_request_in_hydration(spark):
    rows = [historical(1, 2000, 10.0), live(2, 2001, 10.0, 7)]
    assert outcomes(spark, rows, controls=[(0, 9, 1, True, True, (1, 0, 9), "live")]) == [("rejected", "lifecycle"), ("inserted", "")]
    assert outcomes(spark, rows, controls=[(0, 9, 1, True, False, None, "hydrating")]) == [("inserted", ""), ("rejected", "lifecycle")]


def test_a_folded_slot_is_closed_to_other_requests(spark):
    rows = [historical(1, 2000, 10.0, 2000), historical(2, 2000, 10.0, 2000, 2), historical(3, 2000, 10.0, 2000, 1), historical(4, 2000, 11.0, 2000, 2), historical(5, 2000, 11.0, 2000, 1)]
    assert outcomes(spark, rows) == [("inserted", ""), ("fenced", "historical_context"), ("exact_duplicate", ""), ("fenced", "historical_context"), ("withdrawn_conflict", "historical_historical_conflict")]


def test_an_integrity_break_ends_everything_after_it(spark):
    rows = [live(1, 2000, 10.0, 5), live(2, 2001, 10.0, 6, symbol="B"), live(3, 2000, 11.0, 5), live(4, 2001, 12.0, 7, symbol="B"), live(5, 2001, 13.0, 7, symbol="B"), live(6, 2002, 1.0, 0, symbol="C")]
    after = ("integrity", "repeated_position_unequal")
    assert outcomes(spark, rows) == [("inserted", ""), ("inserted", ""), after, after, after, after]
    stands = [(r.symbol, r.slot, r.bar.open, r.first_seq, r.seq) for r in ledger.canonical(found(spark, rows)).collect()]
    assert stands == [("B", 2001, 10.0, 2, 2)]


def test_the_first_evidence_of_a_bar_outlives_its_revision(spark):
    rows = [historical(1, 2000, 10.0), live(2, 2000, 11.0, 5), live(3, 2000, 11.0, 8), live(4, 2000, 11.0, 6), live(5, 2000, 12.0, 7)]
    log = found(spark, rows)
    assert [(r.disposition, r.reason) for r in log.orderBy("seq").collect()][2:] == [("exact_duplicate", ""), ("exact_duplicate", ""), ("rejected", "nonprecedent")]
    stands = ledger.canonical(log).collect()
    assert [(r.source, r.first_seq, r.seq, tuple(r.position)) for r in stands] == [("live", 1, 2, (1, 8, 0))]


def engine(rows):
    """Deliveries one after another with all state in one place; returns outcomes, standing bars and standing rejects."""
    held, conflict, broken, out, rejects = {}, set(), False, {}, set()
    for r in sorted(rows, key=lambda r: r["seq"]):
        key, is_live, late = (r["symbol"], r["slot"]), r["source"] == "live", r["admission_s"] - r["slot"] - 1 > 960
        old = held.get(key)

        def put(first, r=r, key=key, is_live=is_live):
            held[key] = {"bar": r["bar"], "live": is_live, "at": r["position"], "gen": r["request"] and r["request"][0], "first": first, "set": r["seq"]}
            if is_live:
                conflict.discard(key)
            for x in [x for x in rejects if x[0] == key[0] and x[1] <= key[1]]:
                rejects.discard(x)

        if broken:
            code = "integrity"
        elif r["bar"][1] < r["bar"][2]:
            code = "structural"
            rejects.add(key)
        elif is_live and late and not (old and old["live"]):
            code = "too_late"
        elif not is_live and old and not old["live"] and late and old["gen"] != r["request"][0]:
            code = "historical_context"
        elif not is_live and not old and key in conflict:
            code = "historical_historical_conflict"
        elif old and old["bar"] == r["bar"]:
            code = "exact_duplicate"
            if is_live:
                old["at"] = max(old["at"], r["position"]) if old["live"] else r["position"]
                old["live"] = True
        elif is_live and late:
            code = "too_late"
        elif not old:
            code = "inserted"
            put(r["seq"])
        elif not is_live and old["live"]:
            code = "historical_live_conflict"
        elif not is_live:
            code = "withdrawn_conflict"
            del held[key]
            conflict.add(key)
        elif old["live"] and r["position"] < old["at"]:
            code = "nonprecedent"
        elif old["live"] and r["position"] == old["at"]:
            code, broken = "integrity", True
            del held[key]
        else:
            code = "revised"
            put(old["first"])
        out[r["seq"]] = code
    return out, {(k[0], k[1], v["bar"][0], "live" if v["live"] else "historical", v["first"], v["set"]) for k, v in held.items()}, rejects


@pytest.mark.parametrize("seed", range(4))
def test_random_deliveries_meet_as_in_the_engine(spark, seed):
    r = random.Random(seed)
    rows = []
    for seq in range(1, 700):
        slot, value = 2000 + r.randrange(9), float(r.choice([10, 10, 10, 11]))
        symbol, age = r.choice("AABC"), r.choice([10, 10, 2000])
        if r.random() < 0.4:
            row = historical(seq, slot, value, age, r.choice([1, 2]), symbol=symbol)
        else:
            row = live(seq, slot, value, seq * 10 - r.choice([0, 0, 300]) + 400 + (0 if r.random() < 0.995 or seq < 300 else 1), age, symbol)
        if r.random() < 0.05:
            row["bar"] = bar(value, high=value - 5)
        if seq > 500 and r.random() < 0.2:
            row["position"] = row["position"] and (1, 9000, 0)
        rows.append(row)
    expected, stands, rejects = engine(rows)
    log = found(spark, rows, universe="ABC")
    got = log.collect()
    short = {"rejected": None, "fenced": None}
    assert {x.seq: short.get(x.disposition, x.disposition) or x.reason for x in got} == expected
    assert {(x.symbol, x.slot, x.bar.open, x.source, x.first_seq, x.seq) for x in ledger.canonical(log).collect()} == stands
    assert {(x.symbol, x.slot) for x in ledger.standing_rejects(log, 50).collect()} == rejects


def test_no_deliveries(spark):
    assert outcomes(spark, []) == []
    assert ledger.canonical(found(spark, [])).collect() == []
    assert ledger.standing_rejects(found(spark, [])).collect() == []


def test_only_the_columns_asked_for_are_given_and_each_delivery_is_decided_once(spark, monkeypatch):
    rows = [live(1, 2000, 10.0, 5), live(2, 2000, 11.0, 6), live(3, 2001, 10.0, 7, symbol="C"), live(4, 2001, 10.0, 8)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    written = []
    monkeypatch.setattr(ledger, "kept", lambda log, name: written.append(log.columns) or log)
    log = ledger.dispositions(df, spark.createDataFrame(ALWAYS, CONTROLS), spark.createDataFrame([("A",)], "symbol string"), SESSION, 64, ["symbol", "seq"])
    assert log.columns == ["symbol", "seq", "evidence", "disposition", "reason"] and written == [["symbol", "seq", "evidence", "outcome"]]
    assert [(r.seq, r.disposition) for r in log.orderBy("seq").collect()] == [(1, "inserted"), (2, "revised"), (3, "rejected"), (4, "inserted")]

"""Strict subsets of a binding, statuses without values, the calendar and the bound of a rule table."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from slotwise.operators import asof, coverage, dims, features, tape
from slotwise.params import ScanParams


def digest(rows):
    """The identity of a set of rows of texts."""
    hashes = sorted(hashlib.sha256("\x1f".join("\x00" if x is None else x for x in r).encode()).hexdigest() for r in rows)
    groups = {}
    for h in hashes:
        groups.setdefault(h[:3], []).append(h)
    return hashlib.sha256("".join(hashlib.sha256("".join(v).encode()).hexdigest() for _, v in sorted(groups.items())).encode()).hexdigest()


def test_subsets_of_a_binding(spark):
    facts = spark.createDataFrame([("A", "valid", 1.5), ("B", "missing", None), ("C", "valid", 2.5)], "symbol string, status string, close double")
    chosen = {"two": "AB", "other two": "AB", "one": "C", "all": "ABC", "more": "ABCD", "twice": "AA", "unknown": "AX", "none": ""}
    cases = spark.createDataFrame([(c,) for c in chosen], "case_id string")
    selected = spark.createDataFrame([(c, s) for c, symbols in chosen.items() for s in symbols], "case_id string, symbol string")
    got = {r.case_id: r for r in dims.subset_bindings(facts, cases, selected, ["status", "close"]).collect()}
    assert {c: r.reason for c, r in got.items()} == {"two": "", "other two": "", "one": "", "all": "not_strict", "more": "outside", "twice": "repeated", "unknown": "outside", "none": "empty"}
    assert got["two"].universe_identity == digest([("A",), ("B",)]) == got["other two"].universe_identity
    assert got["two"].prior_identity == digest([("A", "valid", "1.5"), ("B", "missing", None)])
    assert got["one"].n == 1 and got["one"].prior_identity == digest([("C", "valid", "2.5")])
    assert all(r.universe_identity is None and r.prior_identity is None for r in got.values() if r.reason)
    none = dims.subset_bindings(facts.where("false"), cases, selected, ["status", "close"]).collect()
    assert {r.reason for r in none} == {"outside", "repeated", "empty"}


def test_statuses_are_those_of_the_measurements(spark):
    rng = random.Random(5)
    p = ScanParams(start=0, end=4000)
    bars, gaps, conflicts, invalid = [], [], [], []
    for k in range(60):
        name = f"s{k:02}"
        seconds = sorted(rng.sample(range(700), rng.choice([0, 1, 5, 60, 400])))
        flat = k % 7 == 0
        bars += [(name, s, 5.0, 5.0, 5.0, 5.0, 10.0, 10.0, 1.0) if flat else (name, s, 5.0 + s % 3, 9.0, 4.0, 5.0 + s % 2, 10.0, 10.0, 1.0) for s in seconds]
        absent = [s for s in range(700) if s not in seconds and (k % 3 or rng.random() < 0.9)]
        gaps += [(name, s, s + 1) for s in absent]
        if k % 5 == 0:
            conflicts.append((name, 300, 310))
        if k % 4 == 0:
            invalid.append((name, rng.randrange(700)))
    bars = spark.createDataFrame(bars, "symbol string, slot bigint, open double, high double, low double, close double, volume double, ats double, vwap double")
    span = "symbol string, a bigint, b bigint"
    universe = spark.range(60).select(F.format_string("s%02d", "id").alias("symbol"))
    intervals = coverage.merged(coverage.islands(bars).unionByName(spark.createDataFrame(gaps, span)))
    given = (universe, bars, intervals, spark.createDataFrame(conflicts, span), spark.createDataFrame(invalid, "symbol string, slot bigint"))
    priors = universe.withColumn("prior_close", F.lit(4.0))
    seen = set()
    for at in (20, 200, 600):
        whole = features.measurements(*given, priors, p, at).collect()
        want = {(r.symbol, n): (r[n].status, r[n].reason) for r in whole for n in features.STATUS_ONLY}
        got = {(r.symbol, r.name): (r.status, r.reason) for r in features.statuses(*given, p, at).collect()}
        assert got == want and len(want) == 300
        seen |= set(want.values())
    assert len(seen) >= 8


def test_calendar_against_all_dates(spark):
    rng = random.Random(1)
    first = datetime.date(2020, 1, 1)
    listed = sorted({first + datetime.timedelta(rng.randrange(400)) for _ in range(120)})
    asked = [first + datetime.timedelta(k) for k in range(-20, 420)]
    dates = spark.createDataFrame([(d,) for d in listed + listed[:5]], "date date")
    wanted = spark.createDataFrame([(d,) for d in asked], "day date")
    got = {r.day: (r.session, r.prior) for r in asof.next_date(dates, wanted).collect()}
    assert got == {d: (min((x for x in listed if x >= d), default=None), max((x for x in listed if x < d), default=None)) for d in asked}
    alone = asof.next_date(dates.where("false"), wanted).collect()
    assert len(alone) == len(asked) and all(r.session is None and r.prior is None for r in alone)


def test_too_many_rules_are_refused(spark):
    rules = spark.range(tape.MOST_RULES + 1).selectExpr("id", "true as updates_volume", "true as reviewed")
    with pytest.raises(ValueError, match="reviewed rules"):
        tape.eligibility(F.col("conditions"), rules)

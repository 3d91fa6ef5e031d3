import pytest
from helpers import rows
from pyspark.sql import functions as F

from slotwise.functions import scalars
from slotwise.operators import coverage, features
from slotwise.params import ScanParams

P = ScanParams(start=0, end=1000)


def measure(spark, bars, at=330, unknown=(), conflict=(), invalid=(), prior=90.0):
    df = spark.createDataFrame([("A", s, c, c, c, c, v) for s, v, c in bars], "symbol string, slot bigint, open double, high double, low double, close double, volume double")
    names = spark.createDataFrame([("A",)], "symbol string")
    interval = "symbol string, a bigint, b bigint"
    absent = spark.createDataFrame([("A", s, s + 1) for s in range(at) if s not in unknown] or [("A", -2, -1)], interval)
    known = coverage.merged(coverage.islands(df.where(~F.col("slot").isin(list(unknown) or [-1]))).unionByName(absent))
    bad = spark.createDataFrame([("A", s, s + 1) for s in conflict] or [("A", -2, -1)], interval)
    rejected = spark.createDataFrame([("A", s) for s in invalid] or [("A", 5000)], "symbol string, slot bigint")
    priors = spark.createDataFrame([("A", prior)], "symbol string, prior_close double")
    return features.measurements(names, df, known, bad, rejected, priors, P, at).first()


STEADY = [(i, 1.0, 100.0 + i) for i in range(330)]


def test_steady_bars_in_any_order(spark):
    for bars in (STEADY, STEADY[::-1]):
        m = measure(spark, bars)
        assert m.volume.value == 330 and m.activity.value == 100
        assert m.move.value == pytest.approx(100 * (429 / 399 - 1))
        assert m.from_open.value == pytest.approx(329.0) and m.day_range.value == 100
        assert m.from_close.value == pytest.approx(100 * (429 / 90 - 1))


def test_a_revised_last_bar(spark):
    m = measure(spark, [*STEADY[:-1], (329, 0.0, 500.0)])
    assert m.volume.value == 329 and m.activity.value == 0


def test_sparse_bars_with_proven_absence(spark):
    m = measure(spark, [(299, 3.0, 10.0), (329, 7.0, 11.0)])
    assert m.volume.value == 10 and m.activity.value == 100 and m.move.value == pytest.approx(10)


def test_unknown_second_and_conflict(spark):
    m = measure(spark, [b for b in STEADY if b[0] != 100], unknown=(100,))
    assert (m.volume.status, m.volume.reason, m.volume.value) == ("unavailable", "history_incomplete", None)
    assert m.activity.status == "unavailable" and m.move.status == "current"
    m = measure(spark, STEADY, conflict=(50,))
    assert (m.volume.status, m.volume.reason) == ("invalid", "historical_conflict")


def test_warming_invalid_and_prior(spark):
    m = measure(spark, STEADY[:20], at=20)
    assert m.move.status == "warming" and m.activity.reason == "reference_warmup"
    m = measure(spark, STEADY[:329], invalid=(329,), prior=None)
    assert m.volume.reason == "invalid_input" and m.move.status == "invalid" and m.from_close.reason == "prior_close_unavailable"


def test_no_bars_and_zero_width(spark):
    m = measure(spark, [(10, 1.0, 5.0)])
    assert (m.day_range.status, m.day_range.reason) == ("unavailable", "zero_width")


def test_interval_algebra(spark):
    interval = "symbol string, a bigint, b bigint"
    have = spark.createDataFrame([("A", 0, 10), ("A", 20, 30), ("A", 8, 12)], interval)
    assert rows(coverage.merged(have)) == [("A", 0, 12), ("A", 20, 30)]
    holes = spark.createDataFrame([("A", 5, 6), ("A", 11, 25)], interval)
    assert rows(coverage.subtracted(coverage.merged(have), holes)) == [("A", 0, 5), ("A", 25, 30), ("A", 6, 11)]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(scalars.floor_ratio(F.lit(v), F.lit(n))) for v, n in ((100.75, 4), (8.5, 10), (50.0, 2))] == [25, 0, 25]
    assert [value(scalars.exact_integer(F.lit(x))) for x in ("1e3", "5.0", "5.5", "x")] == [1000, 5, None, None]
    assert value(scalars.is_plain_decimal(F.lit("1.5"))) and not value(scalars.is_plain_decimal(F.lit("-1.5")))
    assert value(scalars.range_position(F.lit(5.0), F.lit(5.0), F.lit(5.0))) is None
    assert value(scalars.percent_change(F.lit(float("nan")), F.lit(1.0))) is None
    assert [value(scalars.share_text(F.lit(x))) for x in (1234567.0, 999950.0, 1500.0, 12.5)] == ["1.2M", "1M", "1.5K", "12.5"]
    assert value(scalars.signed_percent(F.lit(0.0512))) == "+5.12%"
    assert value(scalars.backoff_seconds(F.lit(4), 0.5, 3.0)) == 3.0


def test_coverage_of_many_spans_and_intervals_is_one_sweep(spark):
    """57,600 slots of one symbol, every other one covered: no pairing of slots with intervals."""
    import time

    from pyspark.sql import functions as F

    from slotwise.operators import coverage

    n = 57_600
    every = spark.range(0, n, 2).select(F.lit("A").alias("symbol"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    none = every.where("false")
    slots = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("slot"))
    began = time.time()
    assert {r["class"]: r["count"] for r in coverage.slot_class(every, none, none, slots).groupBy("class").count().collect()} == {"present": n // 2, "unknown": n // 2}
    spans = slots.select("symbol", F.col("slot").alias("lo"), (F.col("slot") + 60).alias("hi"))
    conflicts = every.where("a = 100").unionByName(every.where("a = 100"))
    got = coverage.covered(every, conflicts, spans).groupBy("covered", "conflicted").count().collect()
    # The last spans reach beyond the last slot; the sixty that hold slot 100 are in conflict.
    assert sum(r["count"] for r in got) == n and sum(r["count"] for r in got if r["conflicted"]) == 60
    assert {r["covered"] for r in got} == set(range(1, 31)) | {0}
    assert time.time() - began < 60


def test_coverage_against_slots_counted_one_by_one(spark):
    import random

    from slotwise.operators import coverage

    r = random.Random(4)
    intervals, conflicts = [], [("A", 30, 33), ("A", 31, 35), ("B", 5, 6)]
    for symbol in "AB":
        at = 0
        while at < 90:
            a = at + r.randrange(1, 4)
            at = a + r.randrange(1, 6)
            intervals.append((symbol, a, at))
    spans = sorted({(s, lo := r.randrange(100), lo + r.randrange(20)) for s in "ABC" for _ in range(60)})
    kind = "symbol string, a bigint, b bigint"
    got = coverage.covered(spark.createDataFrame(intervals, kind), spark.createDataFrame(conflicts, kind), spark.createDataFrame(spans, "symbol string, lo bigint, hi bigint")).collect()
    inside = lambda rows, s, lo, hi: len({x for t, a, b in rows if t == s for x in range(a, b) if lo <= x < hi})
    expected = [(s, lo, hi, c := inside(intervals, s, lo, hi), c == hi - lo and not (x := inside(conflicts, s, lo, hi)), x > 0 if c == hi - lo else inside(conflicts, s, lo, hi) > 0) for s, lo, hi in spans]
    assert sorted(tuple(x) for x in got) == expected


def test_marks_are_carried_over_corrections_and_withdrawals(spark):
    import random

    from slotwise.operators import asof

    r = random.Random(6)
    kind, marked = "symbol string, slot bigint, close double", "symbol string, mark_slot bigint, mark_close double"
    stands, marks, since = {}, [], 0
    for step in range(5):
        at, changed = since + 10, set()
        for _ in range(12):
            key = (r.choice("ABCD"), r.randrange(0, at + 5))
            changed.add(key)
            if key in stands and r.random() < 0.6:
                del stands[key]
            else:
                stands[key] = float(r.randrange(100))
        # Withdraw a mark now and then.
        for symbol, slot, _ in marks:
            if r.random() < 0.4:
                stands.pop((symbol, slot), None)
                changed.add((symbol, slot))
        bars_now = spark.createDataFrame([(s, t, c) for (s, t), c in stands.items()], kind)
        got = asof.marks_carried(spark.createDataFrame(marks, marked), bars_now, spark.createDataFrame(sorted(changed), "symbol string, slot bigint"), since, at)
        marks = sorted((x.symbol, x.mark_slot, x.mark_close) for x in got.collect())
        assert marks == sorted((s, t, stands[s, t]) for s in "ABCD" if (t := max((b for a, b in stands if a == s and b < at), default=None)) is not None)
        since = at

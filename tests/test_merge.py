import random

import pytest

from slotwise.operators import merge

SCHEMA = "symbol string, slot bigint, seq bigint, source string, position bigint, bar struct<value:double>, admission_s bigint, end_s bigint"


def run(spark, deliveries):
    """deliveries: (source, position, value, age); each is admitted in turn."""
    made = [("A", 0, i, s, p, (v,), 1000, 1000 - age) for i, (s, p, v, age) in enumerate(deliveries)]
    df = spark.createDataFrame(made, SCHEMA)
    log = [(r.disposition, r.reason) for r in merge.dispositions(df).orderBy("seq").collect()]
    stands = merge.canonical(df).collect()
    return log, (stands[0].source, stands[0].value) if stands else None


L, H = "live", "historical"


@pytest.mark.parametrize(
    ("deliveries", "last", "stands"),
    [
        ([(L, 1, 1.0, 1)], ("inserted", ""), (L, 1.0)),
        ([(L, 1, 1.0, -1)], ("rejected", "future_event_time"), None),
        ([(L, 1, 1.0, 961)], ("rejected", "too_late"), None),
        ([(L, 1, 1.0, 960)], ("inserted", ""), (L, 1.0)),
        ([(H, None, 1.0, 5000)], ("inserted", ""), (H, 1.0)),
        ([(L, 1, 1.0, 1), (L, 2, 1.0, 1)], ("exact_duplicate", ""), (L, 1.0)),
        ([(L, 1, 1.0, 1), (L, 2, 2.0, 961)], ("rejected", "too_late"), (L, 1.0)),
        ([(H, None, 1.0, 1), (L, 1, 2.0, 1)], ("revised", ""), (L, 2.0)),
        ([(L, 2, 1.0, 1), (L, 1, 2.0, 1)], ("rejected", "nonprecedent"), (L, 1.0)),
        ([(L, 1, 1.0, 1), (L, 1, 2.0, 1)], ("withdrawn_integrity", ""), None),
        ([(L, 1, 1.0, 1), (L, 2, 2.0, 1)], ("revised", ""), (L, 2.0)),
        ([(L, 1, 1.0, 1), (H, None, 2.0, 1)], ("rejected", "historical_live_conflict"), (L, 1.0)),
        ([(H, None, 1.0, 1), (H, None, 2.0, 1)], ("withdrawn_conflict", ""), None),
        ([(H, None, 1.0, 1), (H, None, 2.0, 1), (H, None, 1.0, 1)], ("rejected", "historical_historical_conflict"), None),
        ([(H, None, 1.0, 1), (H, None, 2.0, 1), (L, 1, 3.0, 1)], ("inserted", ""), (L, 3.0)),
        ([(H, None, 1.0, 1), (L, 5, 1.0, 1), (L, 4, 2.0, 1)], ("rejected", "nonprecedent"), (L, 1.0)),
    ],
)
def test_decisions(spark, deliveries, last, stands):
    log, found = run(spark, deliveries)
    assert log[-1] == last and found == stands


def test_live_positions_win_in_any_order(spark):
    deliveries = [(L, p, float(p), 1) for p in range(6)]
    for seed in range(3):
        random.Random(seed).shuffle(deliveries)
        assert run(spark, deliveries)[1] == (L, 5.0)


def test_an_identity_of_any_size_is_never_gathered(spark):
    n = 25_000  # more than two batches
    made = [("A", 0, i, L, i, (float(i),), 1000, 999) for i in range(n)]
    made += [("B", s, 0, H, None, (float(s),), 1000, 999) for s in range(5)]
    made += [("C", 0, i, H, None, (float(i > 0),), 1000, 999) for i in range(n)]
    df = spark.createDataFrame(made, SCHEMA)
    for made in (merge.dispositions(df), merge.merged(df)):
        plan = made._jdf.queryExecution().executedPlan().toString().lower()
        assert "collect_list" not in plan
    found = {(r.symbol, r.disposition, r.reason): r["count"] for r in merge.dispositions(df).groupBy("symbol", "disposition", "reason").count().collect()}
    conflict = ("rejected", "historical_historical_conflict")
    assert found == {("A", "inserted", ""): 1, ("A", "revised", ""): n - 1, ("B", "inserted", ""): 5, ("C", "inserted", ""): 1, ("C", "withdrawn_conflict", ""): 1, ("C", *conflict): n - 2}
    stands = sorted((r.symbol, r.slot, r.value) for r in merge.canonical(df.repartition(1)).collect())
    assert stands == [("A", 0, n - 1.0), *(("B", s, float(s)) for s in range(5))]
    assert [(r.symbol, r.slot) for r in merge.conflict_slots(df).collect()] == [("C", 0)]


def test_one_sort_serves_an_identity(spark):
    df = spark.createDataFrame([("A", 0, 0, L, 1, (1.0,), 1000, 999)], SCHEMA)
    for made in (merge.dispositions(df), merge.canonical(df)):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Sort [") == 1 and "Window" not in plan


@pytest.mark.parametrize("kind", ["struct<value:double,name:string>", "struct<value:double,name:string,day:date>"])
@pytest.mark.parametrize("place", ["bigint", "double"])
def test_bars_are_equal_as_spark_has_it_and_ranks_agree(spark, kind, place):
    nan, day = float("nan"), (None,) * kind.count("day")
    bars = [None, (nan, "x"), (-nan, "x"), (0.0, None), (-0.0, None), (0.0, ""), (None, None)]
    made = [("A", k, n, L, n, bar and (*bar, *day), 1000, 999) for k, pair in enumerate([(1, 2), (3, 4), (4, 5), (6, 6), (6, 3), (0, 1)]) for n, bar in enumerate(bars[p] for p in pair)]
    df = spark.createDataFrame(made, SCHEMA.replace("struct<value:double>", kind))
    df = df.withColumn("position", df.position.cast(place))
    log = {(r.slot, r.seq): r.disposition for r in merge.dispositions(df).collect()}
    assert [log[k, 1] for k in range(6)] == ["exact_duplicate", "exact_duplicate", "revised", "exact_duplicate", "revised", "inserted"]

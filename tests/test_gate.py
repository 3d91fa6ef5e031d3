from dataclasses import replace

import pytest
from helpers import rows
from pyspark.sql import functions as F

from slotwise.operators import gate
from slotwise.params import GateParams

P = GateParams()


def bars(spark, slots, **fixed):
    base = {"close": 10.0, "volume": 500.0, "vwap": 10.0, "ats": 25}
    made = [("A", s, *({**base, **fixed}[k] for k in base)) for s in slots]
    return spark.createDataFrame(made, "symbol string, slot bigint, close double, volume double, vwap double, ats bigint")


def facts_at(df, end, last=None):
    return gate.gate_facts(df, P, 0, last or end).where(F.col("end") == end).first()


def test_full_window(spark):
    f = facts_at(bars(spark, range(60)), 60)
    assert (f.present, f.longest_gap) == (60, 0)
    assert f.trades == pytest.approx(1200) and f.short_trades == pytest.approx(100) and f.dollar_volume == pytest.approx(300_000) and f.concentration == pytest.approx(1 / 60)


def test_a_bar_at_the_end_changes_nothing(spark):
    a, b = facts_at(bars(spark, range(60)), 60), facts_at(bars(spark, range(61)), 60, 61)
    assert a == b


@pytest.mark.parametrize(("missing", "gap"), [({0, 1, 2}, 3), ({30, 31, 32}, 3), ({57, 58, 59}, 3), ({0, 1, 2, 3}, 4)])
def test_gaps_count_edges(spark, missing, gap):
    assert facts_at(bars(spark, [s for s in range(60) if s not in missing]), 60).longest_gap == gap


def test_a_window_ends_at_most_a_gap_after_a_bar(spark):
    ends = [r.end for r in gate.gate_facts(bars(spark, [0, 10]), P, 0, 60).collect()]
    assert sorted(ends) == [1, 2, 3, 4, 11, 12, 13, 14]


def test_unrated_bars_make_trades_unavailable(spark):
    df = bars(spark, range(60)).withColumn("ats", F.when(F.col("slot") == 10, 0).otherwise(F.col("ats")))
    f = facts_at(df, 60)
    assert f.trades is None and f.short_trades == pytest.approx(100)


GOOD = {"price": 0.25, "present": 45, "longest_gap": 3, "trades": 1000.0, "short_trades": 100.0, "dollar_volume": 250_000.0, "concentration": 0.5}


@pytest.mark.parametrize(
    ("change", "passes"),
    [({}, True), ({"price": 0.2499}, False), ({"present": 44}, False), ({"longest_gap": 4}, False), ({"trades": 999.99}, False), ({"trades": None}, False), ({"short_trades": 99.9}, False), ({"dollar_volume": 249_999.9}, False), ({"concentration": 0.5000001}, False)],
)
def test_thresholds_are_inclusive(spark, change, passes):
    row = {**GOOD, **change}
    df = spark.createDataFrame([tuple(row.values())], "price double, present int, longest_gap int, trades double, short_trades double, dollar_volume double, concentration double")
    assert df.select(gate.passes(P)).first()[0] is passes


def test_rolling_facts_equal_a_recomputation(spark):
    slots = [s for s in range(180) if s % 7 and s % 11]
    df = bars(spark, slots).withColumn("volume", 500.0 + F.col("slot") % 13).withColumn("ats", F.when(F.col("slot") % 31 == 0, 0).otherwise(25))
    p = replace(P, window=20)
    got = {r.end: (r.present, r.longest_gap, r.trades) for r in gate.gate_facts(df, p, 0, 180).collect()}
    for end, (present, gap, trades) in got.items():
        inside = [s for s in slots if end - 20 <= s < end]
        edges = [end - 21, *inside, end]
        assert present == len(inside) and gap == max(b - a - 1 for a, b in zip(edges, edges[1:], strict=False))
        want = None if any(s % 31 == 0 for s in inside) else sum((500 + s % 13) / 25 for s in inside)
        assert trades == (None if want is None else pytest.approx(want))


def test_first_pass_and_status(spark):
    df = bars(spark, range(70))
    proofs = gate.first_pass(gate.gate_facts(df, P, 0, 70), P, 70, 5)
    # With the first seconds of the session missing, a window passes from 57 on.
    assert rows(proofs.select("first_pass", "finalized_at")) == [(57, 57)]
    names = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    covered = spark.createDataFrame([("A", True), ("B", True), ("C", False)], "symbol string, exact boolean")
    status = gate.qualification_status(names, proofs, covered).select("symbol", "qualification")
    assert rows(status) == [("A", "finalized"), ("B", "not_yet_passed"), ("C", "unresolved")]

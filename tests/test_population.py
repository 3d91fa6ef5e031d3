"""The population's evaluation, its rules and the masking by a stale watermark, against plain loops."""

import random

import pytest

from slotwise.operators import bars, gate, population
from slotwise.params import GateParams, ScanParams

GATE = GateParams(window=12, short_window=3, min_present=6, max_gap=3, min_trades=3.0, min_short_trades=0.5, min_dollar_volume=50.0, max_concentration=0.6)
P = ScanParams(start=0, end=120, gate=GATE)


@pytest.mark.parametrize("seed", range(2))
def test_one_pass_finds_what_the_separate_ones_do(spark, seed):
    r = random.Random(seed)
    ticks = [(s, slot, k, r.choice([1.0, 2.0, 0.1]), r.choice([0, 1, 5, 20])) for s in "ABC" for slot in range(-5, 130) for k in range(r.choice([0, 1, 1, 2]))]
    ticks = [(s, sec, i, p, n) for i, (s, sec, _, p, n) in enumerate(ticks)]
    b = bars.from_ticks(spark.createDataFrame(ticks, "symbol string, sec bigint, seq bigint, price double, size bigint"), 1).cache()
    proofs = {r.symbol: (r.first_pass, r.last_pass, r.proofs, r.finalized_at) for r in gate.first_pass(gate.gate_facts(b, GATE, 0, 100), GATE, 100, 30).collect()}
    scan = {r.symbol: r for r in population.scanned(b, P, 100, 100, 30).collect()}
    assert {s: (r.first_pass, r.last_pass, r.proofs, r.finalized_at) for s, r in scan.items() if r.proofs} == proofs and proofs
    inside = [x for x in b.collect() if 0 <= x.slot < 100]
    for s, r in scan.items():
        mine = sorted((x for x in inside if x.symbol == s), key=lambda x: x.slot)
        assert (r.volume, r.first_open, r.high, r.low, tuple(r.mark)) == (sum(x.volume for x in mine), mine[0].open, max(x.high for x in mine), min(x.low for x in mine), (mine[-1].slot, mine[-1].close))


def test_where_symbols_fall(spark):
    universe = spark.createDataFrame([(s,) for s in "ABCDEFGHI"], "symbol string")
    scan = spark.createDataFrame(
        [(s, f, f, (5, c)) for s, f, c in (("A", None, 2.0), ("B", 3, 2.0), ("C", None, 0.1), ("D", None, float("nan")), ("H", 3, 2.0), ("I", None, 2.0))],
        "symbol string, first_pass bigint, finalized_at bigint, mark struct<slot:bigint,close:double>",
    )
    priors = spark.createDataFrame([(s, 1.0) for s in "ABCDEFGI"], "symbol string, prior_close double")
    coverage = spark.createDataFrame([("A", None, False, False, True), ("F", None, False, True, False), ("I", "bootstrap_origin", True, False, False), ("B", "post_bootstrap_gap", False, False, False)], "symbol string, unknown string, trusted boolean, no_print boolean, exact boolean")
    invalid = spark.createDataFrame([("E", 4)], "symbol string, slot bigint")
    rows = population.evaluated(universe, scan, priors, coverage, invalid, 10, 0.25)
    got = {r.symbol: (r.bucket, r.origin, r.qualification) for r in rows.collect()}
    unknown = "unknown_due_failure_or_fence"
    assert got == {
        "A": ("trusted_rankable_mark", None, "not_yet_passed"), "B": (unknown, "post_bootstrap_gap", None), "C": ("trusted_below_price_mark", None, None), "D": (unknown, "local_invalid", None), "E": ("invalid_mark", None, None),
        "F": ("no_print_through_t", None, None), "G": (unknown, "local_invalid", None), "H": ("invalid_or_missing_prior_close", None, None), "I": ("trusted_rankable_mark", "bootstrap_origin", "unresolved"),
    }
    counts = population.accounting(rows)
    assert population.broken_identities(counts).collect() == []
    one = counts.first()
    assert (one["mode"], one["reason"], one["total_passers"], one["known_rankable"], one["local_invalid"]) == ("degraded_current", "incomplete_population", 0, 2, 2)


@pytest.mark.parametrize("column", [*population.BUCKETS, *population.QUALIFICATIONS, *population.ORIGINS, "total_passers", "known_rankable"])
def test_every_count_is_held_by_an_identity(spark, column):
    universe = spark.createDataFrame([("A",)], "symbol string")
    scan = spark.createDataFrame([("A", 1, 1, (5, 1.0))], "symbol string, first_pass bigint, finalized_at bigint, mark struct<slot:bigint,close:double>")
    none = spark.createDataFrame([], "symbol string, unknown string, trusted boolean, no_print boolean, exact boolean")
    counts = population.accounting(population.evaluated(universe, scan, spark.createDataFrame([("A", 1.0)], "symbol string, prior_close double"), none, spark.createDataFrame([], "symbol string, slot bigint"), 10, 0.25))
    assert population.broken_identities(counts).count() == 0
    assert population.broken_identities(counts.withColumn(column, counts[column] + 1)).count() > 0


def test_an_empty_population(spark):
    universe = spark.createDataFrame([], "symbol string")
    empty = "symbol string, unknown string, trusted boolean, no_print boolean, exact boolean"
    scan = spark.createDataFrame([], "symbol string, first_pass bigint, finalized_at bigint, mark struct<slot:bigint,close:double>")
    rows = population.evaluated(universe, scan, spark.createDataFrame([], "symbol string, prior_close double"), spark.createDataFrame([], empty), spark.createDataFrame([], "symbol string, slot bigint"), 10, 0.25)
    assert rows.count() == 0 and population.broken_identities(population.accounting(rows)).count() == 0


def watched(samples):
    """hold and boundary of each sample, one after another."""
    hold, since, boundary, out = False, None, None, []
    for _, _, at, stale, ready, mark in samples:
        if stale:
            hold, since, boundary = True, None, None
        elif hold and ready and mark is not None:
            if since is None:
                since, boundary = at, mark
            elif at - since >= 5 and mark >= boundary + 5:
                hold = False
        elif hold:
            since, boundary = None, None
        out.append((hold, boundary))
        if not hold:
            since, boundary = None, None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_masking_follows_the_snapshots_one_by_one(spark, seed):
    r = random.Random(seed)
    rows = []
    for key in "AB":
        at = mark = 0
        for seq in range(300):
            at += r.choice([1, 1, 2])
            mark += r.choice([0, 1, 2, 3])
            rows.append((key, seq, at, r.random() < 0.04, r.random() < 0.93, None if r.random() < 0.03 else mark))
    df = spark.createDataFrame(rows, "key string, seq bigint, sampled_s bigint, stale boolean, ready boolean, watermark_s bigint")
    got = [(x.hold, x.boundary_s) for x in population.masked_by_stale_watermark(df).orderBy("key", "seq").collect()]
    expected = watched([x for x in rows if x[0] == "A"]) + watched([x for x in rows if x[0] == "B"])
    assert got == expected

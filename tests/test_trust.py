"""The live fence, later marks, withdrawals from a prefix and sealed bars on hand-made rows."""

from slotwise.operators import bars, coverage, merge

INTERVAL, SLOTS = "symbol string, a bigint, b bigint", "symbol string, slot bigint"


def test_live_fence_extension(spark):
    names = [("exact", None), ("none", None), ("gap", None), ("rejected", None), ("before", None), ("conflict", None), ("old", "unknown_failure_or_fence")]
    universe = spark.createDataFrame(names, "symbol string, unknown string")
    known = spark.createDataFrame([(s, 0, 9 if s == "gap" else 10) for s, _ in names], INTERVAL)
    conflicts = spark.createDataFrame([("conflict", 3, 4)], INTERVAL)
    invalid = spark.createDataFrame([("rejected", 10), ("before", 9)], SLOTS)
    marks = spark.createDataFrame([("exact", 4), ("before", 19), ("gap", 5), ("none", 20), ("none", -1), ("old", 3)], SLOTS)
    got = {r.symbol: r.consequence for r in coverage.extended(universe, known, conflicts, invalid, marks, 0, 10, 20).collect()}
    unknown = "unknown_post_bootstrap"
    assert got == {"exact": "none", "none": "no_print_through_t", "gap": unknown, "rejected": unknown, "before": "none", "conflict": unknown, "old": "unknown_failure_or_fence"}
    assert coverage.extended(universe.where("false"), known, conflicts, invalid, marks, 0, 10, 20).count() == 0


def test_later_mark_decision(spark):
    names = ["known", "no_mark", "historical", "conflict", "conflict_before", "invalid", "gap", "trusted"]
    universe = spark.createDataFrame([(s, s != "known") for s in names], "symbol string, unknown boolean")
    marks = spark.createDataFrame([(s, 5, s != "historical") for s in names if s != "no_mark"] + [("no_mark", 20, True), ("historical", 4, True)], "symbol string, slot bigint, live boolean")
    known = spark.createDataFrame([(s, 5, 19 if s == "gap" else 20) for s in names], INTERVAL)
    conflicts = spark.createDataFrame([("conflict", 19, 25), ("conflict_before", 0, 5)], INTERVAL)
    invalid = spark.createDataFrame([("invalid", 5), ("trusted", 4), ("trusted", 20)], SLOTS)
    got = {r.symbol: r.decision for r in coverage.later_mark_decision(universe, known, conflicts, invalid, marks, 0, 20).collect()}
    assert got == {
        "known": "not_applicable", "no_mark": "no_later_eligible_mark", "historical": "latest_mark_not_live", "conflict": "conflict_at_or_after_mark",
        "conflict_before": "trusted_by_later_live_mark", "invalid": "invalid_at_or_after_mark", "gap": "incomplete_post_mark_coverage", "trusted": "trusted_by_later_live_mark",
    }


def test_withdrawals_from_a_prefix(spark):
    rows = [("A", 1, 10.0, 12.0, 9.0, 11.0, 5), ("A", 2, 11.0, 20.0, 10.0, 15.0, 7), ("A", 3, 15.0, 16.0, 5.0, 6.0, 3), ("B", 1, 1.0, 2.0, 1.0, 2.0, 4)]
    b = spark.createDataFrame(rows, "symbol string, slot bigint, open double, high double, low double, close double, volume bigint")
    prefix = bars.folded_prefix(b, 10)

    def after(slots):
        return {r.symbol: tuple(r)[1:] for r in bars.without_withdrawn(prefix, b.where(b.slot.isin(slots) & (b.symbol == "A"))).drop("first_slot", "latest_slot").collect()}

    whole = after([])
    assert whole == {"A": (15, 3, 10.0, 20.0, 5.0, 6.0, True, True, True), "B": (4, 1, 1.0, 2.0, 1.0, 2.0, True, True, True)}
    assert after([1])["A"] == (10, 2, None, 20.0, 5.0, 6.0, False, True, True)
    assert after([2])["A"] == (8, 2, 10.0, None, None, 6.0, True, False, True)
    assert after([1, 2, 3]) == {"A": (0, 0, None, None, None, None, False, False, False), "B": whole["B"]}
    # The same bar withdrawn from a prefix that holds less than it never makes the volume negative.
    twice = b.where("symbol = 'B'").unionByName(b.where("symbol = 'B'"))
    assert [r.volume for r in bars.without_withdrawn(prefix, twice).where("symbol = 'B'").collect()] == [0]


def test_sealed_bars(spark):
    schema = "symbol string, slot bigint, bar struct<close:double,volume:bigint>"
    historical = spark.createDataFrame([("A", 1, (1.0, 2)), ("A", 2, (1.0, None)), ("A", 3, (1.0, 2)), ("B", 1, (1.0, 2))], schema)
    sealed = spark.createDataFrame([("A", 1, (1.0, 2)), ("A", 2, (1.0, None)), ("A", 3, (1.5, 2))], schema)
    got = sorted(tuple(r) for r in merge.against_sealed(historical, sealed).collect())
    assert got == [("A", 1, "equal"), ("A", 2, "equal"), ("A", 3, "different"), ("B", 1, "unmatched")]


def test_more_withdrawn_than_held_leaves_nothing_below_zero_and_folds_on(spark):
    from slotwise.operators import bars

    kind = "symbol string, slot bigint, open double, high double, low double, close double, volume bigint"
    held = spark.createDataFrame([("A", 1, 1.0, 3.0, 1.0, 2.0, 5)], kind)
    gone = spark.createDataFrame([("A", 1, 5, 3.0, 1.0), ("A", 2, 9, 3.0, 1.0)], "symbol string, slot bigint, volume bigint, high double, low double")
    left = bars.without_withdrawn(bars.folded_prefix(held, 10), gone)
    assert [(r.volume, r.prints, r.open_trusted, r.latest_trusted) for r in left.collect()] == [(0, 0, False, False)]
    tail = bars.folded_prefix(spark.createDataFrame([("A", 11, 4.0, 6.0, 4.0, 5.0, 7), ("B", 3, 1.0, 1.0, 1.0, 1.0, 1)], kind), 20)
    on = {r.symbol: r for r in bars.continued(left, tail).collect()}
    assert (on["A"].volume, on["A"].prints, on["A"].first_open, on["A"].high, on["A"].latest_close) == (7, 1, None, None, 5.0)
    assert (on["A"].open_trusted, on["A"].extrema_trusted, on["A"].latest_trusted) == (False, False, True)
    assert (on["B"].first_open, on["B"].extrema_trusted) == (1.0, True)


def test_history_behind_the_fence(spark):
    names = ["complete", "not_needed", "failed", "unasked", "silent", "hole", "conflict", "rejected"]
    universe = spark.createDataFrame([(n,) for n in names], "symbol string")
    requests = spark.createDataFrame([(n, n if n in ("not_needed", "failed") else "complete") for n in names if n != "unasked"] + [("other", "complete")], "symbol string, outcome string")
    span = "symbol string, a bigint, b bigint"
    intervals = spark.createDataFrame([(n, 0, 40 if n == "hole" else 50) for n in names], span)
    conflicts, invalid = spark.createDataFrame([("conflict", 3, 5)], span), spark.createDataFrame([("rejected", 60), ("complete", 20)], "symbol string, slot bigint")
    marks = spark.createDataFrame([(n, 30) for n in names if n != "silent"] + [("silent", 120)], "symbol string, slot bigint")
    for recovery, unknown in ((False, "unknown_failure_or_fence"), (True, "unknown_post_bootstrap")):
        found = coverage.reconciled(universe, requests, intervals, conflicts, invalid, marks, 0, 50, 100, recovery)
        want = dict.fromkeys(names, unknown) | {"complete": "none", "not_needed": "none", "silent": "no_print_through_t"}
        assert {r.symbol: r.consequence for r in found.collect()} == want
        assert tuple(coverage.settled(found, recovery).first()) == (5, not recovery)
    assert tuple(coverage.settled(found.where("consequence = 'none'"), True).first()) == (0, True)

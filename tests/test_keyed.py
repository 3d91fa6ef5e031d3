"""Keyed stream state against the batch operators, for streams split into files in several ways."""

import random

import pytest
from pyspark.sql import functions as F

from slotwise.operators import bars, gate, tape
from slotwise.params import GateParams
from slotwise.streaming import keyed

GATE = GateParams(window=12, short_window=3, min_present=6, max_gap=3, min_trades=3.0, min_short_trades=0.5, min_dollar_volume=50.0, max_concentration=0.6)
TICKS = "symbol string, sec bigint, seq bigint, price double, size bigint"


def stream(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/file={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def made_ticks(seed, slots=120):
    r = random.Random(seed)
    rows, seq = [], 0
    for symbol in "AB":
        for slot in range(slots):
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                seq += 1
                rows.append((symbol, slot * 10 + r.randrange(10), seq, r.choice([1.0, 2.0, 0.1, -1.0]), r.choice([0, 1, 5, 20])))
    return rows


def batch_answer(spark, rows):
    b = bars.from_ticks(spark.createDataFrame(rows, TICKS), 10)
    found = gate.first_pass(gate.gate_facts(b, GATE, 0, 120), GATE, 120, 30)
    return sorted((r.symbol, r.first_pass, r.last_pass, r.proofs, r.finalized_at) for r in found.collect())


def stream_answer(spark, tmp_path, batches, keep):
    found = keyed.qualified(stream(spark, tmp_path, batches, TICKS), GATE, 10, 0, 120, keep, 120, 30)
    last = keyed.latest_updates(found, str(tmp_path), ["symbol"]).collect()
    return sorted((r.symbol, r.first_pass, r.last_pass, r.proofs, r.finalized_at) for r in last if r.proofs), {r.symbol: r.late for r in last}


@pytest.mark.parametrize("seed", range(3))
def test_qualification_does_not_depend_on_the_split(spark, tmp_path, seed):
    """Files of ticks in any order: each corrects bars of the ones before, proofs come and go."""
    rows = made_ticks(seed)
    r = random.Random(seed)
    batches = [[], [], [], []]
    for row in rows:
        r.choice(batches).append(row)
    got, late = stream_answer(spark, tmp_path, batches, 200)
    assert got == batch_answer(spark, rows)
    assert got and not any(late.values())


def test_old_slots_are_folded_and_recent_ones_corrected(spark, tmp_path):
    """Files in order of time, each with corrections up to 30 slots back; bars older than that are gone from the state."""
    rows = made_ticks(7)
    r = random.Random(7)
    batches = [[] for _ in range(6)]
    for row in rows:
        k = row[1] // 10 // 20
        batches[min(k + (r.random() < 0.3), 5)].append(row)
    got, late = stream_answer(spark, tmp_path, batches, 45)
    assert got == batch_answer(spark, rows)
    assert not any(late.values())


def test_ticks_behind_the_fold_are_counted_not_used(spark, tmp_path):
    rows = made_ticks(9)
    old = [("A", 5, 10_000 + k, 1.0, 500) for k in range(3)]
    got, late = stream_answer(spark, tmp_path, [rows, old], 30)
    assert got == batch_answer(spark, rows)
    assert late["A"] == 3


def test_a_correction_revokes_a_proof(spark, tmp_path):
    rows = [("A", slot * 10, slot, 1.0, 20) for slot in range(12)]
    first, _ = stream_answer(spark, tmp_path / "a", [rows], 200)
    assert first[0][:2] == ("A", 9)
    big = [("A", 5 * 10 + 1, 99, 1.0, 10_000)]
    again, _ = stream_answer(spark, tmp_path / "b", [rows, big], 200)
    assert again == batch_answer(spark, rows + big) == []


def test_repeats_in_later_files(spark, tmp_path):
    schema = "symbol string, id bigint, seq bigint, price double, at timestamp"
    r = random.Random(1)
    trades = [(r.choice("AB"), r.randrange(9), seq, r.choice([1.0, 1.0, 1.0, 2.0]), None) for seq in range(120)]
    batches = [trades[:40], trades[40:90], trades[90:]]
    typed = stream(spark, tmp_path, batches, schema).withColumn("at", F.timestamp_seconds(F.col("seq") + 10_000))
    got = keyed.latest_updates(keyed.repeated(typed, ["symbol", "id"], ["price"], 1000, 1000), str(tmp_path), ["symbol", "id"]).collect()
    batch = tape.distinct_trades(spark.createDataFrame(trades, schema).drop("at"), ["symbol", "id"], ["price"]).collect()
    assert sorted((x.symbol, x.id, x.seq, x.copies, x.unequal) for x in got) == sorted((x.symbol, x.id, x.seq, x.copies, x.unequal) for x in batch)


def test_an_identity_is_forgotten_after_its_time(spark, tmp_path):
    schema = "id bigint, seq bigint, price double, sec bigint"
    batches = [[(1, 1, 1.0, 0)], [(2, 2, 1.0, 1000)], [(2, 3, 1.0, 1001)], [(1, 4, 9.0, 1002)]]
    typed = stream(spark, tmp_path, batches, schema).withColumn("at", F.timestamp_seconds("sec"))
    got = keyed.latest_updates(keyed.repeated(typed, ["id"], ["price"], 30, 5), str(tmp_path), ["id"]).collect()
    assert sorted((x.id, x.seq, x.copies, x.unequal) for x in got) == [(1, 4, 1, False), (2, 2, 2, False)]


def test_identities_share_a_part_and_are_forgotten_one_by_one(spark, tmp_path):
    schema = "id bigint, seq bigint, price double, sec bigint"
    big = (1 << 60) + 1
    batches = [[(big, 1, 1.0, 0), (None, 2, 1.0, 990)], [(2, 3, 1.0, 1000)], [(None, 4, 2.0, 1001)], [(big, 5, 9.0, 1002)]]
    typed = stream(spark, tmp_path, batches, schema).withColumn("at", F.timestamp_seconds("sec"))
    updates = keyed.repeated(typed, ["id"], ["price"], 30, 5, parts=1)
    got = {(x.id, x.seq, x.copies, x.unequal) for x in keyed.latest_updates(updates, str(tmp_path), ["id"]).collect()}
    assert got == {(big, 5, 1, False), (2, 3, 1, False), (None, 2, 2, True)}

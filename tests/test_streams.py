from helpers import rows
from pyspark.sql import functions as F

from slotwise.operators import bars, status, tape
from slotwise.streaming import scan


def test_snapshots_equal_the_batch_for_any_split(spark, tmp_path):
    every = [("AB"[i % 2], i, i, 1.0 + i % 7, i % 5) for i in range(40)]
    schema = "symbol string, sec bigint, seq bigint, price double, size bigint"
    evaluate = lambda log, at: bars.from_ticks(log.where(F.col("sec") < at), 10)
    want = rows(evaluate(spark.createDataFrame(every, schema), 40))
    for parts in (1, 4):
        root, feed = str(tmp_path / f"r{parts}"), str(tmp_path / f"f{parts}")
        for k in range(parts):
            spark.createDataFrame(every[k * 40 // parts : (k + 1) * 40 // parts], schema).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        job = scan.SnapshotStream(root, evaluate, "sec")
        job.start(stream).awaitTermination()
        assert rows(job.latest(spark).drop("at")) == want


def test_a_retried_batch_replaces_its_own(spark, tmp_path):
    job = scan.SnapshotStream(str(tmp_path), lambda log, at: log.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "sec")
    batch = spark.createDataFrame([("A", 1), ("A", 2)], "symbol string, sec bigint")
    job.process(batch, 0)
    job.process(batch, 0)
    assert rows(job.latest(spark)) == [("A", 2, 3)]


def test_distinct_trades_of_a_stream(spark, tmp_path):
    trades = spark.createDataFrame([("A", i % 3, 1_700_000_000 + i) for i in range(9)], "symbol string, trade_id bigint, s bigint")
    trades.write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(trades.schema).parquet(str(tmp_path / "feed")).withColumn("at", F.timestamp_seconds("s"))
    query = scan.distinct_stream(stream, ["symbol", "trade_id"], 60).writeStream.format("memory").queryName("distinct_trades").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("distinct_trades").count() == 3


def test_pressure_hysteresis(spark):
    load = [0, 15, 15, 30, 30, 30, 0, 0, 0, 0, 0, 15, 0]
    samples = spark.createDataFrame([("k", i, w, 100) for i, w in enumerate(load)], "key string, at bigint, waiting bigint, capacity bigint")
    modes = [r.mode for r in status.pressure_modes(samples).orderBy("at").collect()]
    assert modes == ["normal", "normal", "degraded", "degraded", "degraded", *["aggregate_only"] * 5, "normal", "normal", "normal"]


def test_tape_and_spread_ladders(spark):
    trades = spark.createDataFrame([("A", s, True, "participant") for s in (5, 6, 6, 9)] + [("A", 9, False, "sip_fallback")], "symbol string, sec bigint, qualifying boolean, basis string")
    targets = spark.createDataFrame([("A", 10, 0), ("A", 20, 20), ("A", 30, 27), ("A", 40, None), ("A", 50, 0)], "symbol string, at bigint, covered_from bigint")
    found = {r.at: (r.status, r.reason, r.rate, r.basis) for r in tape.tape_rate(trades, targets).collect()}
    assert found[10] == ("current", "qualifying_original_prints", 0.8, "participant")
    assert found[20][:2] == ("warming", "coverage_warming") and found[30][:2] == ("warming", "five_second_warming")
    assert found[40][:2] == ("unavailable", "channel_unconfirmed") and found[50][2:] == (0.0, "none")
    quotes = spark.createDataFrame([("A", 1, 9, 10.0, 10.1), ("B", 1, 9, None, 10.0), ("C", 1, 9, 10.2, 10.0), ("D", 1, 7, 10.0, 10.0)], "symbol string, seq bigint, sec bigint, bid double, ask double")
    got = {r.symbol: (r.status, r.reason) for r in tape.spread(quotes, F.lit(10)).collect()}
    assert got == {"A": ("current", ""), "B": ("unavailable", "one_sided_quote"), "C": ("invalid", "crossed_quote"), "D": ("stale", "stale_quote")}


def test_quotes_that_share_the_latest_seq_are_all_given(spark):
    quotes = spark.createDataFrame([("A", 1, 9, 10.0, 10.5), ("A", 2, 9, 10.0, 10.25), ("A", 2, 9, None, 10.0), ("A", 2, 9, 10.0, 10.25)], "symbol string, seq bigint, sec bigint, bid double, ask double")
    got = sorted((r.symbol, r.status, r.cents, r.valid_seq) for r in tape.spread(quotes, F.lit(10)).collect())
    assert got == [("A", "current", 25.0, 2), ("A", "current", 25.0, 2), ("A", "unavailable", None, 2)]

"""Dimensions: universe, prior closes, float, schedule and content identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.scalars import finite_positive


def first_failing(rules: list[tuple[str, Column]], passed: str) -> Column:
    """The name of the first rule that does not hold."""
    out = F.when(~F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(~F.coalesce(rule, F.lit(False)), name)
    return out.otherwise(passed)


def universe_bucket() -> Column:
    """Accounting bucket of a ticker record (active, market, locale, type)."""
    return first_failing(
        [("inactive", F.col("active")), ("other_market", F.col("market") == "stocks"), ("other_locale", F.col("locale") == "us"), ("other_type", F.col("type").isin("CS", "ADRC"))],
        "eligible",
    )


def prior_closes(universe: DataFrame, rows: DataFrame) -> DataFrame:
    """Each symbol with status valid, missing or invalid, its close and a reason; ``rows`` have symbol, close."""
    found = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("close"))
    joined = universe.select("symbol").join(found, "symbol", "left")
    reason = (
        F.when(F.col("n").isNull(), "absent")
        .when(F.col("n") > 1, "duplicate")
        .when(F.col("close").isNull(), "malformed")
        .when(F.isnan("close") | (F.abs("close") == float("inf")), "nonfinite")
        .when(F.col("close") <= 0, "nonpositive")
        .otherwise("")
    )
    status = F.when(reason == "absent", "missing").when(reason == "", "valid").otherwise("invalid")
    return joined.select("symbol", status.alias("status"), F.when(reason == "", F.col("close")).alias("close"), reason.alias("reason"))


def unambiguous_float(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Float rows of known symbols that appear once and are positive."""
    known = rows.join(universe.select("symbol"), "symbol", "left_semi")
    once = known.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("free_float").alias("free_float"))
    return once.where((F.col("n") == 1) & finite_positive(F.col("free_float"))).select("symbol", "free_float")


def float_status(rows: DataFrame, floats: DataFrame) -> DataFrame:
    """``rows`` with float_status, float_reason and free_float; ``floats`` have symbol, free_float, provenance."""
    joined = rows.join(floats, "symbol", "left")
    status = F.when(F.col("free_float").isNull(), "unavailable").when(F.col("provenance") == "fresh", "current").otherwise("stale")
    reason = F.when(status == "unavailable", "not_available").when(status == "stale", "cached_fallback").otherwise("")
    return joined.withColumn("float_status", status).withColumn("float_reason", reason)


def usable_cache(entries: DataFrame, day: Column, max_age: int = 7) -> DataFrame:
    """The newest cache entry of at most ``max_age`` days, current only if it is of the same date."""
    age = F.date_diff(day, F.col("date"))
    newest = entries.where(age.between(0, max_age)).agg(F.max("date").alias("date"))
    return newest.select("date", F.when(F.date_diff(day, F.col("date")) == 0, "current").when(F.col("date").isNotNull(), "observable").otherwise("none").alias("use"))


def retained_dates(entries: DataFrame, keep: int = 14) -> DataFrame:
    """Entries of the newest ``keep`` dates."""
    dates = entries.select("date").distinct().orderBy(F.col("date").desc()).limit(keep)
    return entries.join(F.broadcast(dates), "date", "left_semi")


def trading_days(first: str, last: str, closed: list[str], early: list[str]) -> DataFrame:
    """A generated schedule: weekdays without closures, with their regular close in New York time."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    open_ = days.where(F.dayofweek("date").between(2, 6) & ~F.col("date").cast("string").isin(closed or [""]))
    return open_.withColumn("close_et", F.when(F.col("date").cast("string").isin(early or [""]), "13:00:00").otherwise("16:00:00"))


def session_bounds(day: Column, zone: str = "America/New_York") -> tuple[Column, Column]:
    """Epoch seconds of 04:00 and 20:00 local time on ``day``."""
    at = lambda clock: F.unix_timestamp(F.to_utc_timestamp(F.concat(day.cast("string"), F.lit(f" {clock}")).cast("timestamp"), zone))
    return at("04:00:00"), at("20:00:00")


def content_identity(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """One SHA-256 over a set of rows (of each key), whatever their order: the hash of the sorted row hashes.

    Row hashes are first combined per prefix, so that no task sorts all of them; 4096 prefixes are hashed last.
    """
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    hashed = rows.select(*keys, F.sha2(text, 256).alias("h")).withColumn("prefix", F.substring("h", 1, 3))
    per_prefix = hashed.groupBy(*keys, "prefix").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return per_prefix.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "h"))), lambda x: x["h"]), ""), 256).alias("identity"))


def judged_subsets(facts: DataFrame, cases: DataFrame, selected: DataFrame) -> DataFrame:
    """case_id, n and reason of each selection of a binding's symbols: empty if it is a strict subset that names each once.

    ``facts`` has one row per symbol of the binding, ``selected`` (case_id, symbol). A selection is refused as a whole:
    empty, repeated, outside (a symbol that the binding has not) or not_strict.
    """
    total = facts.count()
    named = selected.groupBy("case_id", "symbol").agg(F.count(F.lit(1)).alias("times"))
    known = named.join(facts.select("symbol", F.lit(1).alias("known")), "symbol", "left")
    counts = known.groupBy("case_id").agg(F.sum("times").alias("rows"), F.count(F.lit(1)).alias("n"), F.count("known").alias("known"))
    reason = (
        F.when(F.col("n").isNull(), "empty").when(F.col("rows") > F.col("n"), "repeated").when(F.col("known") < F.col("n"), "outside")
        .when(F.col("n") >= total, "not_strict").otherwise("")
    )
    return cases.select("case_id").join(counts, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n"), reason.alias("reason"))


def subset_bindings(facts: DataFrame, cases: DataFrame, selected: DataFrame, columns: list[str]) -> DataFrame:
    """Each selection's n and reason, with the identities of its symbols and of their facts (``columns``) if it is accepted."""
    judged = judged_subsets(facts, cases, selected)
    members = selected.join(judged.where("reason = ''").select("case_id"), "case_id", "left_semi").join(facts, "symbol")
    out = judged
    for name, over in (("universe_identity", ["symbol"]), ("prior_identity", ["symbol", *columns])):
        out = out.join(content_identity(members, over, ("case_id",)).withColumnRenamed("identity", name), "case_id", "left")
    return out


def prior_session(closes: DataFrame, day: Column) -> DataFrame:
    """The close of each symbol's last session strictly before ``day``."""
    return closes.where(F.col("day") < day).groupBy("symbol").agg(F.max_by("close", "day").alias("close"))


def latest_ranked(rows: DataFrame, keys: list[str], by: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc())
    return rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= keep).drop("turn")

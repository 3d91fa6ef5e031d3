"""The evaluation of a whole population at T: a row per symbol, its accounting, and the identities that must hold.

One pass over the bars (one exchange by symbol) gives the proofs of the gate, the session's totals and the marks;
what else a symbol's fate depends on has a row per symbol. Rules are a table: each is a name and a condition
over the accounting or over a row, and a violation is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.scalars import finite, percent_change
from slotwise.operators.features import pair_valid
from slotwise.operators.rank import ranking_mode
from slotwise.params import ScanParams


def scanned(bars: DataFrame, p: ScanParams, at: int, now_slot: int, horizon_slots: int) -> DataFrame:
    """Per symbol: first_pass, last_pass, proofs, finalized_at, volume, first_open, high, low and the mark (slot, close) before ``at``.

    A bar is followed by the ends up to the next bar at which a window could pass, so that no end comes twice.
    Only whether a gap is too long is kept of the gaps: the first bar of a window is judged by the window's edge.
    """
    g = p.gate
    inside = bars.where((F.col("slot") >= p.start) & (F.col("slot") < at))
    in_order = Window.partitionBy("symbol").orderBy("slot")
    following = F.coalesce(F.lead("slot").over(in_order), F.lit(at))
    last_end = F.least(following, F.col("slot") + 1 + g.max_gap, F.lit(at))
    rated = F.col("ats") > 0
    placed = inside.select(
        "symbol", "slot", "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), last_end.alias("last_end"),
        (F.col("slot") - F.lag("slot").over(in_order) - 1 > g.max_gap).alias("wide"), (~F.coalesce(rated, F.lit(False))).alias("unrated"),
        F.when(rated, F.col("volume") / F.col("ats").cast("double")).alias("trades"), (F.col("volume") * F.col("vwap")).alias("dollars"),
    )
    names = ("slot", "open", "high", "low", "close", "volume", "wide", "unrated", "trades", "dollars")
    bar = F.struct(F.col("slot").alias("at"), F.struct(*names).alias("bar"))
    ends = F.transform(F.sequence(F.col("slot") + 1, F.col("last_end")), lambda e: F.struct(e.alias("at"), F.lit(None).cast(placed.select(F.struct(*names)).schema[0].dataType).alias("bar")))
    rows = placed.select("symbol", F.explode(F.concat(F.array(bar), ends)).alias("r")).select("symbol", "r.at", "r.bar")
    order = Window.partitionBy("symbol").orderBy("at")
    whole, short = order.rangeBetween(-g.window, -1), order.rangeBetween(-g.short_window, -1)
    n, first, last = F.count("bar").over(whole), F.min("bar.slot").over(whole), F.max("bar.slot").over(whole)
    wide = F.count_if(F.col("bar.wide")).over(whole) - F.coalesce(F.first("bar.wide", ignorenulls=True).over(whole), F.lit(False)).cast("int")
    passing = (
        (n >= g.min_present) & (F.last("bar.close", ignorenulls=True).over(whole) >= g.min_price)
        & (wide <= 0) & (first - (F.col("at") - g.window) <= g.max_gap) & (F.col("at") - 1 - last <= g.max_gap)
        & (F.count_if("bar.unrated").over(whole) == 0) & (F.sum("bar.trades").over(whole) >= g.min_trades) & (F.coalesce(F.sum("bar.trades").over(short), F.lit(0.0)) >= g.min_short_trades)
        & (F.sum("bar.dollars").over(whole) >= g.min_dollar_volume) & (F.max("bar.volume").over(whole) <= g.max_concentration * F.sum("bar.volume").over(whole)) & (F.sum("bar.volume").over(whole) > 0)
    )
    judged = rows.select("symbol", "at", "bar", F.when(F.col("bar").isNull() & F.coalesce(passing, F.lit(False)), F.col("at")).alias("proof"))
    final = F.when(F.lit(now_slot) > F.col("proof") + horizon_slots, F.col("proof"))
    slot = F.col("bar.slot")
    return judged.groupBy("symbol").agg(
        F.min("proof").alias("first_pass"), F.max("proof").alias("last_pass"), F.count("proof").alias("proofs"), F.min(final).alias("finalized_at"),
        F.sum("bar.volume").alias("volume"), F.min_by("bar.open", slot).alias("first_open"), F.max("bar.high").alias("high"), F.min("bar.low").alias("low"),
        F.max_by(F.struct("bar.slot", "bar.close"), slot).alias("mark"),
    )


# Where an uncertainty comes from.
ORIGINS = ("bootstrap_origin", "post_bootstrap_gap", "local_invalid")


def evaluated(universe: DataFrame, scan: DataFrame, priors: DataFrame, coverage: DataFrame, invalid: DataFrame, at: int, min_price: float) -> DataFrame:
    """One row per symbol: bucket, origin of its uncertainty, qualification, last, mark_age, day_pct and whether it ranks and passes.

    ``priors`` have symbol and prior_close (sound ones only), ``coverage`` symbol, unknown (an origin, or null),
    trusted (a later live mark stands for it), no_print and exact (the whole session is covered), ``invalid`` symbol and slot of
    standing rejects.
    """
    rejected = invalid.where(F.col("slot") < at).select("symbol").distinct().withColumn("rejected", F.lit(True))
    rows = universe.select("symbol").join(scan, "symbol", "left").join(priors, "symbol", "left").join(coverage, "symbol", "left").join(rejected, "symbol", "left")
    no = F.lit(False)
    last, unknown = F.col("mark.close"), F.col("unknown").isNotNull() & ~F.coalesce("trusted", no)
    lost = F.col("mark").isNull() | ~F.coalesce(finite(last), no)
    bucket = (
        F.when(F.col("prior_close").isNull(), "invalid_or_missing_prior_close")
        .when(unknown, "unknown_due_failure_or_fence")
        .when(F.col("mark").isNull() & F.coalesce("no_print", no), "no_print_through_t")
        .when(F.col("mark").isNull() & F.coalesce("rejected", no), "invalid_mark")
        .when(lost, "unknown_due_failure_or_fence")
        .when(last < min_price, "trusted_below_price_mark")
        .otherwise("trusted_rankable_mark")
    )
    qualification = (
        F.when(F.col("finalized_at").isNotNull(), "finalized").when(F.col("first_pass").isNotNull(), "provisional").when(F.coalesce("exact", no), "not_yet_passed").otherwise("unresolved")
    )
    placed = rows.withColumn("bucket", bucket)
    ranks = F.col("bucket") == "trusted_rankable_mark"
    origin = F.when(F.col("bucket") == "unknown_due_failure_or_fence", F.when(unknown, F.col("unknown")).otherwise("local_invalid")).when(
        ranks & (qualification == "unresolved"), F.coalesce("unknown", F.lit("local_invalid"))
    )
    day = percent_change(last, F.col("prior_close"))
    sound = ranks & day.isNotNull()
    return placed.select(
        "symbol", "bucket", origin.alias("origin"), F.when(ranks, qualification).alias("qualification"), last.alias("last"), (F.lit(at) - F.col("mark.slot") - 1).alias("mark_age"),
        day.alias("day_pct"), sound.alias("known_rankable"), (sound & qualification.isin("provisional", "finalized")).alias("passer"),
    )


BUCKETS = ("invalid_or_missing_prior_close", "unknown_due_failure_or_fence", "no_print_through_t", "invalid_mark", "trusted_below_price_mark", "trusted_rankable_mark")
QUALIFICATIONS = ("not_yet_passed", "provisional", "finalized", "unresolved")


def accounting(rows: DataFrame, lifecycle: str = "live") -> DataFrame:
    """One row: how many symbols are in each bucket, qualification and origin, passers, and the ranking's mode and reason."""
    count = lambda condition, name: F.count_if(F.coalesce(condition, F.lit(False))).alias(name)
    ranks, passed = F.col("bucket") == "trusted_rankable_mark", F.col("qualification").isin("provisional", "finalized")
    counts = rows.agg(
        F.count(F.lit(1)).alias("universe_total"), *(count(F.col("bucket") == b, b) for b in BUCKETS), *(count(F.col("qualification") == q, q) for q in QUALIFICATIONS), *(count(F.col("origin") == o, o) for o in ORIGINS),
        count(F.col("passer"), "total_passers"), count(F.col("known_rankable"), "known_rankable"), count(ranks & ~F.col("known_rankable"), "day_invalid"), count(passed & ~F.col("known_rankable"), "qualified_day_invalid"),
    )
    only_bootstrap = (F.col("post_bootstrap_gap") == 0) & (F.col("local_invalid") == 0)
    mode = ranking_mode(F.lit(lifecycle), F.col("unknown_due_failure_or_fence"), F.col("unresolved"), F.col("known_rankable"), only_bootstrap)
    return counts.withColumn("m", mode).select("*", "m.mode", "m.reason").drop("m")


# The identities of an evaluation.
IDENTITIES = {
    "accounting.population": "universe_total = invalid_or_missing_prior_close + unknown_due_failure_or_fence + no_print_through_t + invalid_mark + trusted_below_price_mark + trusted_rankable_mark",
    "accounting.qualification": "not_yet_passed + provisional + finalized + unresolved = trusted_rankable_mark",
    "accounting.passers": "total_passers + qualified_day_invalid = provisional + finalized",
    "accounting.rankable": "known_rankable + day_invalid = trusted_rankable_mark",
    "accounting.day_invalid": "qualified_day_invalid <= day_invalid",
    "accounting.uncertainty": "bootstrap_origin + post_bootstrap_gap + local_invalid = unknown_due_failure_or_fence + unresolved",
    "ranking.qualified": "mode <> 'qualified_current' or reason = '' and unknown_due_failure_or_fence = 0 and unresolved = 0",
    "ranking.degraded": "mode not in ('degraded_current', 'degraded_bootstrap') or known_rankable > 0 and unknown_due_failure_or_fence + unresolved > 0",
    "ranking.degraded_origin": "mode <> 'degraded_bootstrap' or post_bootstrap_gap = 0 and local_invalid = 0 and bootstrap_origin > 0",
    "ranking.reason": "mode not in ('degraded_current', 'degraded_bootstrap') or reason = if(unknown_due_failure_or_fence <> 0, 'incomplete_population', 'qualification_pending')",
}


def broken_identities(counts: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """check: the name of each rule that a row of ``counts`` does not fulfil; nothing where all hold."""
    judged = F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in (rules or IDENTITIES).items()))
    return counts.select(F.explode(F.array_compact(judged)).alias("check"))


def open_tuples(fields: DataFrame) -> DataFrame:
    """``fields`` (symbol, name, status, reason, value) that break a rule, with ``check``, a row for each rule they break.

    A status has its own reasons; a value is there if and only if it is current, and then finite.
    """
    current, value = F.col("status") == "current", F.col("value")
    rules = {
        "status_reason": F.coalesce(pair_valid(F.col("status"), F.col("reason")), F.lit(False)),
        "value_presence": F.coalesce(current, F.lit(False)) == value.isNotNull(),
        "value_finite": value.isNull() | finite(value),
    }
    judged = F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items()))
    return fields.select("symbol", "name", "status", "reason", F.explode(F.array_compact(judged)).alias("check"))


def unreconciled(contingency: DataFrame, universe_total: int | Column) -> DataFrame:
    """name: measurements whose statuses, reasons or pairs do not each add up to the universe (``rank.contingency``)."""
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    status, reason = F.col("status").isNotNull(), F.col("reason").isNotNull()
    sums = contingency.groupBy("name").agg(total(status & reason).alias("pairs"), total(status & ~reason).alias("statuses"), total(~status & reason).alias("reasons"))
    wanted = F.lit(universe_total) if isinstance(universe_total, int) else universe_total
    return sums.where((F.col("pairs") != wanted) | (F.col("statuses") != wanted) | (F.col("reasons") != wanted)).select("name", "pairs", "statuses", "reasons")


def masked_by_stale_watermark(snapshots: DataFrame, seconds: int = 5) -> DataFrame:
    """``snapshots`` (key, seq, sampled_s, stale, ready, watermark_s) with ``hold`` and ``boundary_s`` (the watermark at the start of a recovery).

    A stale watermark masks until a run of ready snapshots has lasted ``seconds`` and moved the watermark as far from where it
    was at the run's start; any snapshot that is not ready starts the recovery anew. Runs are islands between breaks, so that
    the state of a snapshot is a running count and two firsts.
    """
    order = Window.partitionBy("key").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stale, sound = F.coalesce("stale", F.lit(False)), F.coalesce(F.col("ready") & F.col("watermark_s").isNotNull() & ~F.coalesce("stale", F.lit(False)), F.lit(False))
    runs = snapshots.withColumn("_spell", F.sum(stale.cast("int")).over(so_far)).withColumn("_sound", sound).withColumn("_run", F.sum((~sound).cast("int")).over(so_far))
    run = Window.partitionBy("key", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    began = lambda name: F.first(F.when(F.col("_sound"), F.col(name)), ignorenulls=True).over(run)
    met = runs.withColumn("_since", began("sampled_s")).withColumn("boundary_s", began("watermark_s"))
    recovered = F.col("_sound") & (F.col("sampled_s") - F.col("_since") >= seconds) & (F.col("watermark_s") >= F.col("boundary_s") + seconds)
    spell = Window.partitionBy("key", "_spell").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = F.max(F.coalesce(recovered, F.lit(False)).cast("int")).over(spell) == 1
    held = met.withColumn("hold", (F.col("_spell") > 0) & ~over)
    # While masked, a recovery that is under way shows where it began; the snapshot that ends it shows it once more.
    first_over = held.withColumn("_before", F.coalesce(F.lag("hold").over(order), F.lit(False)))
    shown = F.when((F.col("hold") | F.col("_before")) & F.col("_sound"), F.col("boundary_s"))
    return first_over.withColumn("boundary_s", shown).select(*snapshots.columns, "hold", "boundary_s")

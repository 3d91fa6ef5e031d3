"""Every delivery of a bar with what became of it, the bars that stand, and the rejects that still count.

Checks that need no other delivery come first, in one expression over the row and the control state in
force. What is left meets the other deliveries of its identity (symbol, slot). An identity whose deliveries
all have one value (nearly all, in a real feed) is settled by windows over it; only
disputed ones are folded in order of admission, row by row with a state of a few values. A
withdrawal for want of integrity ends everything: identities do not touch each other before it, so that
the first one over all of them is the least of what each finds alone, one aggregated row, and whatever
was delivered later is refused. Nothing needs to be repeated until it settles.

``deliveries``: symbol, slot (start second), seconds (length), seq (unique, in order of arrival), source,
position (epoch, frame, idx; null for historical rows), request (generation, token, ordinal, a, b; null for
live rows), schema_version, binding, delivered (a time, or null), bar (eight values), admission_s.
``controls``: the state in force for since <= seq < until: epoch, active, acknowledged, ack (a position), lifecycle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from slotwise.functions.scalars import finite, finite_positive
from slotwise.sources.folders import kept

# Where an average trade size comes from.
PROVENANCES = ("live_provider_average", "rest_floor_volume_over_trades")


@dataclass(frozen=True)
class Session:
    binding: str
    first_s: int
    last_s: int
    schema_version: int = 1
    horizon_s: int = 960


def with_control(deliveries: DataFrame, controls: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``deliveries`` with ``control``, the state in force (null outside all of them).

    Both sides are cut into stretches of ``width`` arrivals, so that the join is on equality.
    """
    pieces = controls.select(F.explode(F.sequence(F.expr(f"since div {width}"), F.expr(f"(until - 1) div {width}"))).alias("_stretch"), F.struct(*controls.columns).alias("control"))
    rows = deliveries.withColumn("_stretch", F.expr(f"seq div {width}"))
    inside = (F.col("seq") >= F.col("control.since")) & (F.col("seq") < F.col("control.until"))
    return rows.join(pieces.withColumnRenamed("_stretch", "_piece"), (F.col("_stretch") == F.col("_piece")) & inside, "left").drop("_stretch", "_piece")


def bar_valid(bar: str = "bar") -> Column:
    """Positive finite prices inside low and high, a volume, an average size and where that comes from."""
    c = lambda name: F.col(f"{bar}.{name}")
    prices = finite_positive(c("open")) & finite_positive(c("high")) & finite_positive(c("low")) & finite_positive(c("close")) & finite_positive(c("vwap"))
    inside = c("open").between(c("low"), c("high")) & c("close").between(c("low"), c("high"))
    return F.coalesce(prices & inside & finite(c("volume")) & (c("volume") >= 0) & (c("ats") >= 0) & c("provenance").isin(*PROVENANCES), F.lit(False))


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def checked(deliveries: DataFrame, controls: DataFrame, universe: DataFrame, session: Session, width: int, keep: list[str]) -> DataFrame:
    """``keep`` of ``deliveries`` with ``refused`` ('disposition:reason' of the first check that fails, or null), ``evidence``, ``late`` and what the fold reads.

    ``evidence``: a bar of a known symbol and second, delivered soundly, whose values are refused. What a row alone decides
    is decided before the joins, so that its columns do not travel.
    """
    known = universe.select(F.col("symbol").alias("_symbol")).distinct()
    at, request, end_s = F.col("position"), (lambda n: F.col(f"request.{n}")), F.col("slot") + F.col("seconds")
    live = _true(F.col("source") == "live")
    window = (F.col("seconds") == 1) & (F.col("slot") >= session.first_s) & (end_s <= session.last_s)
    placed = (F.col("position.epoch") > 0) & (F.col("position.frame") > 0) & F.col("request").isNull()
    asked = (request("generation") > 0) & (request("token") != "") & (request("ordinal") > 0) & at.isNull()
    asked = asked & (request("a") >= session.first_s) & (request("b") <= session.last_s) & (F.col("slot") >= request("a")) & (F.col("slot") < request("b"))
    early = (
        F.when(~_true(F.col("schema_version") == session.schema_version), "rejected:schema")
        .when(~_true(F.col("binding") == session.binding), "fenced:binding")
        .when(~_true(F.col("source").isin("live", "historical")), "rejected:run_source")
    )
    context = F.when(live, F.when(~_true(placed), "rejected:source_position")).when(~_true(asked), "fenced:historical_context")
    own = deliveries.select(
        *dict.fromkeys([*keep, "symbol", "slot", "seq", "position", "bar"]), live.alias("_live"), F.col("request").isNotNull().alias("_asking"), request("generation").alias("_given"),
        early.alias("_early"), _true(window).alias("_inside"), bar_valid().alias("_sound"), F.when(F.col("delivered").isNull(), "rejected:delivery_evidence").otherwise(context).alias("_context"),
        F.when(_true(end_s > F.col("admission_s")), "rejected:future_event_time").alias("_future"), _true(F.col("admission_s") - end_s > session.horizon_s).alias("late"),
    )
    met = with_control(own, controls, width).join(known, F.col("symbol") == F.col("_symbol"), "left")
    state, live = (lambda n: F.col(f"control.{n}")), F.col("_live")
    epoch = F.coalesce(state("epoch"), F.lit(0))
    stale = live & (epoch != 0) & ~_true(state("active") & (F.col("position.epoch") == epoch))
    lifecycle = F.when(F.col("_asking"), state("lifecycle").isin("hydrating", "recovering")).otherwise(
        live & state("active") & state("acknowledged") & state("lifecycle").isin("hydrating", "live", "recovering")
    )
    before = (
        F.when(stale, "fenced:stale_live_epoch")
        .when(~_true(lifecycle), "rejected:lifecycle")
        .when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("_symbol").isNull(), "rejected:symbol")
        .when(~F.col("_inside"), "rejected:window")
    )
    behind = F.when(live & ~_true(at > state("ack")), "rejected:aggregate_at_or_before_ack")
    after = F.coalesce("_context", behind, "_future")
    return met.select(
        *dict.fromkeys([*keep, "symbol", "slot", "seq", "position", "bar"]), "_live", "_given", F.coalesce(before, F.when(~F.col("_sound"), "rejected:structural"), after).alias("refused"),
        (before.isNull() & ~F.col("_sound") & after.isNull()).alias("evidence"), "late",
    )


#: What stands (its value, whether live, position, generation), and whether two historical values met.
_NOTHING = (None, False, None, None, False)
_FACTS = ("symbol", "slot", "_live", "late", "position", "_given", "bar", "outcome")


def _met(state: tuple, live: bool, late: bool, position: tuple | None, generation: int | None, bar: tuple) -> tuple[str, tuple]:
    """What becomes of a sound delivery of an identity in a state, and the state after it."""
    held, held_live, standing, of, conflict = state
    placed = (bar, live, position, generation, conflict and not live)
    if live and late and not held_live:
        return "rejected:too_late", state
    if not live and held is not None and not held_live and late and generation != of:
        return "fenced:historical_context", state  # folded away: only its presence is known to another request
    if not live and held is None and conflict:
        return "rejected:historical_historical_conflict", state
    if held == bar:
        return "exact_duplicate:", (held, True, position if standing is None else max(standing, position), of, conflict) if live else state
    if live and late:
        return "rejected:too_late", state
    if held is None:
        return "inserted:", placed
    if not live:
        return ("rejected:historical_live_conflict", state) if held_live else ("withdrawn_conflict:historical_historical_conflict", (None, False, None, None, True))
    if not held_live:
        return "revised:", placed
    if position < standing:
        return "rejected:nonprecedent", state
    if position == standing:
        return "integrity:repeated_position_unequal", (None, False, None, None, conflict)
    return "revised:", placed


def _folding(names: list[str]):  # noqa: ANN202
    """Gives the rows of disputed identities, which arrive without an outcome and in order, theirs; returns the columns ``names``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity, state = None, _NOTHING
        for batch in batches:
            table = pa.Table.from_batches([batch])
            told = table["outcome"].to_pylist()
            open_ = pa.array([k for k, x in enumerate(told) if x is None], pa.int64())
            rows = table.select(_FACTS[:-1]).take(open_)
            for k, symbol, slot, live, late, position, generation, bar in zip(open_.to_pylist(), *(c.to_pylist() for c in rows.columns), strict=True):
                if (symbol, slot) != identity:
                    identity, state = (symbol, slot), _NOTHING
                told[k], state = _met(state, live, late, position and tuple(position.values()), generation, tuple(bar.values()))
            columns = [pa.array(told, pa.string()) if name == "outcome" else batch.column(batch.schema.get_field_index(name)) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _met_undisputed() -> Column:
    """The same for an identity with one value, from when it was first held and first held by a live bar."""
    live, seq = F.col("_live"), F.col("seq")
    held, held_live = _true(F.col("_opened") < seq), _true(F.col("_live_since") < seq)
    return (
        F.when(live & F.col("late") & ~held_live, "rejected:too_late")
        .when(~live & held & ~held_live & F.col("late") & ~F.col("_given").eqNullSafe(F.col("_generation")), "fenced:historical_context")
        .when(held, "exact_duplicate:")
        .otherwise("inserted:")
    )


def dispositions(deliveries: DataFrame, controls: DataFrame, universe: DataFrame, session: Session, width: int = 1 << 16, keep: list[str] | None = None) -> DataFrame:
    """``deliveries`` (of its columns ``keep``, if given, which must hold seq) with evidence, disposition and reason; ``width`` is the stretch of ``with_control``.

    Each delivery is dealt to its identity once; windows settle the undisputed there, and the fold reads the same order.
    The log is written once, because the first break is looked for in it.
    """
    keep = deliveries.columns if keep is None else keep
    # Refused rows meet nobody: each is an identity of its own, so that a symbol of refused rows is not one task.
    rows = checked(deliveries, controls, universe, session, width, keep).withColumn("_alone", F.when(F.col("refused").isNotNull(), F.col("seq")))
    identity = ("symbol", "slot", "_alone")
    mine = Window.partitionBy(*identity).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    live = F.col("_live")
    opens = F.when(~live | ~F.col("late"), F.col("seq"))
    facts = {
        "_disputed": F.min("bar").over(mine) != F.max("bar").over(mine), "_opened": F.min(opens).over(mine),
        "_live_since": F.min(F.when(live & ~F.col("late"), F.col("seq"))).over(mine), "_generation": F.min_by("_given", opens).over(mine),
    }
    told = F.when(F.col("refused").isNotNull(), F.col("refused")).when(~F.col("_disputed"), _met_undisputed())
    met = rows.withColumns(facts).withColumn("outcome", told).sortWithinPartitions(*identity, "seq")
    needed = met.select(*dict.fromkeys([*keep, *_FACTS, "evidence"]))
    names = [*keep, "evidence", "outcome"]
    log = kept(needed.mapInArrow(_folding(names), StructType([StructField(n, needed.schema[n].dataType) for n in names])), "ledger")
    first_break = F.broadcast(log.where("outcome like 'integrity%'").agg(F.min("seq").alias("_break")))  # one row
    broken = _true(F.col("seq") > F.col("_break"))
    parts = F.split(F.when(broken, "integrity:repeated_position_unequal").otherwise(F.col("outcome")), ":")
    return log.join(first_break).select(*keep, (F.col("evidence") & ~broken).alias("evidence"), parts[0].alias("disposition"), parts[1].alias("reason"))


def canonical(log: DataFrame) -> DataFrame:
    """The bars that stand, from ``dispositions``: symbol, slot, bar, source, position, first_seq (of its first evidence) and seq (of its value)."""
    took = F.col("disposition").isin("inserted", "revised")
    changed = took | (F.col("disposition") == "withdrawn_conflict") | (F.col("disposition") == "integrity")
    # After the break everything is 'integrity'; only the break itself took a bar away, the rest changed nothing.
    broke = log.where("disposition = 'integrity'").agg(F.min("seq").alias("_break"))
    rows = log.join(F.broadcast(broke)).where(F.col("_break").isNull() | (F.col("seq") <= F.col("_break")))
    at = F.when(changed, F.col("seq"))
    live = F.when((F.col("source") == "live") & (took | (F.col("disposition") == "exact_duplicate")), F.col("seq"))
    last = rows.groupBy("symbol", "slot").agg(
        F.max_by(F.struct("bar", took.alias("stands")), at).alias("last"), F.max(at).alias("seq"), F.max(F.when(F.col("disposition") == "inserted", F.col("seq"))).alias("first_seq"),
        F.max(live).alias("live_seq"), F.max(F.when(live.isNotNull(), F.col("position"))).alias("position"),
    )
    is_live = _true(F.col("live_seq") >= F.col("seq"))
    return last.where("last.stands").select(
        "symbol", "slot", F.col("last.bar").alias("bar"), F.when(is_live, "live").otherwise("historical").alias("source"), F.when(is_live, F.col("position")).alias("position"), "first_seq", "seq"
    )


def standing_rejects(log: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """symbol and slot of the refused bars that still count: none at or after their slot was accepted later.

    Two clocks: a reject at slot r, arrived at s, is lifted by an accepted bar with slot >= r and arrival > s.
    Arrivals run backwards with the greatest accepted slot so far; a symbol's are cut into stretches, whose
    greatest slots carry over, so that a busy symbol is many tasks.
    """
    took = F.col("disposition").isin("inserted", "revised")
    rows = log.where(took | F.col("evidence")).select("symbol", "slot", "seq", "evidence", F.when(took, F.col("slot")).alias("accepted"), F.expr(f"seq div {stretch}").alias("stretch"))
    within = Window.partitionBy("symbol", "stretch").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("symbol", "stretch").agg(F.max("accepted").alias("top"))
    later = Window.partitionBy("symbol").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = tops.select("symbol", "stretch", F.max("top").over(later).alias("_ahead"))
    met = rows.withColumn("_here", F.max("accepted").over(within)).where("evidence").join(ahead, ["symbol", "stretch"])
    return met.where(~_true(F.greatest("_here", "_ahead") >= F.col("slot"))).select("symbol", "slot").distinct()

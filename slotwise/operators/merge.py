"""The canonical merge: which of several deliveries of one bar stands, and what became of each.

Nothing bounds the deliveries of an identity (symbol, slot), so they are never held at once. The rows
are sorted by identity in order of admission, once, and read once, with a state of a few values that is
carried from batch to batch. Bars and positions whose types compare in Python as they do in Spark are
compared themselves; others get ranks within their identity first, at the price of a window and a sort
for each. Sorts and windows spill. Every delivery leaves with its disposition as a row of its own, and
accounting is a group-by.

``deliveries`` has symbol, slot, seq, source ('live' or 'historical'), position (any orderable value,
null for historical rows), bar (a struct of values), admission_s and end_s.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DecimalType, FractionalType, IntegralType, StringType, StructType

#: Bar, source and position that stand, conflict and integrity flags.
_EMPTY = (None, None, None, False, False)


def _decide(state: tuple, live: bool, position: int | None, bar: int | None, future: bool, late: bool) -> str:
    held, standing, conflict = state[0] is not None, state[2], state[3]
    held_live = held and state[1] is True
    late = live and late
    both = position is not None and standing is not None
    if future:
        return "rejected:future_event_time"
    if late and not held_live:
        return "rejected:too_late"
    if not live and not held and conflict:
        return "rejected:historical_historical_conflict"
    if held and bar == state[0]:
        return "exact_duplicate"
    if late:
        return "rejected:too_late"
    if not held:
        return "inserted"
    if live and not held_live:
        return "revised"
    if live and both and position < standing:
        return "rejected:nonprecedent"
    if live and both and position == standing:
        return "withdrawn_integrity"
    if live:
        return "revised"
    return "rejected:historical_live_conflict" if held_live else "withdrawn_conflict"


def _after(state: tuple, outcome: str, live: bool, position: int | None, bar: int | None) -> tuple:
    held, source, standing, conflict, integrity = state
    if outcome in ("inserted", "revised"):
        return bar, live, position, conflict and not live, integrity
    if outcome == "exact_duplicate" and live:
        return held, True, max((p for p in (standing, position) if p is not None), default=None), conflict, integrity
    if outcome == "withdrawn_integrity":
        return None, None, None, conflict, True
    if outcome == "withdrawn_conflict":
        return None, None, None, True, integrity
    return state


def _same_in_python(kind: DataType) -> bool:
    """Whether values are equal for Spark exactly where ``_comparable`` makes them equal."""
    if isinstance(kind, StructType):
        return bool(kind.fields) and all(_same_in_python(f.dataType) for f in kind.fields)
    return isinstance(kind, IntegralType | FractionalType | DecimalType | BooleanType | BinaryType) or kind == StringType()


def _comparable(column: pa.Array) -> list:
    """Structs as tuples, and any NaN as one value."""
    if pa.types.is_struct(column.type):
        fields = zip(*map(_comparable, column.flatten()), strict=True)
        return [x if valid else None for x, valid in zip(fields, column.is_valid().to_pylist(), strict=True)]
    if pa.types.is_floating(column.type):
        return ["NaN" if x is not None and x != x else x for x in column.to_pylist()]
    return column.to_pylist()


def _ordered(deliveries: DataFrame, horizon: int, *values: str) -> tuple[DataFrame, tuple[str, ...]]:
    """Deliveries of each identity in a row, in order of admission, and the names of what decides."""
    identity = Window.partitionBy("symbol", "slot")
    kinds = {f.name: f.dataType for f in deliveries.schema}
    placed = deliveries.select("symbol", "slot", "seq", "source", "position", "bar", "admission_s", "end_s").repartition("symbol", "slot")
    names = {"position": "position", "bar": "bar"}
    for name, plain in (("bar", _same_in_python(kinds["bar"])), ("position", isinstance(kinds["position"], IntegralType))):
        if not plain:  # ranks stand for the values, in the order too
            names[name] = f"{name}_rank"
            placed = placed.withColumn(names[name], F.when(F.col(name).isNotNull(), F.dense_rank().over(identity.orderBy(name))))
    placed = placed.sortWithinPartitions("symbol", "slot", "seq", "source", names["position"], names["bar"], "admission_s", "end_s")
    late = F.col("admission_s") - F.col("end_s") > horizon
    return placed.select(
        "symbol", "slot", "seq", *dict.fromkeys((*names.values(), *values)),
        F.coalesce(F.col("source") == "live", F.lit(False)).alias("live"),
        F.coalesce(F.col("end_s") > F.col("admission_s"), F.lit(False)).alias("future"),
        F.coalesce(late, F.lit(False)).alias("late"),
    ), ("symbol", "slot", "live", names["position"], names["bar"], "future", "late")


def dispositions(deliveries: DataFrame, horizon: int = 960) -> DataFrame:
    """symbol, slot, seq, disposition and reason of every delivery."""
    placed, facts = _ordered(deliveries, horizon)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity, state = None, _EMPTY
        for batch in batches:
            outcomes = []
            for symbol, slot, *fact in zip(*(_comparable(batch.column(c)) for c in facts), strict=True):
                if (symbol, slot) != identity:
                    identity, state = (symbol, slot), _EMPTY
                outcome = _decide(state, *fact)
                state = _after(state, outcome, *fact[:3])
                outcomes.append(outcome)
            columns = [batch.column(c) for c in ("symbol", "slot", "seq")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(outcomes, pa.string())], names=["symbol", "slot", "seq", "outcome"])

    kinds = {f.name: f.dataType for f in deliveries.schema}
    schema = StructType()
    for name in ("symbol", "slot", "seq"):
        schema = schema.add(name, kinds[name])
    log = placed.mapInArrow(run, schema.add("outcome", "string"))
    parts = F.split("outcome", ":")
    return log.select("symbol", "slot", "seq", parts[0].alias("disposition"), F.coalesce(F.get(parts, 1), F.lit("")).alias("reason"))


def merged(deliveries: DataFrame, horizon: int = 960) -> DataFrame:
    """One row per identity: the bar that stands (null if none), its source and flags."""
    placed, facts = _ordered(deliveries, horizon, "bar")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity, state = None, _EMPTY
        kept: pa.RecordBatch | None = None  # the delivery whose bar stands, when it came in an earlier batch
        last: pa.RecordBatch | None = None  # a row of the identity that is still open, for its symbol, slot and types

        def closed(rows: pa.Table, bars: pa.Table, at: list, states: list) -> pa.RecordBatch:
            columns = [rows["symbol"], rows["slot"], bars["bar"].take(pa.array(at, pa.int64()))]
            sources = [None if s[1] is None else "live" if s[1] else "historical" for s in states]
            arrays = [*(c.combine_chunks() for c in columns), pa.array(sources, pa.string()), *(pa.array([s[k] for s in states], pa.bool_()) for k in (3, 4))]
            return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=["symbol", "slot", "bar", "source", "conflict", "integrity"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # What is carried over stands before the batch: the open identity's last row, and the row of its bar.
            before = [x for x in (kept, last) if x is not None]
            table = pa.Table.from_batches([*before, batch])
            shift = len(before)
            holder = 0 if kept is not None else None
            ends, at, states = [], [], []
            for k, (symbol, slot, *fact) in enumerate(zip(*(_comparable(batch.column(c)) for c in facts), strict=True), shift):
                if (symbol, slot) != identity:
                    if identity is not None:
                        ends.append(k - 1)
                        at.append(holder)
                        states.append(state)
                    identity, state, holder = (symbol, slot), _EMPTY, None
                outcome = _decide(state, *fact)
                state = _after(state, outcome, *fact[:3])
                holder = None if state[0] is None else k if outcome in ("inserted", "revised") else holder
            if ends:
                yield closed(table.take(pa.array(ends, pa.int64())), table, at, states)
            whole = table.combine_chunks().to_batches()[0]
            kept = None if holder is None else whole.take(pa.array([holder]))
            last = whole.take(pa.array([whole.num_rows - 1]))
        if last is not None:
            bars = pa.Table.from_batches([last if kept is None else kept])
            yield closed(pa.Table.from_batches([last]), bars, [None if kept is None else 0], [state])

    kinds = {f.name: f.dataType for f in deliveries.schema}
    schema = StructType().add("symbol", kinds["symbol"]).add("slot", kinds["slot"]).add("bar", kinds["bar"]).add("source", "string")
    return placed.mapInArrow(run, schema.add("conflict", BooleanType()).add("integrity", BooleanType()))


def canonical(deliveries: DataFrame, horizon: int = 960) -> DataFrame:
    """The bars that stand."""
    return merged(deliveries, horizon).where("bar is not null").select("symbol", "slot", "source", "bar.*")


def conflict_slots(deliveries: DataFrame, horizon: int = 960) -> DataFrame:
    return merged(deliveries, horizon).where("conflict and bar is null").select("symbol", "slot")


def against_sealed(historical: DataFrame, sealed: DataFrame) -> DataFrame:
    """symbol, slot and comparison of each historical bar with the sealed live one: unmatched, equal or different.

    Both have symbol, slot and bar (a struct of values); ``sealed`` has at most one row per identity.
    """
    live = sealed.select("symbol", "slot", F.col("bar").alias("live_bar"))
    comparison = F.when(F.col("live_bar").isNull(), "unmatched").when(F.col("bar").eqNullSafe(F.col("live_bar")), "equal").otherwise("different")
    return historical.join(live, ["symbol", "slot"], "left").select("symbol", "slot", comparison.alias("comparison"))

"""Keyed state that outlives a micro-batch: qualification of a symbol, and the identities of its trades.

``qualified``: a symbol keeps its bars of the slots that may still change, and the ends that pass the gate. New
or corrected ticks of a slot alter the facts of the ends in (slot, slot + window] alone, so that only these
are evaluated again, and a proof that no longer holds is revoked. What is older than ``keep`` slots
behind the newest is folded away: its passing ends are counted, its bars dropped, its late ticks refused.

``repeated``: an identity keeps the least and greatest fingerprint of its trades until the watermark passes its time to
live; a repeat that differs marks it for good, which dropping duplicates would hide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slotwise.params import GateParams

#: A symbol's partial bars, one row a slot; ``first`` and ``last`` are the ticks that opened and closed it.
_BAR = np.dtype([("slot", "i8"), ("first", "i8"), ("open", "f8"), ("high", "f8"), ("low", "f8"), ("last", "i8"), ("close", "f8"), ("volume", "i8"), ("turnover", "f8"), ("n", "i8")])


def _bars_of(ticks: pd.DataFrame, slot_seconds: int) -> np.ndarray:
    """Partial bars of ticks (sec, seq, price, size) with a positive finite price."""
    ticks = ticks[(ticks.price > 0) & np.isfinite(ticks.price)]
    out = np.zeros(len(ticks), dtype=_BAR)
    out["slot"], out["first"], out["last"], out["n"] = ticks.sec // slot_seconds, ticks.seq, ticks.seq, 1
    out["open"] = out["high"] = out["low"] = out["close"] = ticks.price
    out["volume"] = ticks["size"].fillna(0)
    out["turnover"] = ticks.price * ticks["size"].fillna(0)
    return _combined(out)


def _combined(rows: np.ndarray) -> np.ndarray:
    """One partial bar a slot."""
    if not len(rows):
        return rows
    by_first = rows[np.lexsort((rows["first"], rows["slot"]))]
    at = np.flatnonzero(np.diff(by_first["slot"], prepend=by_first["slot"][0] - 1))
    out = by_first[at].copy()
    by_last = rows[np.lexsort((rows["last"], rows["slot"]))]
    end = np.append(at[1:], len(rows)) - 1
    out["last"], out["close"] = by_last["last"][end], by_last["close"][end]
    out["high"], out["low"] = np.maximum.reduceat(by_first["high"], at), np.minimum.reduceat(by_first["low"], at)
    for name in ("volume", "turnover", "n"):
        out[name] = np.add.reduceat(by_first[name], at)
    return out


def passing(bars: np.ndarray, ends: np.ndarray, gate: GateParams) -> np.ndarray:
    """Which of ``ends`` (ascending) pass the gate, by the bars of the window before each."""
    if not len(ends) or not len(bars):
        return np.zeros(len(ends), dtype=bool)
    first = int(ends[0]) - gate.window
    size = int(ends[-1]) - first
    inside = bars[(bars["slot"] >= first) & (bars["slot"] < first + size)]
    at = inside["slot"] - first

    def windows(values: np.ndarray, empty: float = 0.0) -> np.ndarray:
        dense = np.full(size, empty)
        dense[at] = values
        return np.lib.stride_tricks.sliding_window_view(dense, gate.window)[ends - ends[0]]

    here = windows(np.ones(len(at))) > 0
    volume = windows(inside["volume"])
    ats = inside["volume"] // np.maximum(inside["n"], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        trades = windows(np.where(ats > 0, inside["volume"] / np.where(ats > 0, ats, 1), 0.0))
        dollars = windows(np.where(inside["volume"] > 0, inside["turnover"], np.nan))
        unrated = here & (windows(ats) <= 0)
        short = slice(gate.window - gate.short_window, None)
        column = np.arange(gate.window)
        # Slots since the last bar, at each slot and at the end.
        last = np.maximum.accumulate(np.where(here, column, -1), axis=1)
        gap = np.maximum((column - last).max(axis=1), 0)
        latest = last[:, -1]
        close = windows(inside["close"])[np.arange(len(ends)), np.maximum(latest, 0)]
        total = volume.sum(axis=1)
        return (
            (latest >= 0) & (close >= gate.min_price) & (here.sum(axis=1) >= gate.min_present) & (gap <= gate.max_gap)
            & ~unrated.any(axis=1) & (trades.sum(axis=1) >= gate.min_trades) & (trades[:, short].sum(axis=1) >= gate.min_short_trades)
            & (np.nansum(dollars, axis=1) >= gate.min_dollar_volume) & (volume.max(axis=1) <= gate.max_concentration * total) & (total > 0)
        )


def revalidated(bars: np.ndarray, proofs: np.ndarray, changed: np.ndarray, gate: GateParams, last_end: int) -> np.ndarray:
    """The passing ends after the bars of ``changed`` slots are new: only ends that see one of them are evaluated."""
    affected = np.unique((changed[:, None] + np.arange(1, gate.window + 1)).ravel())
    affected = affected[affected <= last_end]
    return np.union1d(np.setdiff1d(proofs, affected), affected[passing(bars, affected, gate)])


_STATE = "bars binary, proofs binary, folded_first bigint, folded_last bigint, folded bigint, newest bigint, late bigint"
_FOUND = "symbol {}, first_pass bigint, last_pass bigint, proofs bigint, finalized_at bigint, late bigint"


def qualified(ticks: DataFrame, gate: GateParams, slot_seconds: int, start: int, last_end: int, keep: int, now_slot: int, horizon_slots: int) -> DataFrame:
    """A stream of ticks (symbol, sec, seq, price, size) -> the latest first_pass, last_pass, proofs and finalized_at per symbol.

    Slots before ``start`` and from ``last_end`` on are not read. ``late`` counts ticks that came after their slot was folded.
    """

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            raw, kept, first, last, folded, newest, late = state.get
            bars, proofs = np.frombuffer(raw, dtype=_BAR), np.frombuffer(kept, dtype="i8")
        else:
            bars, proofs, first, last, folded, newest, late = np.zeros(0, dtype=_BAR), np.zeros(0, dtype="i8"), None, None, 0, start, 0
        new = np.zeros(0, dtype=_BAR)
        oldest = newest - keep
        for batch in batches:
            found = _bars_of(batch, slot_seconds)
            found = found[(found["slot"] >= start) & (found["slot"] < last_end)]
            late += int(found["n"][found["slot"] < oldest].sum())
            new = _combined(np.concatenate([new, found[found["slot"] >= oldest]]))
        if len(new):
            bars = _combined(np.concatenate([bars, new]))
            proofs = revalidated(bars, proofs, new["slot"], gate, last_end)
            newest = max(newest, int(new["slot"].max()))
        # A slot that can no longer change needs its bar only for the windows of those that can.
        closed = proofs <= newest - keep
        if closed.any():
            first = int(proofs[0]) if first is None else first
            last, folded = int(proofs[closed][-1]), folded + int(closed.sum())
        bars, proofs = bars[bars["slot"] >= newest - keep - gate.window], proofs[~closed]
        state.update((bars.tobytes(), proofs.tobytes(), first, last, folded, newest, late))
        every = ([first] if first is not None else []) + proofs.tolist()
        # A proof older than the first one in state was final before it.
        final = next((e for e in every if now_slot > e + horizon_slots), None)
        yield pd.DataFrame({
            "symbol": [key[0]], "first_pass": pd.array([every[0] if every else None], "Int64"), "last_pass": pd.array([proofs.tolist()[-1] if len(proofs) else last], "Int64"),
            "proofs": [folded + len(proofs)], "finalized_at": pd.array([final], "Int64"), "late": [late],
        })

    kind = ticks.schema["symbol"].dataType.simpleString()
    return ticks.groupBy("symbol").applyInPandasWithState(update, _FOUND.format(kind), _STATE, "update", GroupStateTimeout.NoTimeout)


#: Parts of the keyed state of ``repeated``: each holds the identities of one hash as a packed table.
PARTS = 1024


def _forgotten(known: pa.Table, watermark: int) -> pa.Table:
    return known.filter(pc.or_(known["touched"], pc.greater_equal(known["expires"], watermark)))


def repeated(trades: DataFrame, identity: list[str], content: list[str], seconds: int, late_seconds: int, parts: int = PARTS) -> DataFrame:
    """A stream of trades with at and seq -> seq (of the first), copies and unequal of each identity that a batch touched.

    An identity is forgotten ``seconds`` after its last trade, when the watermark has passed that. Identities are kept in
    ``parts`` packed tables by their hash, so that a call of Python serves many of them.
    """
    kinds = {name: trades.schema[name].dataType for name in identity}
    # Texts carry nulls and long integers through pandas as they are.
    rows = trades.withWatermark("at", f"{late_seconds} seconds").select(
        F.pmod(F.xxhash64(*identity), F.lit(parts)).alias("part"), *(F.col(name).cast("string").alias(f"_{k}") for k, name in enumerate(identity)),
        "at", F.col("seq").cast("string").alias("seq"), F.xxhash64(*content).cast("string").alias("print"), F.unix_millis("at").cast("string").alias("ms"),
    )
    keys = [f"_{k}" for k in range(len(identity))]
    fields = {key: pa.string() for key in keys} | {"seq": pa.int64(), "low": pa.int64(), "high": pa.int64(), "copies": pa.int64(), "newest": pa.int64(), "expires": pa.int64(), "touched": pa.bool_()}
    schema = pa.schema(list(fields.items()))

    def met(batch: pd.DataFrame) -> pa.Table:
        texts = {name: pa.array(batch[name], pa.string(), from_pandas=True) for name in [*keys, "seq", "print", "ms"]}
        prints, n = texts["print"].cast(pa.int64()), len(batch)
        given = {"seq": texts["seq"].cast(pa.int64()), "low": prints, "high": prints, "copies": pa.array(np.ones(n, dtype="i8")), "newest": texts["ms"].cast(pa.int64()), "expires": pa.nulls(n, pa.int64()), "touched": pa.array(np.ones(n, dtype=bool))}
        return pa.table([texts[k] if k in keys else given[k] for k in fields], schema=schema)

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        known = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else schema.empty_table()
        if not state.hasTimedOut:
            every = pa.concat_tables([known, *(met(batch) for batch in batches)])
            sums = {"seq": "min", "low": "min", "high": "max", "copies": "sum", "newest": "max", "expires": "max", "touched": "max"}
            found = every.group_by(keys).aggregate(list(sums.items()))
            known = pa.table([found[k] if k in keys else found[f"{k}_{sums[k]}"] for k in fields], schema=schema)
            touched = known["touched"]
            later = pc.max_element_wise(pc.add(pc.fill_null(known["newest"], 0), seconds * 1000), pa.scalar(watermark + 1))
            known = known.set_column(known.schema.get_field_index("expires"), "expires", pc.if_else(touched, later, known["expires"]))
        known = _forgotten(known, watermark)
        mine = known.filter(known["touched"])
        if not len(known):
            state.remove()
        else:
            known = known.set_column(known.schema.get_field_index("touched"), "touched", pa.array(np.zeros(len(known), dtype=bool)))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                writer.write_table(known)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(pc.min(known["expires"]).as_py(), watermark + 1))
        if len(mine):
            out = {key: mine[key].to_pandas() for key in keys}
            yield pd.DataFrame(out | {"seq": mine["seq"].cast(pa.string()).to_pandas(), "copies": mine["copies"].to_pandas(), "unequal": pc.not_equal(mine["low"], mine["high"]).to_pandas()})

    texts = ", ".join(f"{key} string" for key in keys)
    found = rows.groupBy("part").applyInPandasWithState(update, f"{texts}, seq string, copies bigint, unequal boolean", "known binary", "update", GroupStateTimeout.EventTimeTimeout)
    back = (F.col(key).cast(kinds[name]).alias(name) for key, name in zip(keys, identity, strict=True))
    return found.select(*back, F.col("seq").cast("bigint").alias("seq"), "copies", "unequal")


def latest_updates(stream: DataFrame, root: str, keys: list[str], each: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Run a stream of updates over what is there and return the last update of each key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/updates/batch_id={batch_id}")
        if each is not None:
            each(batch)

    running: StreamingQuery = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    running.awaitTermination()
    updates = stream.sparkSession.read.parquet(f"{root}/updates")
    rest = [c for c in stream.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_last")).select(*keys, "_last.*")

"""Exact removal of repeated byte strings: every byte that a string of ``length`` bytes covers goes if
the same string starts earlier in the corpus.

Windows of ``length`` bytes are never shuffled one by one. Each window is given to its anchor, its
24-byte gram with the least hash; equal windows have equal anchors at equal places, and a run of
windows with one anchor is a span of some 140 bytes. Spans that agree as a whole are settled by one
comparison of positions. Only where one anchor stands in different spans do the spans' bytes travel,
and their windows are compared one by one. Copies inside an Arrow batch are settled before the shuffle,
so that a passage that a third of the corpus repeats reaches it a few times per task.

Defined results: a null text has no bytes. A row whose doc_id is null loses nothing and covers nothing.
Rows that repeat a doc_id with the same text are one document; with different texts they are ordered by
a hash of the text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_spans, words
from .line_dedup import fingerprint
from .staging import staged

LENGTH = 100
#: Spans of one anchor that a task compares at once; those of a more frequent anchor are compared by shuffled windows.
BUCKET = 50_000

_SPAN = "doc_id bigint, row int, start int, n int, at int, anchor bigint, span bigint"


def _merged_runs(doc: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of each (doc, row), united where they overlap or touch."""
    order = np.lexsort((lo, row, doc))
    doc, row, lo, hi = doc[order], row[order], lo[order], hi[order]
    if not len(doc):
        return doc, row, lo, hi
    change = np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])
    part = np.cumsum(change) - 1
    reach = np.maximum.accumulate(hi + part * (1 << 40)) - part * (1 << 40)  # running maximum within a document
    new = change | np.concatenate([[True], lo[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(lo)]]) - 1
    return doc[first], row[first], lo[first], reach[last]


def spans(docs: DataFrame, length: int) -> DataFrame:
    """A row per span that a batch holds for the first time, and per run of what it holds again (at = -1)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8)
                start, n, anchor, span, at = byte_spans.spans(data, length)
                parts.append((np.full(len(start), doc, dtype=np.int64), np.full(len(start), row, dtype=np.int64), start, n, at, anchor, span))
            if not parts:
                continue
            doc, row, start, n, at, anchor, span = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, row, doc, span, anchor))
            doc, row, start, n, at, anchor, span = (x[order] for x in (doc, row, start, n, at, anchor, span))
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])
            first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, dtype=np.int64)
            again = ~new & ((doc != doc[first]) | (row != row[first]) | (start != start[first]))
            d, r, lo, hi = _merged_runs(doc[again], row[again], start[again], start[again] + n[again] - 1 + length)
            own = words.mixed(d.astype(np.uint64) + (lo.astype(np.uint64) << np.uint64(40)))
            arrays = [
                np.concatenate([doc[new], d]), np.concatenate([row[new], r]).astype(np.int32), np.concatenate([start[new], lo]).astype(np.int32),
                np.concatenate([n[new], hi - lo + 1 - length]).astype(np.int32), np.concatenate([at[new], np.full(len(d), -1)]).astype(np.int32),
                np.concatenate([anchor[new], own]).view(np.int64), np.concatenate([span[new], words.mixed(own + np.uint64(1))]).view(np.int64),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["doc_id", "row", "start", "n", "at", "anchor", "span"])

    return docs.mapInArrow(cut, _SPAN)


def _windows(table: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """Row number, start, anchor's place and hash of every window of a table of spans."""
    column = table["bytes"].combine_chunks()
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    ranges = byte_spans.Ranges(data[bounds[0] : bounds[-1]])
    n = table["n"].to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (bounds[:-1] - bounds[0])[row] + turn
    start = table["start"].to_numpy().astype(np.int64)[row] + turn
    place = table["at"].to_numpy().astype(np.int64)[row] - start
    return row, start, place, ranges.hashes(at, at + length)


def _repeats(length: int, bucket: int):  # noqa: ANN202
    """Compares the windows of spans that arrive sorted by anchor, document and start."""
    out_names = ["doc_id", "row", "lo", "hi", "h1", "h2"]

    def settle(table: pa.Table, pending: bool) -> pa.RecordBatch:
        row, start, place, found = _windows(table, length)
        anchor = table["anchor"].to_numpy().view(np.uint64)[row]
        key = words.mixed(anchor + place.astype(np.uint64))
        order = np.lexsort((key, found))  # stable, so that the earliest of equals comes first
        new = np.ones(len(order), dtype=bool)
        new[1:] = (found[order][1:] != found[order][:-1]) | (key[order][1:] != key[order][:-1])
        again = np.sort(order[~new])
        doc, rows = table["doc_id"].to_numpy(), table["row"].to_numpy().astype(np.int64)
        d, r, lo, hi = _merged_runs(doc[row[again]], rows[row[again]], start[again], start[again] + length)
        # The first of each in a part of a bucket may still repeat one of another part: its window goes on with its hashes.
        left = np.sort(order[new]) if pending else order[:0]
        open_ = np.arange(len(d) + len(left)) >= len(d)
        arrays = [
            pa.array(np.concatenate([d, doc[row[left]]])), pa.array(np.concatenate([r, rows[row[left]]]).astype(np.int32)),
            pa.array(np.concatenate([lo, start[left]]).astype(np.int32)), pa.array(np.concatenate([hi, start[left] + length]).astype(np.int32)),
            *(pa.array(np.concatenate([np.zeros(len(d), dtype=np.uint64), h[left]]).view(np.int64), mask=~open_) for h in (found, key)),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=out_names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        overflowing = None  # the anchor whose spans no longer fit
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            anchors = table["anchor"].to_numpy()
            if not len(anchors):
                continue
            if overflowing is not None:
                rest = int(np.searchsorted(anchors != overflowing, True)) if anchors[0] == overflowing else 0
                if rest:
                    yield settle(table.slice(0, rest), pending=True)
                table, anchors = table.slice(rest), anchors[rest:]
                if not len(anchors):
                    held = None
                    continue
                overflowing = None
            cut = int(np.flatnonzero(anchors != anchors[-1])[-1]) + 1 if (anchors != anchors[-1]).any() else 0
            if cut:
                yield settle(table.slice(0, cut), pending=False)
            held = table.slice(cut)
            if len(held) > bucket:
                overflowing = anchors[-1]
                yield settle(held, pending=True)
                held = None
        if held is not None and len(held):
            yield settle(held, pending=False)

    return run


def repeated_intervals(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, row, lo, hi: byte intervals whose every byte a string covers that starts earlier too."""
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), fingerprint(F.col("text")).alias("row"), "text")
    same = Window.partitionBy("anchor", "span").orderBy("doc_id", "row", "start")
    beside = Window.partitionBy("anchor")
    # One exchange by anchor and one sort serve all three windows.
    placed = spans(known, length).repartition("anchor")
    judged = (
        placed.withColumn("turn", F.row_number().over(same))
        .withColumn("order", F.dense_rank().over(same))
        .withColumn("mixed", F.min("span").over(beside) != F.max("span").over(beside))
    )
    repeated = (F.col("at") < 0) | (F.col("order") > 1)
    judged = staged(judged.where(repeated | (F.col("mixed") & (F.col("turn") == 1))).withColumn("repeated", repeated).drop("turn", "order", "mixed", "span"), "spans")
    whole = judged.where("repeated").select("doc_id", "row", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + length).alias("hi"))

    one = F.struct("anchor", "start", "n", "at")
    asked = judged.where("not repeated").groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list(one).alias("asked"))
    # Equal rows are one document: a span that is asked for travels once. The join uses the same exchange.
    once = known.repartition("doc_id", "row").distinct()
    texts = once.join(asked.hint("shuffle_hash"), (F.col("doc_id") == F.col("d")) & (F.col("row") == F.col("r")))
    data = F.col("text").cast("binary")
    with_bytes = F.transform("asked", lambda s: F.struct(s["anchor"].alias("anchor"), s["start"].alias("start"), s["n"].alias("n"), s["at"].alias("at"), F.substring(data, s["start"] + 1, s["n"] + length - 1).alias("bytes")))
    each = texts.select("doc_id", "row", F.explode(with_bytes).alias("s")).select("doc_id", "row", "s.*")
    ordered = each.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "row", "start")
    found = staged(ordered.mapInArrow(_repeats(length, bucket), "doc_id bigint, row int, lo int, hi int, h1 bigint, h2 bigint"), "windows")
    settled = found.where("h1 is null").select("doc_id", "row", "lo", "hi")
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "row", "lo"))
    late = found.where("h1 is not null").withColumn("order", rank).where("order > 1").select("doc_id", "row", "lo", "hi")
    return whole.unionByName(settled).unionByName(late)


def kept_bytes(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and kept (binary) of each row of ``docs``."""
    runs = repeated_intervals(docs, length, bucket).groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    joined = rows.join(runs.hint("shuffle_hash"), (F.col("doc_id") == F.col("d")) & (fingerprint(F.col("text")) == F.col("r")), "left").select("doc_id", "text", "runs")

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, intervals in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                found = np.array([(x["lo"], x["hi"]) for x in intervals.as_py() or ()], dtype=np.int64).reshape(-1, 2)
                same = np.zeros(len(found), dtype=np.int64)
                _, _, lo, hi = _merged_runs(same, same, found[:, 0], found[:, 1])
                ends = [0, *hi.tolist()]
                kept = b"".join(data[a:b] for a, b in zip(ends, [*lo.tolist(), len(data)], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(lo), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return kept_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Packing of tokenised documents into fixed-length training sequences.

Spark tokenises and cuts the documents and counts the pieces by length. That histogram has at most
``capacity`` entries whatever the corpus holds, so the packing itself is a small linear program over
bin configurations: multiplicative weights set a price per length, a knapsack dynamic program finds
the best-priced configuration, and the fractional solution is rounded down, re-solved on what is left
and finished by best-fit decreasing. Spark then ranks the pieces within each length (in salted chunks
with running offsets, so that a very common length is no hot task) and each piece looks up the
configuration that its rank falls in.

Defined results: a null text is an empty one, which is the end token alone; a null doc_id is packed
like any other; repeated rows are packed each. No rows give no pieces. Texts of any length are encoded whole,
long runs of white space included. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import staged

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
CAPACITY = 2048
CHUNK_ROWS = 100_000
_OTHER_SCRIPT = re.compile("[^\x00-\u024f]")
#: The faster library fails on runs of white space some ten times as long.
_LONG_SPACE = re.compile(r"\s{10000}")


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TokenBytes:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    The tokenizer file decides the ids. Texts of Latin script are encoded from the same vocabulary
    by the faster of the two installed libraries (their ids agree on these characters, which the
    tests check one by one); any other text, one that spells out a token added to the vocabulary, and one
    with a long run of white space are encoded by the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [token.content for token in self.model.get_added_tokens_decoder().values()]
        self.fast = _same_vocabulary(path)

    def __call__(self, text: str) -> bytes:
        if self.fast is not None and not _OTHER_SCRIPT.search(text) and not _LONG_SPACE.search(text) and not any(token in text for token in self.added):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.model.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


def _same_vocabulary(path: str):  # noqa: ANN202
    """A tiktoken encoding of the ranks that lie beside the tokenizer file; None without them."""
    ranks = f"{path.removesuffix('.json')}.tiktoken"
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@functools.cache
def token_bytes(path: str) -> TokenBytes:
    """One for all tasks of a worker process."""
    return TokenBytes(path)


PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """A row for each piece of each document: all pieces but the first have ``capacity`` ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path or tokenizer_file())
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens(text.as_py() or "") + end
                total = len(ids) // 4
                bounds = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    out.append((doc, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])))
            columns = list(zip(*out, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


def best_configuration(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length (ascending) fill one bin at the highest total price."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            value = best[room - lengths[:n]] + price[:n]
            k = int(value.argmax())
            if value[k] > best[room]:
                best[room], taken[room] = value[k], k
    count, room = np.zeros(len(lengths), dtype=np.int64), capacity
    while room > 0:
        if (k := taken[room]) < 0:
            room -= 1
        else:
            count[k] += 1
            room -= lengths[k]
    return count


def solve_fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, eta: float = 4.0) -> list[tuple[np.ndarray, float]]:
    """Configurations and fractional numbers of bins whose sum covers the counts, by multiplicative weights."""
    cover = np.zeros(len(lengths))
    found: dict[bytes, list] = {}
    for _ in range(rounds):
        open_ = cover < 1
        if not open_.any():
            break
        price = np.where(open_, lengths * np.exp(-eta * (cover - cover.min())), 0)
        config = best_configuration(lengths, price, capacity) * open_
        if not config.any():
            break
        gain = config / counts
        step = min(0.5, float((1 - cover[config > 0]).max())) / gain.max()
        cover += gain * step
        found.setdefault(config.tobytes(), [config, 0.0])[1] += step
    return [(c, x) for c, x in found.values()]


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: bins of equal content are handled together."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    for k in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[k]), int(left[k])
        while n:
            room = min((r for r, bins in open_.items() if r >= size and bins), default=None)
            if room is None:
                per = capacity // size
                if n >= per:
                    open_.setdefault(capacity - per * size, []).append(({size: per}, n // per))
                    n %= per
                else:
                    open_.setdefault(capacity - n * size, []).append(({size: n}, 1))
                    n = 0
                continue
            content, bins = open_[room].pop()
            used = min(bins, n)
            if bins > used:
                open_[room].append((content, bins - used))
            open_.setdefault(room - size, []).append((content | {size: content.get(size, 0) + 1}, used))
            n -= used
    return [x for bins in open_.values() for x in bins]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 500) -> list[tuple[dict[int, int], int]]:
    """Contents (length -> number) and number of bins that hold the histogram exactly."""
    out = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    items = sorted((k, n) for k, n in histogram.items() if 0 < k < capacity and n > 0)
    lengths = np.array([k for k, _ in items], dtype=np.int64)
    left = np.array([n for _, n in items], dtype=np.int64)
    while left.sum() > 2 * capacity:  # fewer are best-fitted at once
        before, live = left.sum(), left > 0
        for config, x in sorted(solve_fractional(lengths[live], left[live], capacity, rounds), key=lambda c: -c[1]):
            full = np.zeros(len(lengths), dtype=np.int64)
            full[live] = config
            bins = min(int(x + 1e-9), int((left[full > 0] // full[full > 0]).min()))
            if bins > 0:
                out.append(({int(lengths[k]): int(full[k]) for k in np.flatnonzero(full)}, bins))
                left = left - bins * full
        if left.sum() > 0.7 * before:
            break
    return out + best_fit(lengths, left, capacity)


def segments(plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces a bin, first bin, first offset), by rank."""
    used = dict.fromkeys(range(capacity + 1), 0)
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for content, bins in plan:
        offset = 0
        for length, n in content.items():
            out.setdefault(length, []).append((used[length], n, base, offset))
            used[length] += n * bins
            offset += n * length
        base += bins
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def ranked(pieces: DataFrame, most: int) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, 2... within each length; no window holds more than a chunk of a length."""
    chunks = max(64, -(-most // CHUNK_ROWS))
    chunked = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    sizes = chunked.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    numbered = chunked.withColumn("k", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("k")).drop("chunk", "k", "before")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece of ``docs`` with its sequence and its place there."""
    pieces = staged(pieces_of(docs, capacity, path), "pieces")
    # At most ``capacity`` rows, whatever the corpus holds.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = segments(plan_bins(histogram, capacity), capacity)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for one in np.unique(length):
                here = length == one
                rows = table[int(one)]
                row = rows[np.searchsorted(rows[:, 0], rank[here], side="right") - 1]
                turn = rank[here] - row[:, 0]
                sequence[here] = row[:, 2] + turn // row[:, 1]
                offset[here] = row[:, 3] + turn % row[:, 1] * one
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    placed = ranked(pieces, max(histogram.values(), default=0)).mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")
    return placed.withColumn("length", F.col("length").cast("bigint"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""Hashed sparse features of whole texts and linear models on them.

A model is fitted on a bounded number of labelled rows: the rows with the smallest hashes of their
doc_id, ``MAX_ROWS`` of them at most. Their features are made on the executors; what reaches the driver
is bounded by that parameter whatever the corpus holds. Scoring covers every row, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a model is fitted on at most.
MAX_ROWS = 3000
BUCKETS = 1 << 16

#: word -> its feature buckets with their shares; ``previous`` is the word before it.
WordFeatures = Callable[[bytes], list[tuple[int, float]]]


def bucket(kind: bytes, token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(kind + token) % BUCKETS


def sampled_labels(labels: DataFrame, value: Column, rows: int = MAX_ROWS) -> DataFrame:
    """doc_id and label (the lowest given) of at most ``rows`` labelled documents, the same on every run."""
    one = labels.select("doc_id", value.alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    return one.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


class Rows:
    """A sparse matrix by rows, with labels."""

    def __init__(self, ends: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, width: int = BUCKETS):
        self.index, self.value, self.label, self.width = index, value, label, width
        self.row = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))

    def times(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weight[self.index], minlength=len(self.label))

    def transposed(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * g[self.row], minlength=self.width)


def training_rows(docs: DataFrame, labels: DataFrame, features: Callable[[str], dict[int, float]], width: int = BUCKETS) -> tuple[Rows, Rows]:
    """Features of the labelled documents: three quarters to fit on, one quarter held out."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or "") for t in batch.column("text").to_pylist()]
            index = pa.array([list(f.keys()) for f in found], pa.list_(pa.int32()))
            value = pa.array([list(f.values()) for f in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), index, value], names=["doc_id", "label", "index", "value"])

    # The labels are at most MAX_ROWS rows, so that they can be broadcast. Of rows that repeat a doc_id
    # the one with the least text is taken, so that no more rows than labels reach the driver.
    joined = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(labels.select("doc_id", F.col("label").cast("int"))), "doc_id")
    joined = joined.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    table = joined.mapInArrow(make, "doc_id bigint, label int, index array<int>, value array<float>").toArrow()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    held = np.arange(len(order)) % 4 == 3

    def rows(which: np.ndarray) -> Rows:
        part = table.take(pa.array(which))
        index, value = part["index"].combine_chunks(), part["value"].combine_chunks()
        ends = np.cumsum(np.diff(index.offsets.to_numpy())) if len(which) else np.zeros(0, dtype=np.int64)
        return Rows(ends, index.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False).astype(np.float64), part["label"].to_numpy(), width)

    return rows(order[~held]), rows(order[held])


def descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 120, rate: float = 0.5) -> np.ndarray:
    """Adam on the whole batch, its rate falling to a tenth."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))

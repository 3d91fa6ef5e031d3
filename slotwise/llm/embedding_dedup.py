"""Near-duplicate vectors by tiles of int8 products with rigorous error bounds.

Equal vectors of one label are first reduced to one, with their number. Each unit vector x is quantised
once to int8 codes times a scale; e(x), the norm of what that loses, is computed exactly and kept with the
codes. A label's vectors are dealt into blocks of at most about ``BLOCK`` by a hash, and every pair of blocks is one tile,
so that a label of any size spreads over many tasks of the same size. Codes alone are sent to the tiles, where
``|x.y - x'.y'| <= e(x) + e(y) + e(x) e(y)`` decides most pairs. Vectors with a pair that the bound leaves open meet in a
second round of tiles in full precision, which decides only the open pairs. A tile returns link counts and a
spanning forest of its links, never its pairs.

Defined results: an empty table gives no rows. A vector that is null, empty, zero or has null or non-finite components, and a row
whose label or id is null, links with nothing. Vectors of different lengths are not compared. Each row
counts as a vector of its own, so repeated rows link with each other, and rows that share a vec_id but
not their vector have the links of their own vector each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .staging import staged

THRESHOLD = 0.98
BLOCK = 4096
#: Vectors of a side of a block that are multiplied at a time.
PART = 1024
#: Pairs that are multiplied in double precision at a time.
PAIRS = 1 << 16
_SLACK = 1e-9


def usable(vector: Column, label: Column, vec_id: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec_id.isNotNull() & label.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, scales and exact quantisation errors."""
    exact = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # the same directions, without overflow
    unit = exact / np.sqrt((exact**2).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))


def with_codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with codes, scale and error of their vectors, which may differ in length."""
    for batch in batches:
        vectors = batch.column("vector")
        codes, scales, errors = np.empty(len(batch), object), np.empty(len(batch)), np.empty(len(batch))
        lengths = np.asarray(pc.list_value_length(vectors))
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            flat = np.asarray(vectors.take(pa.array(rows)).flatten(), dtype=np.float64)
            c, scales[rows], errors[rows] = quantised(flat.reshape(len(rows), d))
            codes[rows] = [x.tobytes() for x in c]
        columns = [*batch.columns, pa.array(codes, pa.binary()), pa.array(scales), pa.array(errors)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "codes", "scale", "error"])


class Side:
    """One block's codes, scales and errors, and its vectors in full precision if they came along."""

    def __init__(self, pdf: pd.DataFrame):
        self.rep, self.n = pdf["rep"].to_numpy(), pdf["n"].to_numpy()
        self.scale, self.error = pdf["scale"].to_numpy(), pdf["error"].to_numpy()
        codes = np.frombuffer(b"".join(pdf["codes"]), np.int8).reshape(len(pdf), -1)
        # float32 sums of products of int8 codes are exact up to 2**24, float64 ones beyond.
        self.codes = codes.astype(np.float32 if codes.shape[1] * 127 * 127 < 1 << 24 else np.float64)
        if "vector" in pdf:
            vectors = np.stack(pdf["vector"]).astype(np.float64)
            self.exact = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            self.norm = np.sqrt((self.exact**2).sum(axis=1))


def judged(a: Side, b: Side, i: slice, j: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs surely have a cosine of at least ``threshold``, and which the bound leaves open."""
    rough = (a.codes[i] @ b.codes[j].T) * (a.scale[i, None] * b.scale[None, j])
    bound = a.error[i, None] + b.error[None, j] + a.error[i, None] * b.error[None, j] + _SLACK
    sure = rough - bound >= threshold
    return sure, ~sure & (rough + bound >= threshold)


def proven(a: Side, b: Side, i: slice, j: slice, open_: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the open pairs have a cosine of at least ``threshold`` in double precision."""
    out = np.zeros_like(open_)
    rows, columns = np.nonzero(open_)
    for k in range(0, len(rows), PAIRS):
        x, y = rows[k : k + PAIRS], columns[k : k + PAIRS]
        p, q = x + i.start, y + j.start
        out[x, y] = (a.exact[p] * b.exact[q]).sum(axis=1) / (a.norm[p] * b.norm[q]) >= threshold
    return out


def root(group: dict[int, int], x: int) -> int:
    while group.setdefault(x, x) != x:
        group[x] = x = group[group[x]]
    return x


def spanning(link: np.ndarray, a: np.ndarray, b: np.ndarray, group: dict[int, int]) -> list[tuple[int, int]]:
    """Pairs of ids that connect what the links connect, without those that ``group``, which takes them in, connects already."""
    out: list[tuple[int, int]] = []
    left = link.copy()
    while left.any():
        pairs = [(i, int(left[i].argmax())) for i in np.flatnonzero(left.any(axis=1))]
        pairs += [(int(left[:, j].argmax()), j) for j in np.flatnonzero(left.any(axis=0))]
        for i, j in pairs:
            x, y = root(group, int(a[i])), root(group, int(b[j]))
            if x != y:
                group[max(x, y)] = min(x, y)
                out.append((int(a[i]), int(b[j])))
        of_a, of_b = np.array([root(group, int(x)) for x in a]), np.array([root(group, int(x)) for x in b])
        left &= of_a[:, None] != of_b[None, :]
    return out


_CODES = [T.StructField("codes", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("error", T.DoubleType())]
FOUND = "rep bigint, links bigint, other bigint, block int, low int, high int"


def _tile(threshold: float, exact: bool, step: int):  # noqa: ANN202
    """One tile: sure links and the vectors with open pairs, or (``exact``) the open pairs that are links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        first, second = pdf[pdf["block"] == low], pdf[pdf["block"] == high]
        out = []
        if not first.empty and not second.empty:
            a = Side(first)
            b = a if low == high else Side(second)
            links_a, links_b = np.zeros(len(first), np.int64), np.zeros(len(second), np.int64)
            open_a, open_b = np.zeros(len(first), bool), np.zeros(len(second), bool)
            group: dict[int, int] = {}
            edges: list[tuple[int, int]] = []
            for s in range(0, len(first), step):
                for t in range(s if a is b else 0, len(second), step):
                    i, j = slice(s, min(s + step, len(first))), slice(t, min(t + step, len(second)))
                    link, open_ = judged(a, b, i, j, threshold)
                    if a is b and s == t:
                        np.fill_diagonal(link, False)
                        np.fill_diagonal(open_, False)
                    if exact:
                        link = proven(a, b, i, j, open_, threshold)
                    else:
                        open_a[i] |= open_.any(axis=1)
                        open_b[j] |= open_.any(axis=0)
                    links_a[i] += link @ b.n[j]
                    if a is not b or s != t:
                        links_b[j] += a.n[i] @ link
                    edges += spanning(link, a.rep[i], b.rep[j], group)
            if a is b:
                links_a, open_a = links_a + links_b, open_a | open_b
            for side, links, opened, block in ((a, links_a, open_a, low), (b, links_b, open_b, high))[: 1 if a is b else 2]:
                out.append(pd.DataFrame({"rep": side.rep, "links": links}).query("links > 0"))
                out.append(pd.DataFrame({"rep": side.rep[opened], "links": 0, "block": block, "low": low, "high": high}))
            out.append(pd.DataFrame(edges, columns=["rep", "other"]).assign(links=0))
        found = pd.concat([pd.DataFrame(columns=["rep", "links", "other", "block", "low", "high"], dtype="Int64"), *(x.astype("Int64") for x in out)])
        return found.astype({"rep": "int64", "links": "int64", "block": "Int32", "low": "Int32", "high": "Int32"})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vec_id, label, embedding."""
    vector = F.col("embedding")
    hashed = vectors.select(
        "vec_id", "label", vector.alias("vector"), F.size("embedding").alias("dim"),
        usable(vector, F.col("label"), F.col("vec_id")).alias("usable"),
        F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), vector).alias("h2"),
    )
    key = ["label", "dim", "h1", "h2"]
    classes = hashed.where("usable").groupBy(*key).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    # Classes have numbers of their own, written with them, as several may share a vec_id.
    classes = classes.withColumn("rep", F.monotonically_increasing_id())
    schema = T.StructType(classes.schema.fields + _CODES)
    classes = staged(classes.mapInArrow(with_codes, schema), "vectors")
    blocks = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = classes.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep", "h1"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    coded = ["rep", "n", "codes", "scale", "error"]
    tiles = paired.select("label", "dim", F.least("block", "mate").alias("low"), F.greatest("block", "mate").alias("high"), "block", *coded)
    tile = ["label", "dim", "low", "high"]
    sure = staged(tiles.groupBy(*tile).applyInPandas(_tile(threshold, exact=False, step=part), FOUND), "tiles")
    opened = sure.where("low is not null").select("rep", "block", "low", "high").join(classes.select("label", "dim", *coded, "vector"), "rep")
    proofs = staged(opened.groupBy(*tile).applyInPandas(_tile(threshold, exact=True, step=part), FOUND), "open-tiles")
    found = sure.where("low is null").unionByName(proofs)
    links = found.where(F.col("other").isNull()).groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where(F.col("other").isNotNull()).select(F.col("rep").alias("a"), F.col("other").alias("b")))
    placed = classes.select(*key, "rep", "least", "n").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    lowest = placed.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = (
        placed.join(links, "rep", "left")
        .join(lowest, "component", "left")
        .select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    rows = hashed.select("vec_id", *key, "usable")
    linked_rows = rows.where("usable").join(per_class, key).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.rid AS a, b.rid AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reached(rid, other) AS (SELECT rid, rid FROM v UNION SELECT r.rid, p.b FROM reached r JOIN pairs p ON p.a = r.other),
component AS (SELECT r.rid, min(o.vec_id) AS component_id FROM reached r JOIN v o ON o.rid = r.other GROUP BY r.rid)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v JOIN component USING (rid) LEFT JOIN (SELECT a AS rid, count(*) AS n FROM pairs GROUP BY a) USING (rid)
"""

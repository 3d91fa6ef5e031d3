"""Exact Jaccard join of documents on word shingles, by parity sketches.

Sets A and B reach a Jaccard similarity of t only if their symmetric difference d is at most
``(1 - t) / (1 + t) * (|A| + |B|)``. Each document's shingles are dealt by hash into m parts, and each
part XORs one bit per shingle into a parity word, so that the Hamming distance of two sketches is at
most d and at most d parts differ. m exceeds the largest d of its size band, hence two documents that
link agree in a word: the join is on (band, part, word). A word has a bit for every hash there is, so
that parts of few shingles seldom agree by accident however large the corpus; as all but a few of its
bits are zero, it is kept as the XOR of a hash of each set bit. A document also takes part in the next
band's scheme if a larger partner there is possible. A further 256-bit sketch of the whole set rejects
most accidental partners before any text is fetched; what is left is verified on the exact sets.

Equal sets are one node from the start. Then every bucket compares its members with one of them, the
links found are merged, and only pairs of the same bucket that are still in different components are
compared directly, so that groups of near copies are not expanded into all their pairs.

A band has more parts than d needs, and a set of n shingles differs from its partners in at most the d
of its own n, so that linked sets agree in several words; pairs that share fewer are passed over. A part
that has no bit set proves nothing; these words are left out, and the number that must be shared is
lowered by them, as long as one is left. Otherwise they are used. No link is lost.

Defined results: a text that is null or has no words has an empty set and links with nothing. A row
whose doc_id is null is returned with its size and no component. Rows that repeat a doc_id are
one node if their texts agree, and are linked through their common id if not. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .components import components
from .staging import discard, staged

SKETCH = ["s0", "s1", "s2", "s3"]
#: Powers of 1 / similarity that a size band spans: wider bands cut sets finer, narrower ones write more of them twice.
REACH = 3
#: One part in so many is beyond the need. The more there are, the more words two linked sets share.
SLACK = 5
_ONE, _SIX_BITS = np.uint64(1), np.uint64(63)


@dataclass(frozen=True)
class Scheme:
    """Shingles of ``size`` words and a similarity of ``percent`` per cent or more."""

    size: int = 3
    percent: int = 90

    def edges(self) -> np.ndarray:
        """Lower bounds of the size bands; a band spans ``REACH`` times the reach of a link."""
        step = (100 / self.percent) ** REACH
        return step ** np.arange(int(np.log(2.0**40) / np.log(step)) + 2)

    def most_apart(self, total: int) -> int:
        """The largest symmetric difference of two linked sets of ``total`` elements together."""
        return (100 - self.percent) * total // (100 + self.percent)

    def parts(self, band: int, edges: np.ndarray) -> tuple[int, int]:
        """Number of parts of a band's sketches, and in how many of them linked sets of the band can differ."""
        apart = self.most_apart(2 * (int(np.ceil(edges[band + 1])) - 1))
        return (apart + 1 + apart // SLACK + 2, apart) if apart else (0, 0)


def bucket_keys(shingles: np.ndarray, scheme: Scheme, edges: np.ndarray) -> tuple[np.ndarray, int, int]:
    """A key for each parity word of each band that a set (sorted hashes) takes part in, and how many a link shares.

    The last is how many it shares at least with any partner: a set that falls back to its empty words
    asks for more, but a partner that publishes no empty words may share only one key with it.
    """
    n, need, least = len(shingles), 1 << 30, 1 << 30
    home = int(np.searchsorted(edges, n, side="right")) - 1
    out = [np.zeros(0, dtype=np.uint64)]
    apart = scheme.most_apart(n + 100 * n // scheme.percent)  # from the largest partner
    bits = words.mixed(shingles)
    high = shingles >> np.uint64(32)
    for band in (home, home + 1):
        if band > home and n + 1e-6 < edges[band] * scheme.percent / 100:
            break
        parts, most = scheme.parts(band, edges)
        if not parts:  # in this band only equal sets link
            continue
        part = (high * np.uint64(parts)) >> np.uint64(32)  # ascending, as the hashes are
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        word = np.bitwise_xor.reduceat(bits, starts)
        part = part[starts]
        part, word = part[word != 0], word[word != 0]
        agree = parts - min(apart, most)
        missing = parts - len(part)
        need = min(need, agree - missing if missing < agree else agree)
        least = min(least, need if missing < agree else 1)
        if missing >= agree:
            full = np.zeros(parts, dtype=np.uint64)
            full[part.astype(np.int64)] = word
            part, word = np.arange(parts, dtype=np.uint64), full
        out.append(words.mixed(words.mixed(part + np.uint64(band << 40)) + word))
    return np.concatenate(out), need, least


def whole_sketch(shingles: np.ndarray) -> list[int]:
    bits = _ONE << (shingles >> np.uint64(6) & _SIX_BITS)
    row = shingles >> np.uint64(12) & np.uint64(3)
    return [int(np.bitwise_xor.reduce(bits[row == k], initial=np.uint64(0)).view(np.int64)) for k in range(4)]


def signed(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, n (set size), a 128-bit signature of the set, its sketch, and the keys a link shares (need; at least, least)."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = scheme.edges()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                s = words.shingle_set(text.as_py(), scheme.size)
                signature = int(s.sum().view(np.int64)), int(words.mixed(s + np.uint64(1)).sum().view(np.int64))
                _, need, least = bucket_keys(s, scheme, edges) if len(s) else (None, 0, 0)
                rows.append((len(s), *signature, *whole_sketch(s), need, least))
            table = np.array(rows, dtype=np.int64).reshape(-1, 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(9))], names=["doc_id", "n", "sig1", "sig2", *SKETCH, "need", "least"])
        words.forget()

    schema = "doc_id bigint, n bigint, sig1 bigint, sig2 bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, need bigint, least bigint"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(sketch, schema)


def keyed(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id and the bucket keys of each row's set; made again from the text, which is less than to keep them from the first reading."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = scheme.edges()
        for batch in batches:
            sets = (words.shingle_set(text.as_py(), scheme.size) for text in batch.column(1))
            keys = [bucket_keys(s, scheme, edges)[0].view(np.int64) if len(s) else np.zeros(0, dtype=np.int64) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["doc_id", "keys"])
        words.forget()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(sketch, "doc_id bigint, keys array<bigint>")


def _may_link(scheme: Scheme, a: str, b: str) -> Column:
    """Whether sizes and whole-set sketches of two rows allow a link."""
    apart = F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0")))
    for s in SKETCH[1:]:
        apart = apart + F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")))
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    near = F.least(x, y) * 100 >= F.greatest(x, y) * scheme.percent
    return near & (apart * (100 + scheme.percent) <= (x + y) * (100 - scheme.percent))


def _enough(a: str, b: str) -> Column:
    """Whether a pair shares as many keys as a link must."""
    fewest = F.greatest(F.least(f"{a}.need", f"{b}.need"), f"{a}.least", f"{b}.least")
    return F.col("shared") >= fewest


def verified(pairs: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) whose exact shingle sets link."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, held = [], None, None
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last or held is None:
                    last, held = a, words.shingle_set(x.as_py(), scheme.size)
                other = words.shingle_set(y.as_py(), scheme.size)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= scheme.percent * (len(held) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of_a = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(verify, "a bigint, b bigint").distinct()


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """rep and text of every id in the pairs (a, b); an id with several texts has a row for each."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    found = docs.join(ids, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text")
    several = found.repartition("rep").withColumn("h", F.xxhash64("text"))
    return several.dropDuplicates(["rep", "h"]).drop("h")


def bucket_rows(docs: DataFrame, reps: DataFrame, scheme: Scheme) -> DataFrame:
    """key, p and rep: the representatives that share a key with another, p the smallest of them, which meets the others.

    The keys are sent around once, by key.
    """
    mine = keyed(docs, scheme).join(reps, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    bucket = Window.partitionBy("key")
    return mine.withColumn("p", F.min("rep").over(bucket)).withColumn("q", F.max("rep").over(bucket)).where("p < q").select("key", "p", "rep")


def links(docs: DataFrame, mine: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b) of representatives of different sets that connect all that links connect (a staged table).

    ``mine`` has a row for each of their sets.
    """
    rows = staged(bucket_rows(docs, mine.select("rep").distinct(), scheme), "bucket-rows")
    met = staged(rows.groupBy("p", "rep").agg(F.count(F.lit(1)).alias("shared")), "met")
    # A set that shares fewer keys than a link does, with all others together, has no link.
    own = met.groupBy("rep").agg(F.sum("shared").alias("own"))
    sized = staged(own.join(mine.select("rep", "n", "need", "least", *SKETCH).distinct(), "rep").where("own >= least"), "candidates")
    both = met.where("p <> rep").join(sized.alias("y"), "rep").join(sized.withColumnRenamed("rep", "p").alias("z"), "p")
    star = both.where(_may_link(scheme, "y", "z") & _enough("y", "z"))
    star = staged(star.select(F.col("p").alias("a"), F.col("rep").alias("b")).distinct(), "star-pairs")
    found = staged(verified(star, texts_of(docs, star), scheme), "star-links")

    # Then the pairs of a bucket that are not connected yet, met in all the buckets that they share.
    joined = components(found).withColumnRenamed("node", "rep")
    labels = sized.join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labels = staged(labels.drop("own"), "labels")
    ends = labels.select("rep", "component").distinct()
    open_ = met.join(ends, "rep").join(ends.select(F.col("rep").alias("p"), F.col("component").alias("of_p")), "p", "left")
    open_ = open_.where(F.col("of_p").isNull() | (F.col("component") != F.col("of_p"))).select("p", "rep")
    keys = staged(rows.join(open_, ["p", "rep"], "left_semi").select("key").distinct(), "open-keys")
    left = staged(rows.join(keys, "key", "left_semi").select("key", "rep").distinct(), "open-rows")
    discard(rows, met, keys, sized)
    x, y = (left.join(labels, "rep").alias(name) for name in ("x", "y"))
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & _may_link(scheme, "x", "y")
    near = x.join(y, on).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), F.greatest(F.least("x.need", "y.need"), "x.least", "y.least").alias("fewest"))
    rest = near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("fewest").alias("fewest")).where("shared >= fewest")
    rest = staged(rest.select("a", "b").join(star, ["a", "b"], "left_anti"), "other-pairs")
    discard(left, labels, star)
    every = staged(found.unionByName(verified(rest, texts_of(docs, rest), scheme)), "links")
    discard(rest, found)
    return every


def near_copies(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``."""
    scheme = scheme or Scheme()
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    sets = staged(signed(docs, scheme), "sets")
    real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    key = ["n", "sig1", "sig2"]
    classes = staged(sets.where(real).groupBy(*key).agg(F.min("doc_id").alias("rep")), "set-classes")
    members = sets.select("doc_id", *key)
    reps = classes.select("rep").distinct()
    mine = sets.where(real).join(reps, F.col("doc_id") == F.col("rep"), "left_semi").withColumnRenamed("doc_id", "rep").drop("sig1", "sig2")
    mine = staged(mine, "sets-of-representatives")
    pairs = links(docs, mine, scheme)
    discard(mine)
    # A document of several texts connects their classes.
    own = members.where(real).join(classes, key).where(F.col("doc_id") != F.col("rep"))
    several = own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(pairs.unionByName(several)).select(F.col("node").alias("rep"), "component")
    members = members.join(classes.join(roots, "rep", "left"), key, "left")
    return members.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near copies: the smallest doc_id."""
    groups = near_copies(docs, scheme).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(groups, F.col("doc_id") == F.col("kept_id"), "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, p.b FROM reached r JOIN pairs p ON p.a = r.other),
component AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id FROM s JOIN component USING (doc_id)
"""

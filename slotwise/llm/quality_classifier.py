"""Quality classifier: ordinal regression on graded ratings.

A rating has three grades: 0 for poor text, 1 for acceptable but toxic text, 2 for acceptable text
without toxicity. A cumulative-link model gives them one score, a weighted sum of hashed features of
the whole text, and two ordered thresholds on it: P(grade <= k) = sigmoid(threshold_k - score). From
these come the expected grade and the tail probabilities P(grade >= 1) and P(grade >= 2); a document
is kept if the last tail, that of acceptable text without toxicity, reaches ``KEEP``. Features are each
word and its shape (letters, capitals, digits and other characters, runs shortened), and the share of
words that equal the word before, all per word of the text. A few toxic words in a long text would
drown in these, so that words which tell grade 1 from grade 2 in the sample also count by their
presence alone; they are chosen by how far the mean grade of their documents is from that of all.

Defined results: a null or wordless text has grade 0 and is not kept; a null doc_id is scored like
any other; repeated rows are scored each. Without ratings of two grades at least, every document with
a word is kept. Texts are read whole, however long; an empty table gives no rows. Columns of the
input other than ``text`` are passed on, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import linear, words

#: Low, as losing clean text costs more than a toxic text that stays.
KEEP = 0.3
#: Features of presence follow those of shares. Documents a word must be in, and how many standard errors off their grades.
WIDTH = 2 * linear.BUCKETS
MIN_DOCS, MIN_ERRORS = 5, 5.0
PENALTY = 1e-4
_SHAPES = [(re.compile(p), s) for p, s in ((r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a"), (r"\d+", "0"), (r"([^\w\s])\1+", r"\1\1"))]


def shape(word: bytes) -> bytes:
    text = word.decode()
    for pattern, to in _SHAPES:
        text = pattern.sub(to, text)
    return text[:12].encode()


def word_features(word: bytes) -> list[tuple[int, float]]:
    return [(linear.bucket(b"w", word.lower()), 1.0), (linear.bucket(b"s", shape(word)), 1.0)]


def presence(word: bytes) -> int:
    """The feature of a word's presence, whatever marks surround it."""
    return linear.BUCKETS + linear.bucket(b"p", word.lower().strip(b".,;:!?()[]\"'"))


_FEATURES = words.Cache(word_features)
_PRESENCE = words.Cache(presence)
_REPEAT = linear.bucket(b"repeat", b"")


def repeats(tokens: list[bytes]) -> int:
    return sum(map(bytes.__eq__, tokens[1:], tokens))


def text_features(text: str) -> dict[int, float]:
    found: dict[int, float] = {}
    tokens = text.encode().split()
    for token in tokens:
        for k, x in _FEATURES[token]:
            found[k] = found.get(k, 0.0) + x / len(tokens)
    if tokens:
        found[_REPEAT] = found.get(_REPEAT, 0.0) + repeats(tokens) / len(tokens)
    return found | dict.fromkeys(map(_PRESENCE.__getitem__, tokens), 1.0)


@dataclass
class Model:
    weight: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1) and P(grade >= 2) of each score."""
        return 1 - linear.sigmoid(self.thresholds[None, :] - score[:, None])


def rating() -> Column:
    """The grade of a row of labels."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def telling(train: linear.Rows) -> np.ndarray:
    """Which features may have a weight: all shares, and the presence of words that tell grade 1 from grade 2."""
    y = train.label.astype(float)
    upper = y > 0
    of = (train.index >= linear.BUCKETS) & upper[train.row]
    docs = np.bincount(train.index[of], minlength=WIDTH)
    grades = np.bincount(train.index[of], y[train.row[of]], minlength=WIDTH)
    spread = y[upper].std() if upper.any() else 0.0
    off = np.abs(grades / np.maximum(docs, 1) - (y[upper].mean() if upper.any() else 0.0)) * np.sqrt(docs)
    may = (docs >= MIN_DOCS) & (off >= MIN_ERRORS * spread) & (spread > 0)
    may[: linear.BUCKETS] = True
    return may


def fit(docs: DataFrame, labels: DataFrame, rows: int = linear.MAX_ROWS) -> Model:
    train, _ = linear.training_rows(docs, linear.sampled_labels(labels, rating(), rows), text_features, WIDTH)
    if len(set(train.label)) < 2:
        return Model(np.zeros(WIDTH), np.array([-30.0, -30.0]))
    y, n, may = train.label, len(train.label), telling(train)
    penalty = np.where(np.arange(WIDTH) < linear.BUCKETS, 1e-6, PENALTY)

    def gradient(x: np.ndarray) -> np.ndarray:
        first, gap = x[-2], np.exp(x[-1])
        score = train.times(x[:-2])
        edges = np.array([-np.inf, first, first + gap, np.inf])
        with np.errstate(over="ignore"):
            above, below = linear.sigmoid(edges[y + 1] - score), linear.sigmoid(edges[y] - score)
        p = np.maximum(above - below, 1e-12)
        d_score = (1 - above - below) / n
        d_above, d_below = -above * (1 - above) / p / n, below * (1 - below) / p / n
        d1 = d_above[y == 0].sum() + d_below[y == 1].sum()
        d2 = d_above[y == 1].sum() + d_below[y == 2].sum()
        return np.concatenate([may * train.transposed(d_score) + penalty * x[:-2], [d1 + d2, d2 * gap]])

    start = np.zeros(WIDTH + 2)
    start[-2] = -1.0
    x = linear.descend(gradient, start, 250)
    return Model(x[:-2], np.array([x[-2], x[-2] + np.exp(x[-1])]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), expected_grade, p_acceptable, p_clean and is_kept."""
    names = ["row", "expected_grade", "p_acceptable", "p_clean", "is_kept"]
    at = docs.columns.index("text")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked: dict[bytes, int] = {}  # the few words seen whose presence has a weight

        def of_word(word: bytes) -> float:
            if model.weight[k := presence(word)]:
                marked[word] = k
            return sum(model.weight[k] * x for k, x in word_features(word))

        part = words.Cache(of_word)
        for batch in batches:
            if len(marked) >= words.CACHE_WORDS:
                marked.clear()
                part.clear()
            total, any_word = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=bool)
            for i, text in enumerate(batch.column(0).field(at)):
                tokens = (text.as_py() or "").encode().split()
                if tokens:
                    any_word[i] = True
                    total[i] = (sum(map(part.__getitem__, tokens)) + model.weight[_REPEAT] * repeats(tokens)) / len(tokens)
                    total[i] += sum(model.weight[k] for k in sorted({marked[t] for t in marked.keys() & set(tokens)}))
            tails = np.where(any_word[:, None], model.tails(total), 0.0)
            new = [pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(any_word & (tails[:, 1] >= KEEP))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=names)

    packed = docs.select(F.struct(*docs.columns).alias("row"))
    schema = StructType().add("row", packed.schema["row"].dataType)
    for name in names[1:4]:
        schema = schema.add(name, "double")
    return packed.mapInArrow(score, schema.add("is_kept", "boolean"))


def acceptable(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with their own columns."""
    return scored(docs, model).where("is_kept").select("row.*")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("row.doc_id", "expected_grade", "p_acceptable", "p_clean", F.col("is_kept").alias("kept"))

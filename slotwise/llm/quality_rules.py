"""Quality rules: counted signals of a text and a trained verdict on it.

The counted signals reject texts that are short or repeat themselves. What passes is judged by a
logistic regression on hashed words and the character trigrams inside them, trained on the labelled
quality rows, its probability calibrated on held-out rows (a logistic curve over the score) and held
against a fixed threshold. All of it is computed in one pass over Arrow batches of whole texts.

Defined results: a null text has no words (``base_failed``); a null doc_id is scored like any other;
repeated rows are scored each. Without labels of both kinds, every text that passes the counts is
kept. Texts are read whole, however long; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear, words

THRESHOLD = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"


def word_features(word: bytes) -> list[tuple[int, float]]:
    """The word, and its character trigrams with marks at both ends, which share one unit."""
    text = f"^{word.decode()}$"
    grams = {text[i : i + 3] for i in range(len(text) - 2)} or {text}
    share = 1 / len(grams)
    return [(linear.bucket(b"w", word), 1.0), *((linear.bucket(b"g", g.encode()), share) for g in grams)]


def text_features(text: str) -> dict[int, float]:
    """Hashed features of a whole text, per word of it."""
    found: dict[int, float] = {}
    tokens = text.encode().split()
    for token in tokens:
        for k, x in _FEATURES[token]:
            found[k] = found.get(k, 0.0) + x / len(tokens)
    return found


_FEATURES = words.Cache(word_features)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def scorer(self) -> words.Cache:
        """word -> its part of the score."""
        return words.Cache(lambda word: sum(self.weight[k] * x for k, x in word_features(word)))

    def probability(self, score: np.ndarray) -> np.ndarray:
        return linear.sigmoid(self.slope * (score + self.bias) + self.shift)


def fit(docs: DataFrame, labels: DataFrame, rows: int = linear.MAX_ROWS) -> Model:
    sample = linear.sampled_labels(labels, F.col("quality"), rows)
    train, held = linear.training_rows(docs, sample, text_features)
    if len(set(train.label)) < 2:
        return Model(np.zeros(linear.BUCKETS), 0.0, 0.0, 30.0)
    y = (train.label > 0).astype(float)

    def gradient(x: np.ndarray) -> np.ndarray:
        g = (linear.sigmoid(train.times(x[:-1]) + x[-1]) - y) / len(y)
        return np.append(train.transposed(g) + 1e-6 * x[:-1], g.sum())

    x = linear.descend(gradient, np.zeros(linear.BUCKETS + 1))
    model = Model(x[:-1], float(x[-1]), 1.0, 0.0)
    if len(set(held.label)) == 2:  # calibration by Platt's smoothed targets
        score, good = held.times(model.weight) + model.bias, held.label > 0
        target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))

        def slope(ab: np.ndarray) -> np.ndarray:
            g = (linear.sigmoid(ab[0] * score + ab[1]) - target) / len(target)
            return np.array([g @ score, g.sum()])

        model.slope, model.shift = map(float, linear.descend(slope, np.array([1.0, 0.0]), 400, 0.05))
    return model


def repeated_words(word_hash: np.ndarray, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    if len(word_hash) <= size:
        return 0
    window = words.windows(word_hash, size)
    ordered = np.sort(window)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.isin(window, ordered[1:][same])
    change = np.zeros(len(word_hash) + 1, dtype=np.int64)
    change[:-size] += twice
    change[size:] -= twice
    return int((np.cumsum(change) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        n += line in seen and bool(line.strip())
        seen.add(line)
    return n


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counted signals, the calibrated probability and the verdict of each row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = model.scorer()
        for batch in batches:
            counts, total = np.zeros((batch.num_rows, 5), dtype=np.int64), np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode()
                tokens = data.split()
                if tokens:
                    symbols = len(data) - len(data.translate(None, SYMBOLS))
                    repeats = repeated_words(words.hashes(tokens))
                    counts[i] = len(tokens), len(b"".join(tokens).decode()), symbols, duplicate_lines(data), repeats
                    total[i] = sum(map(part.__getitem__, tokens)) / len(tokens)
            probability = model.probability(total)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            columns = [batch.column(0), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(probability), pa.array(~failed & (probability >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "probability", "kept"])

    schema = "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, probability double, kept boolean"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(score, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_rule_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted columns of ``op5_quality_rules``, which SQL can express."""
    return op5_quality_rules(spark, sf_dir).drop("probability", "kept")


SIGNALS_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS w FROM documents),
windows AS (
  SELECT rid, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM w),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
repeated AS (SELECT rid, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest(range(0, 8)) AS d) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w),
doubled AS (SELECT rid, sum(n - 1) AS n FROM (SELECT rid, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY rid, line) GROUP BY rid),
counted AS (
  SELECT rid, doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
       n_words < 20 OR 100 * coalesce(r.n, 0) > 30 * n_words AS base_failed
FROM counted LEFT JOIN doubled d USING (rid) LEFT JOIN repeated r USING (rid)
"""

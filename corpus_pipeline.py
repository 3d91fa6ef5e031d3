"""A corpus made ready for training in five stages, each an operator of ``slotwise.llm``.

Poor and toxic documents go, lines that many documents share are cut, one document of each group of near copies
stays, sources are mixed to their target weights (documents go or repeat), and what is left is packed.
A stage gets what its predecessor kept, as a Parquet table with the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotwise.llm import line_dedup, mixing, ngram_jaccard, packing, quality_classifier
from slotwise.llm.staging import staged

NEAR_COPY = ngram_jaccard.Scheme(size=5, percent=80)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is probably acceptable and not toxic; the model is fitted on the labels of sf_dir."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.acceptable(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Documents without the long lines that they share with many others; emptied ones go."""
    return line_dedup.drop_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return ngram_jaccard.one_of_each(docs, NEAR_COPY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Documents repeated or left out so that each source comes near its target."""
    return mixing.resampled(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """The pieces of all documents with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_documents),
]

#: A trained model, random rounding and packing have no SQL form; tests hold the stages against brute force and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"after-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

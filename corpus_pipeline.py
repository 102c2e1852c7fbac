"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard_join, language_id, mixing, packing, quality_classifier
from graphloom.storage import materialize

#: Least posterior of the best language.
MIN_LANGUAGE_SCORE = 0.5


_USED = ("doc_id", "text", "lang", "source")


def apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns that no operator needs under names of their own, so that none clashes
    with an operator's results, and the way back to the columns as they were."""
    name = {c: c if c in _USED else f"_kept_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(name[c]) for c in docs.columns]), lambda df: df.select(*[F.col(name[c]).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or whose language stays open, go."""
    rows, back = apart(docs)
    found = language_id.identify(rows, language_id.train(rows))
    return back(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, back = apart(docs)
    return back(quality_classifier.classify(rows, labels).where("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    rows, back = apart(docs)
    return back(jaccard_join.first_of_each(rows))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows, back = apart(docs)
    return back(mixing.repeat(mixing.mix(rows)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, the similarity join and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

"""From raw documents to packed training sequences, one written table after each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import jaccard_join, packing, pii, quality, toxicity
from folioscope.llm.common import documents, labels, lean_batches, unused
from folioscope.llm.queries import tokenizer
from folioscope.session import cut, ship_package

QUALITY_LEAST = 0.3
TOXIC_FROM = 0.5


def ready(spark: SparkSession) -> SparkSession:
    return lean_batches(ship_package(spark))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    weights = quality.fit(docs, labels(ready(spark), sf_dir))
    score = unused("score", docs.columns)
    return quality.score(docs, weights, score).where(F.col(score) >= QUALITY_LEAST).select(docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject."""
    grammar = toxicity.fit(docs, labels(ready(spark), sf_dir))
    score = unused("score", docs.columns)
    return toxicity.score(docs, grammar, score).where(F.col(score) < TOXIC_FROM).select(docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    ready(spark)
    return jaccard_join.keep_one(docs, words=5, percent=80)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; n_chars counts what is left."""
    ready(spark)
    masked = pii.masked(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    ready(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("personal data", personal_data_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again for the next one."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return docs

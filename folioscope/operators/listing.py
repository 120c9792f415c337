"""Projections for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X


def _optional(df: DataFrame, column: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast("string").alias(column)


def paper_listing(papers: DataFrame) -> DataFrame:
    """One short row per paper with its place in the layout."""
    return papers.select(
        "arxiv_id",
        X.shorten("title", X.TITLE_CHARS).alias("title"),
        "primary_subject",
        _optional(papers, "submission_date"),
        _optional(papers, "year_month"),
        F.round("x", 4).alias("x"),
        F.round("y", 4).alias("y"),
    )


def search_hit_projection(hits: DataFrame) -> DataFrame:
    """What a search answer shows of each hit."""
    return hits.select(
        "arxiv_id",
        "title",
        F.slice("authors", 1, X.AUTHORS_SHOWN).alias("authors"),
        "submission_date",
        _optional(hits, "year_month"),
        "primary_subject",
        X.shorten("abstract", X.ABSTRACT_CHARS).alias("abstract"),
        F.round("similarity", 4).alias("score"),
        F.round("x", 4).alias("x"),
        F.round("y", 4).alias("y"),
    )


def papers_with_topics(papers: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each paper with its dominant topic and the label to group it by.

    The label is the topic where there is one, else the subject.
    """
    topic = assignments.select("arxiv_id", "dominant_topic")
    joined = papers.join(topic, "arxiv_id", "left")
    name = F.concat(F.lit("Topic "), (F.col("dominant_topic") + 1).cast("string"))
    return joined.withColumn("label", F.coalesce(name, "primary_subject"))


def categories_with_names(codes: DataFrame, names: DataFrame) -> DataFrame:
    """Codes with their readable names; an unknown code keeps itself as name."""
    joined = codes.select("code").distinct().join(names, "code", "left")
    return joined.select("code", F.coalesce("name", "code").alias("name"))

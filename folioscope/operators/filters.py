"""Row filters. An empty or missing list means no filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import calendar as C


def filter_year_months(df: DataFrame, year_months: Sequence[str] | None) -> DataFrame:
    return df.where(F.col("year_month").isin(list(year_months))) if year_months else df


def filter_categories(
    df: DataFrame, categories: Sequence[str] | None, by: str = "primary_subject"
) -> DataFrame:
    return df.where(F.col(by).isin(list(categories))) if categories else df


def filter_papers(
    df: DataFrame,
    year_months: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    by: str = "primary_subject",
) -> DataFrame:
    return filter_categories(filter_year_months(df, year_months), categories, by)


def valid_embeddings(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows that have a vector; none when there is no such column."""
    return df.where(F.col(column).isNotNull()) if column in df.columns else df.where(F.lit(False))


def restrict_to_hits(papers: DataFrame, hits: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Papers among the search hits; all papers when the search found nothing."""
    if hits.isEmpty():
        return papers
    return papers.join(hits.select(key), key, "left_semi")


def filter_topic(
    papers: DataFrame, assignments: DataFrame, topic: int, key: str = "arxiv_id"
) -> DataFrame:
    """Papers whose dominant topic is ``topic``."""
    chosen = assignments.where(F.col("dominant_topic") == topic).select(key)
    return papers.join(chosen, key, "left_semi")


def drop_future_months(df: DataFrame, now: str) -> DataFrame:
    """Rows whose month is not after ``now`` (``YYYY-MM``)."""
    return df.where(C.not_after(now))


def last_n_months(df: DataFrame, now: str, n: int = 12) -> DataFrame:
    """Rows of the ``n`` months that end with ``now``."""
    return df.where(C.not_before(C.months_back(now, n - 1)) & C.not_after(now))

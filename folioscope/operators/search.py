"""Filtered nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import vectors as V
from folioscope.operators.arrays import cosine_to
from folioscope.operators.embedding import Embedder, embed_query
from folioscope.operators.filters import filter_papers, valid_embeddings
from folioscope.operators.listing import search_hit_projection

# Fixed values of the search interface.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
DEFAULT_K = 200
MAX_K = 1000


def similarity(query: Sequence[float] | Column, column: str = "embedding") -> Column:
    """Cosine similarity of a vector column without nulls to a query vector."""
    if isinstance(query, Column):
        return V.cosine_similarity(column, query)
    return cosine_to(query, column)


def top_k(
    papers: DataFrame, query: Sequence[float] | Column, k: int = DEFAULT_K, key: str = "arxiv_id"
) -> DataFrame:
    """The ``k`` papers most similar to a query vector, as ``similarity``; ties by key."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")
    scored = valid_embeddings(papers).withColumn("similarity", similarity(query))
    return scored.orderBy(F.desc_nulls_last("similarity"), F.col(key)).limit(k)


def search(
    papers: DataFrame,
    query: Sequence[float] | Column,
    k: int = DEFAULT_K,
    year_months: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """Filter, score, keep the best ``k`` and shape them for display."""
    chosen = filter_papers(papers, year_months, categories)
    return search_hit_projection(top_k(chosen, query, k))


def search_text(
    papers: DataFrame,
    text: str,
    embedder: Embedder,
    k: int = DEFAULT_K,
    year_months: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """Search for a non-empty text, embedded with the model of the corpus."""
    if not text:
        raise ValueError("the query is empty")
    vector = embed_query(QUERY_PREFIX + text, embedder)
    return search(papers, vector, k, year_months, categories)

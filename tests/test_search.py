import numpy as np
import pandas as pd
import pytest

from folioscope.operators.neighbours import search_batch
from folioscope.operators.filters import restrict_to_hits
from folioscope.operators import filters, search
from folioscope.operators.embedding import HashedWords
from folioscope.registry import base as B


@pytest.fixture(scope="module")
def papers(spark):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((400, 12)).astype(np.float32)
    vectors[100:300] = vectors[7]  # many copies of one vector
    vectors[50] = 0
    rows = pd.DataFrame({"arxiv_id": [f"p{i:03d}" for i in range(400)], "embedding": [v.tolist() for v in vectors]})
    return spark.createDataFrame(rows, "arxiv_id string, embedding array<float>").repartition(7).cache()


def brute(papers, query, k):
    rows = sorted((r["arxiv_id"], np.array(r["embedding"], dtype=float)) for r in papers.collect())
    scored = []
    for name, x in rows:
        length = np.sqrt((x * x).sum())
        scored.append((-np.inf if length == 0 else (x * query).sum() / length, name))
    return [name for _, name in sorted(scored, key=lambda s: (-s[0], s[1]))][:k]


@pytest.mark.parametrize("k", [1, 50, 399, 1000])
def test_top_k_with_copies_and_zero_vector(papers, k):
    query = np.random.default_rng(1).standard_normal(12)
    rows = search.top_k(papers, query.tolist(), k).collect()
    assert [r["arxiv_id"] for r in rows] == brute(papers, query / np.linalg.norm(query), min(k, 400))


def test_array_functions_and_arrow_agree(papers):
    query = np.random.default_rng(2).standard_normal(12).tolist()
    from folioscope.functions.vectors import vector

    one = search.top_k(papers, query, 400).collect()
    two = search.top_k(papers, vector(query), 400).collect()
    ones = {r["arxiv_id"]: r["similarity"] for r in one}
    for r in two:
        assert ones[r["arxiv_id"]] == pytest.approx(r["similarity"], abs=1e-9) or r["similarity"] is None


@pytest.mark.parametrize("k", [0, 1001])
def test_k_out_of_range(papers, k):
    with pytest.raises(ValueError, match="between 1 and 1000"):
        search.top_k(papers, [1.0] * 12, k)


def test_empty_text_and_empty_filter(spark, small):
    rows = B.current(spark, small)
    with pytest.raises(ValueError, match="empty"):
        search.search_text(rows, "", HashedWords())
    assert search.search_text(rows, "words", HashedWords(), year_months=["1999-01"]).count() == 0


def test_filters(spark, small):
    rows = B.current(spark, small, vectors=False)
    total = rows.count()
    assert filters.filter_papers(rows).count() == total
    assert filters.filter_papers(rows, [], []).count() == total
    keyed = B.keyed(spark, small)
    assert filters.filter_categories(keyed, ["cs.AI"]).count() == 0
    by_code = filters.filter_categories(keyed, ["cs.AI"], by="subject").count()
    by_name = filters.filter_categories(keyed, ["Artificial Intelligence (cs.AI)"]).count()
    assert by_code == by_name > 0
    assert filters.valid_embeddings(keyed).count() == 0  # no such column


def test_batch_search_gives_zero_vectors_no_similarity(spark):
    papers = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [-1.0, 0.0])], "arxiv_id string, embedding array<float>"
    )
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    rows = search_batch(asked, papers, 3).orderBy("rank").collect()
    assert [(r["arxiv_id"], r["similarity"]) for r in rows] == [("a", 1.0), ("c", -1.0), ("b", None)]
    assert [r["arxiv_id"] for r in search.top_k(papers, [1.0, 0.0], 3).collect()] == ["a", "c", "b"]


def test_no_hits_mean_no_filter(spark):
    papers = spark.createDataFrame([("a",), ("b",)], "arxiv_id string")
    assert restrict_to_hits(papers, papers.where("false")).count() == 2
    assert restrict_to_hits(papers, papers.where("arxiv_id = 'a'")).count() == 1

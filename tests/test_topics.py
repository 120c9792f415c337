import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import topics as T
from folioscope.session import new_path


@pytest.fixture(scope="module")
def mixture():
    """Three skewed independent sources, mixed into eight dimensions."""
    rng = np.random.default_rng(0)
    sources = rng.exponential(1.0, (2000, 3)) - 1.0
    mixing = rng.standard_normal((3, 8))
    return sources, sources @ mixing + 0.01 * rng.standard_normal((2000, 8))


@pytest.fixture(scope="module")
def papers(spark, mixture):
    sources, vectors = mixture
    strongest = sources.argmax(axis=1)
    rows = pd.DataFrame(
        {
            "arxiv_id": [f"p{i:04d}" for i in range(len(vectors))],
            "title": [f"paper on topic{s}" for s in strongest],
            "abstract": ["common words in every text"] * len(vectors),
            "embedding": [v.tolist() for v in vectors],
        }
    )
    schema = "arxiv_id string, title string, abstract string, embedding array<float>"
    nothing = spark.createDataFrame([("none", "t", "a", None)], schema)
    return spark.createDataFrame(rows, schema).union(nothing).cache()


@pytest.fixture(scope="module")
def weighed(papers):
    return T.topic_weights(papers, T.fit(papers, 3)).cache()


def matrix(weighed):
    rows = weighed.orderBy("arxiv_id").select("topic_weights").collect()
    return np.array([r[0] for r in rows])


def test_finds_the_sources(weighed, mixture):
    found = matrix(weighed)
    match = np.corrcoef(mixture[0].T, found.T)[:3, 3:]
    assert np.abs(match).max(axis=1).min() > 0.95
    assert (match.max(axis=1) > 0.95).all()  # positive skew fixes the sign


def test_components_are_uncorrelated_with_unit_variance(weighed):
    assert np.cov(matrix(weighed).T, bias=True) == pytest.approx(np.eye(3), abs=1e-3)


def test_passes_over_all_rows_agree_with_the_sample_solution(papers, weighed, monkeypatch):
    monkeypatch.setattr(T, "WARM_ROWS", 200)
    again = matrix(T.topic_weights(papers, T.fit(papers, 3)))
    match = np.abs(np.corrcoef(matrix(weighed).T, again.T)[:3, 3:])
    assert match.max(axis=1).min() > 0.999


def test_too_few_rows(spark, papers):
    with pytest.raises(ValueError, match="take at least"):
        T.fit(papers.where("arxiv_id < 'p0003'"), 3)
    with pytest.raises(ValueError, match="take at least"):
        T.fit(papers.where("arxiv_id = 'none'"), 1)
    with pytest.raises(ValueError, match="at least 1"):
        T.fit(papers, 0)


def test_terms_and_counts(papers):
    terms, assignments, record = T.extract_topics(papers, 3)
    rows = terms.collect()
    assert sorted((r["topic_id"], r["rank"]) for r in rows)[0] == (0, 1)
    tops = {r["topic_id"]: r["term"] for r in rows if r["rank"] == 1}
    assert sorted(tops.values()) == ["topic0", "topic1", "topic2"]
    counts = {r["topic_id"]: r["doc_count"] for r in rows}
    assert sum(counts.values()) == assignments.count() == 2000


def test_rare_terms_are_left_out(weighed):
    weights = T.term_weights(weighed, 3, min_documents=2001)
    assert weights.count() == 0


def test_save_and_load(spark, weighed):
    root = new_path(spark, "saved-topics")
    assert T.load_topics(spark, root, "k") is None
    stored = T.TopicResult(T.topic_terms(weighed, 3), T.assign_topics(weighed), weighed.groupBy().count())
    T.save_topics(stored, root, "k")
    terms, assignments, record = T.load_topics(spark, root, "k")
    assert record.first()[0] == weighed.count()
    assert assignments.count() == 2000
    assert terms.where(F.col("rank") == 1).count() == 3


def test_rank_of_the_vectors_is_named(spark):
    rows = [(f"p{i}", [float(i % 7), 2.0 * (i % 7), float(i % 3)]) for i in range(60)]
    flat = spark.createDataFrame(rows, "arxiv_id string, embedding array<float>")
    with pytest.raises(ValueError, match="2 directions only"):
        T.fit(flat, 3)


def test_topics_without_terms_keep_their_count(spark, papers):
    weighed = T.topic_weights(papers, T.fit(papers, 3))
    texts = weighed.withColumns({"title": F.lit("a"), "abstract": F.lit("b")})
    rows = T.topic_terms(texts, 3, min_documents=10**6).collect()
    assert sorted(r["topic_id"] for r in rows) == [0, 1, 2] and all(r["term"] is None for r in rows)
    assert sum(r["doc_count"] for r in rows) == weighed.count()


def test_a_later_call_goes_on_where_the_last_one_stopped(spark, papers):
    state = new_path(spark, "passes")
    options = {"tolerance": 1e-12, "table_passes": 2, "max_passes": 1, "state": state}
    first, second = T.fit(papers, 3, **options), T.fit(papers, 3, **options)
    assert (first.passes, second.passes) == (2, 4) and second.change < first.change and not first.converged
    done = T.fit_to_rest(papers, 3, state, table_passes=2, max_passes=1)
    assert done.converged and done.passes >= 4
    # Other vectors do not go on from there.
    other = T.fit(papers.where("arxiv_id < 'p1000'"), 3, table_passes=1, state=state)
    assert other.passes <= 1


def test_topics_that_do_not_rest_are_an_error(spark, papers):
    with pytest.raises(T.NotAtRest):
        T.fit_to_rest(papers, 3, new_path(spark, "passes"), calls=2, table_passes=1, max_passes=1, tolerance=1e-15)


def test_sources_close_to_normal_come_to_rest(spark):
    noise = np.random.default_rng(4).standard_normal((1500, 6))
    rows = spark.createDataFrame([(f"p{i:04d}", v.tolist()) for i, v in enumerate(noise)], "arxiv_id string, embedding array<double>")
    found = T.fit_to_rest(rows, 6, new_path(spark, "passes"), calls=3, max_passes=1)
    assert found.converged and T.STEP_PASSES < found.passes <= 30
    y = (noise - found.mean) @ found.unmixing.T
    assert np.cov(y.T, bias=True) == pytest.approx(np.eye(6), abs=1e-6)
    g = np.tanh(y)
    pulls = (g.T @ y) / len(y)
    sign = np.sign(np.diag(pulls) - (1 - g * g).mean(axis=0))
    assert np.abs(sign[:, None] * pulls - (sign[:, None] * pulls).T).max() < 1e-3  # at rest under rotations


def test_record_of_a_result(papers):
    record = T.extract_topics(papers, 3, key="asked").record.first()
    assert (record["cache_key"], record["n_components"], record["converged"]) == ("asked", 3, True)
    assert (record["paper_count"], record["valid_embedding_count"]) == (2001, 2000)


def test_terms_by_the_vectors_of_the_model(spark, papers):
    from folioscope.operators.embedding import HashedWords

    def model(texts):
        vectors = HashedWords(8)(texts)
        return vectors

    components = T.fit(papers, 3)
    weighed = T.topic_weights(papers, components)
    found = {(r["topic_id"], r["term"]): r["weight"] for r in T.model_term_weights(weighed, components, model).collect()}
    terms = sorted({t for _, t in found})
    want = (HashedWords(8)(pd.Series(terms)) - components.mean) @ components.unmixing.T
    for j, term in enumerate(terms):
        assert [found[i, term] for i in range(3)] == pytest.approx(want[j].tolist(), abs=2e-6)
    listed = T.topic_terms(weighed, 3, 4, model=(components, model))
    assert listed.groupBy("topic_id").count().where("count = 4").count() == 3

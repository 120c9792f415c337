import pytest

from folioscope.operators.embedding import HashedWords
from folioscope.plans.explorer import Explorer
from folioscope.registry import base as B
from folioscope.session import new_path
from folioscope.sources import corpus

CATEGORIES = ["cs.AI", "cs.LG", "gr-qc"]
MONTHS = [("2023", f"{m:02d}") for m in range(1, 13)]


@pytest.fixture(scope="module")
def explorer(spark, small):
    root = new_path(spark, "explorer")
    corpus.write_partitioned(B.keyed(spark, small), f"{root}/upstream")
    return Explorer(spark, root, HashedWords(), "2024-06")


def chosen(spark, small):
    rows = B.keyed(spark, small)
    return corpus.scan_selection(rows, CATEGORIES, MONTHS).dropDuplicates(["arxiv_id"])


def test_nothing_published_yet(explorer):
    assert explorer.search("anything").count() == 0
    assert explorer.papers().count() == 0
    with pytest.raises(LookupError):
        explorer.stats()
    with pytest.raises(ValueError, match="selected"):
        explorer.embed([], MONTHS)


def test_before_landing(explorer):
    total = explorer.estimate(CATEGORIES, MONTHS).where("level = 3").first()
    assert total["exact_cells"] == 0 and total["total"] == total["total_estimated"] > 0
    assert explorer.cache_summary().isEmpty()
    states = {r["subject"]: r for r in explorer.categories(MONTHS).collect()}
    assert not any(r["embedded"] or r["downloaded"] for r in states.values())
    assert states["cs.AI"]["name"] == "cs.AI"


def test_embed_publishes_the_selection(spark, small, explorer):
    totals = explorer.embed(CATEGORIES, MONTHS).first()
    n = chosen(spark, small).count()
    assert (totals["tasks"], totals["skipped"]) == (36, 0)
    assert totals["papers_embedded"] == totals["papers_total"] == n
    assert explorer.dataset().count() == n
    again = explorer.embed(CATEGORIES, MONTHS).first()
    assert again["papers_embedded"] == 0 and again["papers_total"] == n


def test_catalog_after_embedding(spark, small, explorer):
    n = chosen(spark, small).count()
    total = explorer.estimate(CATEGORIES, MONTHS).where("level = 3").first()
    assert total["total_exact"] == n and total["total_estimated"] == 0
    assert explorer.cache_summary().where("level = 3").first()["papers"] == n
    states = {r["subject"]: r for r in explorer.categories(MONTHS).collect()}
    assert sum(states[c]["n_embedded"] for c in CATEGORIES) == n
    years = {r["year"]: (r["available_upstream"], r["landed"]) for r in explorer.available_years().collect()}
    assert years == {"2023": (True, True), "2024": (True, False)}
    assert explorer.available_months("2023").where("landed").count() >= 10
    assert explorer.months("2023").count() == 12 and explorer.months().count() == 6
    assert explorer.land(CATEGORIES, MONTHS).count() == 0


def test_views_of_the_dataset(explorer):
    n = explorer.dataset().count()
    totals, subjects, months = explorer.stats()
    assert totals.first()["total_papers"] == n
    assert sum(r["n_papers"] for r in subjects.collect()) == n
    assert explorer.papers().count() == n
    month = months.first()
    assert explorer.papers([month["year_month"]]).count() == month["n_papers"]
    hits = explorer.search("data model", 5)
    assert hits.count() == 5
    assert explorer.topics_status().first()["paper_count"] == n


def test_topics_are_stored(spark, explorer):
    terms, assignments, record = explorer.extract_topics(3, min_documents=2)
    assert record.first()["converged"]
    assert {r["topic_id"] for r in terms.collect()} == {0, 1, 2}
    valid = explorer.topics_status().first()["valid_embedding_count"]
    assert assignments.count() == valid
    files = sorted(assignments.inputFiles())
    assert sorted(explorer.extract_topics(3, min_documents=2)[1].inputFiles()) == files
    with pytest.raises(ValueError, match="need"):
        explorer.extract_topics(5000)

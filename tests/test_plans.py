"""What the physical plans must show."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import catalog, neighbours, prepare, search, stats, topics
from folioscope.registry import base as B
from folioscope.sources import corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def landed(spark, small):
    return corpus.read_corpus(spark, B.landed_path(spark, small))


def test_scans_prune_partitions(landed):
    frames = [
        corpus.scan_subject_month(landed, "cs.AI", "2023", "03"),
        corpus.scan_subjects_month(landed, ["cs.AI", "gr-qc"], "2023", "03"),
        corpus.scan_subject_year(landed, "cs.AI", "2023", ["03"]),
        corpus.scan_selection(landed, ["cs.AI"], [("2023", "03"), ("2024", "01")]),
    ]
    for df in frames:
        text = plan(df)
        assert "PartitionFilters: [isnotnull" in text or "PartitionFilters: [subject" in text
        assert "DataFilters: []" in text


def test_selected_partitions_prune_dynamically(landed):
    chosen = catalog.partition_counts(landed).where("n_rows > 2")
    assert "dynamicpruning" in plan(corpus.scan_partitions(landed, chosen))


def test_counts_read_no_column(landed):
    assert "ReadSchema: struct<>" in plan(catalog.partition_counts(landed))


def test_search_keeps_k_rows_per_task(spark, small):
    text = plan(search.top_k(B.current(spark, small), B.query_vector(spark, small), 10))
    assert "TakeOrderedAndProject" in text and "Window" not in text
    assert "Sort [" not in text and "Sort(" not in text


def test_top_subjects_keep_n_rows_per_task(spark, small):
    assert "TakeOrderedAndProject" in plan(stats.top_subjects(B.current(spark, small, vectors=False)))


def test_dedupe_prunes_before_the_shuffle(spark, small):
    text = plan(prepare.dedupe(B.crosslisted(spark, small)))
    assert text.count("WindowGroupLimit") == 2


def test_copies_are_pruned_before_the_shuffle(spark, small):
    rows = B.current(spark, small).select("arxiv_id", "embedding")
    assert plan(neighbours.distinct_vectors(rows, 16, "arxiv_id")).count("WindowGroupLimit") == 2


def test_top_terms_prune_before_the_shuffle(spark, small):
    text = plan(topics.top_terms(topics.term_weights(B.weighed(spark, small), 5)))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("vectors", [False, True])
def test_derivations_use_no_python(spark, small, vectors):
    df = prepare.paper_projection(B.keyed(spark, small, vectors))
    assert "Python" not in plan(corpus.with_year_month(df))


def test_listing_reads_no_vectors(spark, small):
    assert "embedding" not in plan(B.current(spark, small, vectors=False))


def test_facets_take_one_pass(spark, small):
    text = plan(stats.facet_counts(B.current(spark, small, vectors=False)))
    assert text.count("FileScan") == 1 and "Expand" in text


def test_filters_reach_the_scan(landed):
    text = plan(landed.where(F.col("primary_subject").isin("a", "b")).select("arxiv_id"))
    assert "PushedFilters: [In(primary_subject" in text
    assert "abstract" not in text.split("ReadSchema")[1]

"""Every query next to its SQL twin on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import oracle, rows_of

# Names on the left of the inventory; each must be registered.
INVENTORY = """
scan_subject_month scan_subjects_month scan_subject_year scan_selection load_month_all_subjects
scan_raw_corpus write_partitioned_corpus write_embeddings publish_current_dataset land_partitions
load_subject_codes save_topics partition_manifest sample_rows
subject_code partition_year_month year_month ensure_year_month subject_codes embed_text
paper_projection paper_listing search_hit_projection subject_group selection_hash status_label
filter_year_months filter_categories drop_unkeyed valid_embeddings restrict_to_hits filter_topic
drop_future_months last_n_months
request_grid grid_status embedding_work_plan papers_with_topics categories_with_names availability
knn_graph search_batch
stats_top_subjects stats_year_month stats_totals partition_counts landed_listing cache_summary
selection_counts category_status topic_doc_counts topics_status facet_counts year_facets
subject_group_rollup layout_extent monthly_status load_summary embed_run_totals
search_topk top_categories_breakdown top_terms
dedupe_by_id union_partitions union_years union_months missing_partitions
embed_texts semantic_search cosine_similarity layout_2d topic_weights topic_terms dominant_topic
assign_topics combine_and_layout
estimate_rows estimate_cost layout_cache_valid topics_cache_valid incremental_embed partition_flags
default_run
stream_land stream_embed stream_dedupe stream_stats
""".split()


@pytest.fixture(scope="module")
def con(small):
    return oracle(small)


def test_inventory_is_registered():
    assert set(INVENTORY) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, small, name):
    df = queries()[name](spark, small)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracle_sql():
        assert got
        return
    result = con.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry(spark).columns[:2] == ["arxiv_id", "title"]

import json
import hashlib

import pytest
from pyspark.sql import functions as F

from folioscope.operators import catalog, reuse, stats
from folioscope.schemas import MANIFEST

NOW = "2024-06"


@pytest.fixture(scope="module")
def manifest(spark):
    return spark.createDataFrame(
        [
            ("cs.AI", "2024", "05", 42, 25000, True, True, 100),
            ("cs.AI", "2024", "06", 7, 4000, True, True, 200),
            ("cs.LG", "2024", "05", 9, 5000, True, False, None),
            ("gr-qc", "2024", "05", 0, 601, False, False, None),
            ("gr-qc", "2024", "06", 0, 599, False, False, None),
        ],
        MANIFEST,
    )


@pytest.fixture(scope="module")
def status(manifest):
    grid = catalog.request_grid(manifest, [("2024", "05"), ("2024", "06")])
    return catalog.grid_status(grid, manifest)


def as_dict(df, key, *columns):
    return {tuple(r[k] for k in key): tuple(r[c] for c in columns) for r in df.collect()}


def test_work_plan(status):
    plan = as_dict(catalog.embedding_work_plan(status, NOW), ("subject", "month"), "action")
    assert plan == {
        ("cs.AI", "05"): ("skip",),
        ("cs.AI", "06"): ("embed",),
        ("cs.LG", "05"): ("embed",),
        ("cs.LG", "06"): ("fetch+embed",),
        ("gr-qc", "05"): ("fetch+embed",),
        ("gr-qc", "06"): ("fetch+embed",),
    }
    forced = catalog.embedding_work_plan(status, NOW, force=True)
    assert forced.where("action = 'skip'").count() == 0


def test_estimates(status):
    rows = as_dict(catalog.estimate_rows(status), ("subject", "month"), "paper_count", "is_exact")
    assert rows[("cs.AI", "05")] == (42, True)
    assert rows[("gr-qc", "05")] == (1, False)
    assert rows[("gr-qc", "06")] == (0, False)
    assert rows[("cs.LG", "06")] == (0, False)


def test_selection_counts(status):
    counts = as_dict(
        catalog.selection_counts(status), ("subject", "year_month"),
        "total_exact", "total_estimated", "exact_cells", "estimated_cells",
    )
    assert counts[("cs.AI", None)] == (49, 0, 2, 0)
    assert counts[(None, "2024-05")] == (51, 1, 2, 1)
    assert counts[(None, None)] == (58, 1, 3, 3)


def test_cost_of_the_calibration_corpus(spark):
    cost = catalog.estimate_cost(spark.createDataFrame([(17342,), (0,)], "total long"))
    big, none = cost.orderBy(F.desc("total")).collect()
    assert (big["gpu_minutes"], big["cpu_minutes"], big["layout_seconds"]) == (0.84, 3.0, 24)
    assert (none["gpu_minutes"], none["cpu_minutes"], none["layout_seconds"]) == (0.0, 0.0, 0)


def test_status_labels(status):
    per_category = catalog.category_status(status)
    labels = as_dict(catalog.status_label(per_category, 2), ("subject",), "label")
    assert labels == {("cs.AI",): ("49 embedded",), ("cs.LG",): ("1 mo cached",), ("gr-qc",): ("New",)}
    fewer = as_dict(catalog.status_label(per_category, 3), ("subject",), "label")
    assert fewer[("cs.AI",)] == ("2 mo",)


def test_month_lists_keep_request_order(manifest):
    grid = catalog.request_grid(manifest, [("2024", "06"), ("2024", "05")])
    row = catalog.category_status(catalog.grid_status(grid, manifest)).where("subject = 'cs.AI'").first()
    assert row["embedded_months"] == "2024-06,2024-05"


def test_default_months():
    assert catalog.default_months("2024-03") == [("2024", "01"), ("2024", "02"), ("2024", "03")]
    assert len(catalog.default_months("2024-03", "2022")) == 12


def test_layout_validity(spark, manifest):
    chosen = spark.createDataFrame(
        [
            ("older", "cs.AI", "2024", "05"),
            ("newer", "cs.AI", "2024", "05"),
            ("newer", "cs.AI", "2024", "06"),
            ("missing", "cs.AI", "2024", "05"),
            ("missing", "cs.LG", "2024", "06"),
            ("never", "cs.AI", "2024", "05"),
        ],
        "selection_id string, subject string, year string, month string",
    )
    layouts = spark.createDataFrame(
        [("older", 150), ("newer", 150), ("missing", 150)], "selection_id string, layout_at long"
    )
    valid = as_dict(reuse.layout_cache_valid(chosen, manifest, layouts), ("selection_id",), "is_valid")
    assert valid == {("older",): (True,), ("newer",): (False,), ("missing",): (False,), ("never",): (False,)}
    lax = reuse.layout_cache_valid(chosen, manifest, layouts, ignore_absent=True)
    assert as_dict(lax, ("selection_id",), "is_valid")[("missing",)] == (True,)


def test_keys_are_digests_of_canonical_json(spark):
    categories, months = ["cs.LG", 'odd "name", with comma'], ["2024-02", "2024-01"]
    df = spark.createDataFrame([(categories, months)], "c array<string>, m array<string>")
    found = df.select(
        reuse.selection_key(F.col("c"), F.col("m")),
        reuse.topics_key(F.lit(10), F.col("m"), F.lit(None).cast("array<string>")),
    ).first()

    def digest(obj):
        return hashlib.md5(json.dumps(obj, sort_keys=True).encode()).hexdigest()[:12]

    assert found[0] == digest({"categories": sorted(categories), "year_months": sorted(months)})
    assert found[1] == digest({"cat": None, "n": 10, "ym": sorted(months)})


@pytest.mark.parametrize(
    "valid,expected",
    [(2, (False, 2, 3)), (3, (True, 2, 3)), (450, (True, 449, 4)), (10000, (True, 9999, 15))],
)
def test_topics_status(spark, valid, expected):
    df = spark.range(valid).select(F.array(F.lit(1.0)).alias("embedding"))
    row = stats.topics_status(df.union(spark.sql("SELECT CAST(NULL AS array<double>)"))).first()
    assert (row["available"], row["max_topics"], row["suggested_topics"]) == expected
    assert row["paper_count"] == valid + 1


def test_fingerprint_tells_datasets_of_equal_size_apart(spark):
    one = reuse.dataset_fingerprint(spark.createDataFrame([("a",), ("b",)], "arxiv_id string"))
    two = reuse.dataset_fingerprint(spark.createDataFrame([("a",), ("c",)], "arxiv_id string"))
    again = reuse.dataset_fingerprint(spark.createDataFrame([("b",), ("a",)], "arxiv_id string"))
    assert one.first() == again.first() != two.first()

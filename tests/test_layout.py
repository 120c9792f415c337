import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import layout as L
from tests.measures import trustworthiness


def table(spark, vectors):
    rows = pd.DataFrame(
        {"arxiv_id": [f"p{i:04d}" for i in range(len(vectors))], "embedding": [v.tolist() for v in vectors]}
    )
    return spark.createDataFrame(rows, "arxiv_id string, embedding array<float>").cache()


@pytest.fixture(scope="module")
def papers(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((10, 16))
    return table(spark, centres[rng.integers(0, 10, 500)] + 0.2 * rng.standard_normal((500, 16)))


@pytest.fixture(scope="module")
def places(papers):
    return L.layout(papers).cache()


def test_one_finite_place_per_row(papers, places):
    assert sorted(r[0] for r in places.select("arxiv_id").collect()) == sorted(
        r[0] for r in papers.select("arxiv_id").collect()
    )
    assert places.where(F.isnan("x") | F.isnan("y") | (F.abs("x") > 1e4)).count() == 0


def test_keeps_neighbours_better_than_two_axes(papers, places):
    plane = L.layout(papers, "pca")
    assert trustworthiness(papers, places) > max(0.9, trustworthiness(papers, plane))


def test_same_seed_same_places(papers, places):
    again = L.layout(papers)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, places.collect()))


def test_rounds_over_several_blocks(papers):
    split = L.layout(papers, block_points=120)
    assert trustworthiness(papers, split) > 0.9


def test_hub_replicas(spark, papers, monkeypatch):
    monkeypatch.setattr(L, "HUB_EDGES", 10)
    split = L.layout(papers, block_points=120)
    assert split.count() == 500
    assert trustworthiness(papers, split) > 0.85


def test_copies_share_a_place(spark):
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.standard_normal((40, 5)), np.ones((20, 5))])
    places = L.layout(table(spark, vectors))
    assert places.count() == 60
    copies = places.where(F.substring("arxiv_id", 2, 4).cast("int") >= 40)
    assert copies.select("x", "y").distinct().count() == 1


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_very_few_rows(spark, n):
    vectors = np.random.default_rng(2).standard_normal((n, 4))
    df = table(spark, vectors) if n else spark.createDataFrame([], "arxiv_id string, embedding array<float>")
    for method in ("umap", "pca"):
        assert L.layout(df, method).count() == n


def test_plane_matches_singular_vectors(papers):
    x = np.array([r["embedding"] for r in papers.orderBy("arxiv_id").collect()], dtype=float)
    x -= x.mean(axis=0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    rows = L.layout(papers, "pca").orderBy("arxiv_id").toPandas()
    for name, axis in zip(("x", "y"), axes, strict=False):
        assert np.abs(rows[name].to_numpy()) == pytest.approx(np.abs(x @ axis), abs=1e-5)


def test_curve_constants():
    assert L.curve(0.1) == pytest.approx((1.577, 0.895), abs=2e-3)


def test_local_weights():
    distances = np.array([[1.0, 1.0, 2.0, 3.0], [0.5, 0.6, np.inf, np.inf]])
    weights = L.local_weights(distances, 4)
    assert weights[0, :2].tolist() == [1.0, 1.0]
    assert weights[0].sum() == pytest.approx(math.log2(4), abs=1e-3)
    assert weights[1, 2:].tolist() == [0.0, 0.0]


def test_fuzzy_graph_unites_both_directions(spark):
    near = spark.createDataFrame(
        [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 2.0), (2, 2, 0.0), (2, 1, 1.0), (2, 3, 1.5), (3, 3, 0.0), (3, 2, 1.5), (3, 1, 2.0)],
        "src long, dst long, distance double",
    )
    w = {(r["src"], r["dst"]): r["weight"] for r in L.fuzzy_graph(near, 3).collect()}
    assert len(w) == 6
    assert all(w[a, b] == pytest.approx(w[b, a]) for a, b in w)
    assert w[1, 2] == pytest.approx(1.0)
    assert all(0 < v <= 1 for v in w.values())


def test_steps_and_blocks_do_not_depend_on_a_size_switch(papers, monkeypatch):
    seen = []
    whole = L.optimise

    def spied(edges, start, blocks, n, *rest, **options):
        seen.append((n, blocks.select("block").distinct().count(), blocks.groupBy("block").count().agg(F.max("count")).first()[0]))
        return whole(edges, start, blocks, n, *rest, **options)

    monkeypatch.setattr(L, "optimise", spied)
    L.layout(papers)
    # Landmarks are one block of bounded size, all points are several.
    assert seen[0][:2] == (125, 1) and seen[1][0] == 500 and seen[1][1] >= 8 and seen[1][2] <= 63


def test_most_edges_stay_inside_blocks(papers):
    points = papers.select(F.xxhash64("arxiv_id").alias("id"), "embedding")
    blocks = L.with_leaves(points, 63, key="id").select("id", F.col("leaf")[0].alias("block"))
    edges = L.nearest_distinct(points.withColumnRenamed("id", "rep"), 500, 15)
    own = blocks.select(F.col("id").alias("src"), F.col("block").alias("a"))
    other = blocks.select(F.col("id").alias("dst"), F.col("block").alias("b"))
    inside = edges.join(own, "src").join(other, "dst").agg(F.avg((F.col("a") == F.col("b")).cast("int"))).first()[0]
    assert inside > 0.5


def test_landmarks_place_all_points_in_one_pass(papers, places):
    placed = L.layout(papers, "landmarks")
    assert placed.count() == 500
    assert trustworthiness(papers, placed) > 0.9
    assert trustworthiness(papers, placed) > trustworthiness(papers, places) - 0.08


def test_new_rows_in_a_stored_layout(spark, papers, places):
    stored = papers.join(places, "arxiv_id")
    new = papers.where("substring(arxiv_id, 2, 4) < '0040'").select(F.concat(F.lit("new"), "arxiv_id").alias("arxiv_id"), "embedding")
    moved = new.select("arxiv_id", F.transform("embedding", lambda v: v + F.lit(0.01)).cast("array<float>").alias("embedding"))
    none = spark.createDataFrame([("without", None)], moved.schema)
    at = {r["arxiv_id"]: (r["x"], r["y"]) for r in L.place_new(new.union(none), stored).collect()}
    assert at == {f"new{r['arxiv_id']}": (r["x"], r["y"]) for r in places.collect() if f"new{r['arxiv_id']}" in at} and len(at) == 40
    near = L.place_new(moved, stored).withColumnRenamed("arxiv_id", "n")
    # A twentieth of the layout's extent.
    far = stored.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0]
    met = near.join(places.withColumn("n", F.concat(F.lit("new"), "arxiv_id")).select("n", F.col("x").alias("u"), F.col("y").alias("v")), "n")
    gaps = [r[0] for r in met.select(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v"))).collect()]
    assert sorted(gaps)[30] < far / 20
    with pytest.raises(ValueError):
        L.place_new(new, stored.limit(0))

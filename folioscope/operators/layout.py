"""Two-dimensional coordinates of the papers.

``pca`` projects on the two main axes. ``umap`` follows McInnes, Healy and Melville (2018): a
weighted neighbour graph, then attraction along its edges against random repulsion. Points are
cut into blocks of bounded size, the leaves of a tree over their vectors, so that most edges stay
inside a block. In each round a task moves the points of its block while the neighbours outside
and a sample of all points stand still; rounds exchange the new positions by a join. Steps and
rounds are the same for any number of points. A point with very many edges has a replica in the
block of each neighbour, and the round's result is their weighted mean.

Rounds start from ``landmarks``: a sample of bounded size is laid out as one block, and all other
points are placed at the weighted mean of their nearest landmarks, in one pass. That alone is a
layout too, and places points that come later in a stored layout without a new descent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import arrays as A
from folioscope.operators.filters import valid_embeddings
from folioscope.operators.leaves import bounded, with_leaves
from folioscope.operators.neighbours import closest, distinct_vectors, nearest_distinct, spread_to_copies
from folioscope.operators.prepare import hash_sample
from folioscope.session import cut

# Fixed values of the layout.
NEIGHBOURS = 15
MIN_DIST = 0.1
SEED = 42

EDGES_DRAWN = 2
NEGATIVES = 5
STEPS = 1200
ROUNDS = 4
FINE_STEPS = 2400  # of all rounds together
FINE_RATE = 0.02  # of their first step, against 1 for landmarks
BLOCK_POINTS = 16_384
PART = 0.5  # of its way that a point goes in a round, as its neighbours in other blocks go theirs
SKY_POINTS = 1024  # points of all blocks that each block sees
LANDMARKS = 20_000
PLACED_ROWS = 2048  # rows that are compared with the landmarks together
HUB_EDGES = 16_384
START_EXTENT = 10.0
COPIES_LISTED = 16


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a, b such that 1 / (1 + a d^2b) is closest to 1 up to ``min_dist`` and to a decay beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    target = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b = 1.0, 1.0
    damping = 1e-3
    error = np.inf
    for _ in range(200):  # Levenberg-Marquardt on two parameters
        power = d ** (2 * b)
        fit = 1.0 / (1.0 + a * power)
        jacobian = np.stack([-power * fit**2, -a * power * 2 * np.log(d) * fit**2], axis=1)
        normal = jacobian.T @ jacobian
        step = np.linalg.solve(
            normal + damping * np.diag(np.diag(normal)), jacobian.T @ (target - fit)
        )
        tried = np.sum((target - 1.0 / (1.0 + (a + step[0]) * d ** (2 * (b + step[1])))) ** 2)
        if tried < error:
            a, b, error, damping = a + step[0], b + step[1], tried, damping / 3
        else:
            damping *= 3
    return float(a), float(b)


def local_weights(distances: np.ndarray, k: int) -> np.ndarray:
    """Membership weights of neighbour distances (rows sorted, the point itself left out).

    The nearest neighbour has weight 1; the width makes the weights of a row sum to log2(k).
    Absent neighbours are infinitely far.
    """
    finite = np.isfinite(distances)
    nearest = np.where(finite.any(axis=1), distances.min(axis=1, initial=np.inf), 0.0)
    excess = np.maximum(distances - nearest[:, None], 0.0)
    low, high = np.zeros(len(excess)), np.full(len(excess), np.inf)
    width = np.ones(len(excess))
    for _ in range(64):
        total = np.exp(-excess / width[:, None]).sum(axis=1)
        above = total > math.log2(k)
        high = np.where(above, width, high)
        low = np.where(above, low, width)
        width = np.where(np.isfinite(high), (low + high) / 2, width * 2)
    sums = np.where(finite, distances, 0.0).sum(axis=1)
    floor = 1e-3 * sums / np.maximum(finite.sum(axis=1), 1)
    width = np.maximum(np.minimum(width, 1e12), np.maximum(floor, 1e-12))
    return np.where(finite, np.exp(-excess / width[:, None]), 0.0)


def fuzzy_graph(near: DataFrame, k: int) -> DataFrame:
    """(src, dst, weight) in both directions from (src, dst, distance) neighbour pairs, all ids
    being numbers."""
    entry = F.struct("distance", "dst")
    lists = (
        near.where(F.col("src") != F.col("dst"))
        .groupBy("src")
        .agg(F.array_sort(F.collect_list(entry)).alias("near"))  # at most k entries
        .select("src", "near.dst", "near.distance")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("distance")
            sizes = np.diff(np.asarray(lists.offsets))
            place = np.arange(sizes.max()) < sizes[:, None]
            distances = np.full(place.shape, np.inf)
            distances[place] = np.asarray(lists.flatten())
            weights = local_weights(distances, k)[place]
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("src").take(rows), batch.column("dst").flatten(), pa.array(weights)],
                ["src", "dst", "weight"],
            )

    directed = lists.mapInArrow(run, "src long, dst long, weight double")
    there = F.struct("src", "dst")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = directed.select(F.explode(F.array(there, back)).alias("e"), "weight")
    both = both.select("e.src", "e.dst", "weight")
    # a + b - ab, where b is 0 for an edge seen from one side only
    product = F.when(F.count("*") > 1, F.min("weight") * F.max("weight")).otherwise(0.0)
    return both.groupBy("src", "dst").agg((F.sum("weight") - product).alias("weight"))


def _descend(
    at: np.ndarray,
    movable: int,
    starts: np.ndarray,
    dst: np.ndarray,
    weight: np.ndarray,
    steps: np.ndarray,
    shape: tuple[float, float],
    rng: np.random.Generator,
) -> np.ndarray:
    """Move the first ``movable`` points: per step each follows some of its edges and flees a
    few points drawn from all.

    ``starts`` delimits each point's edges in ``dst`` and ``weight``.
    """
    a, b = (np.float32(v) for v in shape)
    x, y = np.ascontiguousarray(at.T, dtype=np.float32)
    own_x, own_y = x[:movable], y[:movable]
    first, degree = starts[:-1], np.diff(starts)
    total = np.concatenate([[0.0], np.cumsum(weight)])
    mean = (total[starts[1:]] - total[first]) / degree
    # An edge is drawn evenly among the point's own and pulls in proportion to its weight.
    strength = (weight / np.repeat(mean, degree)).astype(np.float32)
    for rate in steps.astype(np.float32):
        edges = first + (rng.random((EDGES_DRAWN, movable)) * degree).astype(np.int64)
        ends = dst.take(edges)
        gap_x, gap_y = own_x - x.take(ends), own_y - y.take(ends)
        square = np.maximum(gap_x * gap_x + gap_y * gap_y, np.float32(1e-12))
        power = square**b
        force = -2 * a * b * power / (square * (1 + a * power))
        heft = strength.take(edges)
        move_x = (heft * np.clip(force * gap_x, -4, 4)).sum(axis=0)
        move_y = (heft * np.clip(force * gap_y, -4, 4)).sum(axis=0)

        others = rng.integers(0, len(x), (NEGATIVES, movable), dtype=np.int32)
        gap_x, gap_y = own_x - x.take(others), own_y - y.take(others)
        square = gap_x * gap_x + gap_y * gap_y
        force = 2 * b / ((np.float32(0.001) + square) * (1 + a * square**b))
        move_x += np.clip(force * gap_x, -4, 4).sum(axis=0)
        move_y += np.clip(force * gap_y, -4, 4).sum(axis=0)
        own_x += rate * move_x
        own_y += rate * move_y
    return np.stack([own_x, own_y], axis=1).astype(np.float64)


def _round(steps: np.ndarray, shape: tuple[float, float], seed: int, sky: np.ndarray, part: float):
    """Task of one block: its edges and the positions of all their ends in, its points out.

    ``sky`` holds (id, x, y) of a few points of all blocks, which repel as the others do.
    """

    def run(key: tuple, edges: pa.Table, ends: pa.Table) -> pa.Table:
        edges = edges.sort_by([("src", "ascending"), ("dst", "ascending")])
        src, dst = edges["src"].to_numpy(), edges["dst"].to_numpy()
        own, first, counts = np.unique(src, return_index=True, return_counts=True)
        ids = ends["id"].to_numpy()
        outside = ids[~np.isin(ids, own)]
        everyone = np.concatenate([own, np.sort(outside)])
        by_id, by_end = np.argsort(everyone), np.argsort(ids)
        at = np.stack([ends["x"].to_numpy(), ends["y"].to_numpy()], axis=1)
        at = at[by_end[np.searchsorted(ids, everyone, sorter=by_end)]]
        far = sky[~np.isin(sky[:, 0].astype(np.int64), everyone)]
        moved = _descend(
            np.concatenate([at, far[:, 1:]]),
            len(own),
            np.append(first, len(src)),
            by_id[np.searchsorted(everyone, dst, sorter=by_id)],
            edges["weight"].to_numpy(),
            steps,
            shape,
            np.random.default_rng([seed, int(key[0].as_py())]),
        )
        moved = at[: len(own)] + part * (moved - at[: len(own)])
        return pa.table({"id": own, "x": moved[:, 0], "y": moved[:, 1], "n": counts})

    return run


def optimise(
    edges: DataFrame,
    start: DataFrame,
    blocks: DataFrame,
    n_points: int,
    min_dist: float = MIN_DIST,
    seed: int = SEED,
    rounds: int = ROUNDS,
    steps: int = FINE_STEPS,
    rate: float = FINE_RATE,
) -> DataFrame:
    """(id, x, y) after pulling along edges (src, dst, weight) from the starting positions.

    ``blocks`` gives each id its block. Edges are shuffled once, to their block, and stay there. A
    round sends each block the positions of the points its edges touch, once per point, and gathers
    the points it moved; the driver sees ``SKY_POINTS`` positions or so.
    """
    edges = cut(edges, "edges")
    own = blocks.select(F.col("id").alias("src"), F.col("block").alias("own"))
    other = blocks.select(F.col("id").alias("dst"), F.col("block").alias("other"))
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    homed = edges.join(own, "src").withColumnRenamed("own", "block")
    hubs = edges.groupBy("src").agg(F.count("*").alias("degree")).where(F.col("degree") > HUB_EDGES)
    if rounds > 1 and not hubs.isEmpty():  # one round is one block
        block = F.when(F.col("degree").isNull(), F.col("block")).otherwise(F.col("other"))
        homed = homed.join(hubs, "src", "left").join(other, "dst").withColumn("block", block)
    placed = (
        homed.select("src", "dst", "weight", "block")
        .repartition(tasks, "block")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    ends = F.explode(F.array("src", "dst")).alias("id")
    touched = (
        placed.select(F.col("block").alias("home"), ends)
        .repartition(tasks, "id")
        .distinct()
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    shape = curve(min_dist)
    rates = rate * (1.0 - np.arange(steps) / steps)
    # Rounds have equal sums of rates: few long steps at first, many short ones at the end.
    share = np.minimum((np.cumsum(rates) / rates.sum() * rounds).astype(int), rounds - 1)
    seen = F.pmod(F.xxhash64("id"), F.lit(max(1, n_points // SKY_POINTS))) == 0
    at = start
    # Small steps leave the whole as it is, so what a block sees of it is taken once.
    sky = np.array([tuple(r) for r in at.where(seen).select("id", "x", "y").collect()]).reshape(-1, 3)
    sky = sky[np.argsort(sky[:, 0])]
    part = PART if rounds > 1 else 1.0
    for number, own_rates in enumerate(rates[share == i] for i in range(rounds)):
        moved = (
            placed.groupBy("block")
            .cogroup(touched.join(at, "id").groupBy("home"))
            .applyInArrow(
                _round(own_rates, shape, seed + number, sky, part),
                "id long, x double, y double, n long",
            )
        )
        mean = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("x", "y")]
        at = cut(moved.groupBy("id").agg(*mean), "positions")
    placed.unpersist()
    touched.unpersist()
    return at


def _plane(vectors: DataFrame) -> DataFrame:
    """Coordinates of (id, embedding) rows on the two main axes."""
    n, mean, cov = A.moments(vectors, "embedding")
    if not n:
        return vectors.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    _, axes = A.principal_axes(cov, 2)
    at = vectors.select("id", A.coordinates("embedding", mean, axes).alias("at"))
    return at.select("id", F.col("at")[0].alias("x"), F.get("at", F.lit(1)).alias("y"))


def place_near(vectors: DataFrame, known: pa.Table, k: int = NEIGHBOURS) -> DataFrame:
    """(id, x, y) of (id, embedding) rows: the weighted mean of their nearest placed vectors.

    ``known`` (embedding, x, y) is a bounded table that each task holds. A row that equals one of
    its vectors gets that one's place; weights are those of a neighbour graph. One Arrow pass.
    """
    corpus, place = A.matrix(known["embedding"]), np.stack([known[c].to_numpy() for c in ("x", "y")], axis=1)
    k = min(k, len(corpus))
    rank = np.arange(len(corpus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PLACED_ROWS):
                part = batch.slice(start, PLACED_ROWS)
                rows, cols, distances = closest(A.matrix(part["embedding"]), corpus, rank, k)
                distances, at = distances.reshape(-1, k), place[cols].reshape(-1, k, 2)
                weights = local_weights(distances, max(2, k))
                same = distances[:, :1] == 0
                weights = np.where(same, np.arange(k) == 0, weights)
                mean = (weights[:, :, None] * at).sum(axis=1) / weights.sum(axis=1)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(mean[:, 0]), pa.array(mean[:, 1])], ["id", "x", "y"]
                )

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "embedding").mapInArrow(run, f"id {kind}, x double, y double")


def landmark_table(
    points: DataFrame, n: int, k: int, min_dist: float, seed: int, neighbours: str, most: int = LANDMARKS, steps: int = STEPS
) -> pa.Table:
    """(embedding, x, y) of at most ``most`` of the points (id, embedding), chosen by a hash of the id.

    They start from their two main axes and are moved as one block, by one task of bounded size.
    """
    wanted = bounded(n, most, 4)
    some = cut(hash_sample(points.select("id", "embedding"), "id", n, wanted, seed), "landmarks")
    count = some.count()
    flat = cut(_plane(some), "start")
    extent = flat.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0]
    scale = START_EXTENT / (extent or 1.0)
    at = flat.select("id", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"))
    if count > 2:
        vectors = some.select(F.col("id").alias("rep"), "embedding")
        edges = fuzzy_graph(nearest_distinct(vectors, count, min(k, count), neighbours), k)
        one = some.select("id", F.lit(1).cast("long").alias("block"))
        at = optimise(edges, at, one, count, min_dist, seed, 1, steps, 1.0)
    return some.join(at, "id").orderBy("id").select("embedding", "x", "y").toArrow()


def layout(
    df: DataFrame,
    method: str = "umap",
    n_neighbors: int = NEIGHBOURS,
    min_dist: float = MIN_DIST,
    seed: int = SEED,
    key: str = "arxiv_id",
    neighbours: str = "forest",
    block_points: int = BLOCK_POINTS,
    landmarks: int = LANDMARKS,
    **options: int,
) -> DataFrame:
    """(key, x, y) for every row that has a vector. Equal vectors share a place.

    ``pca``: two main axes; ``landmarks``: a sample is laid out, all others are placed near it;
    ``umap``: the same, and then rounds over the neighbour graph of all points.
    """
    rows = valid_embeddings(df)
    if method == "pca":
        return _plane(rows.select(F.col(key).alias("id"), "embedding")).withColumnRenamed("id", key)
    if method not in ("umap", "landmarks"):
        raise ValueError(f"unknown method {method!r}")

    ordered = distinct_vectors(rows, COPIES_LISTED, key).sortWithinPartitions("rep")
    numbered = ordered.withColumn("id", F.monotonically_increasing_id())
    points = cut(numbered, "distinct-vectors")
    n = points.count()
    known = landmark_table(points, n, n_neighbors, min_dist, seed, neighbours, landmarks)
    at = place_near(points, known, n_neighbors) if known.num_rows else _plane(points.select("id", "embedding"))
    if n > 2 and method == "umap":
        vectors = points.select(F.col("id").alias("rep"), "embedding")
        near = nearest_distinct(vectors, n, min(n_neighbors, n), neighbours)
        leaves = with_leaves(points.select("id", "embedding"), bounded(n, block_points), 1, seed, key="id")
        blocks = leaves.select("id", F.col("leaf")[0].alias("block"))
        edges = fuzzy_graph(near, n_neighbors)
        at = optimise(edges, cut(at, "start"), blocks, n, min_dist, seed, **options)
    named = points.select("id", F.col("rep").alias("src")).join(at, "id").drop("id")
    return spread_to_copies(rows, points.drop("id"), named, COPIES_LISTED, key)


def place_new(new: DataFrame, placed: DataFrame, key: str = "arxiv_id", most: int = LANDMARKS, seed: int = SEED) -> DataFrame:
    """(key, x, y) of new rows in a stored layout: no descent, and no stored place changes.

    ``placed`` (key, embedding, x, y) are the stored rows; at most ``most`` of them, by a hash of
    the key, serve as landmarks. Rows without a vector get no place.
    """
    stored = valid_embeddings(placed).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    some = hash_sample(stored.select(key, "embedding", "x", "y"), key, stored.count(), most, seed)
    known = some.orderBy(key).select("embedding", "x", "y").toArrow()
    if not known.num_rows:
        raise ValueError("the stored layout has no places")
    rows = valid_embeddings(new).select(F.col(key).alias("id"), "embedding")
    return place_near(rows, known).withColumnRenamed("id", key)

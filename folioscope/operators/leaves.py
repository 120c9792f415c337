"""Leaves of random-projection trees, bounded in size at every number of rows.

A node of a tree splits its rows at the median of their projections on a random direction; nodes of
equal depth share it. Trees grow in passes: a pass counts the leaves, draws a fresh sample of each
leaf that is too full, finds the medians of its next levels in it, and routes the rows. Passes go on
until all leaves fit, so a sample that misjudged a leaf, or a tree deeper than one pass can make it,
costs a further pass and nothing else. Tasks share the work of a leaf however large it still is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.arrays import matrix
from folioscope.session import cut

LEVELS = 6  # at most, that a leaf is split by in a pass
SPLITS = 16_384  # leaves split in a pass; others wait for the next one
SAMPLE = 64  # rows sampled for each leaf that is to come
DEPTH = 62  # of a tree, as leaf numbers have 64 bits
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # multipliers of the finishing step of splitmix64


def bounded(n: int, most: int, parts: int = 8, least: int = 32) -> int:
    """Rows of a part: at most ``most``, and few enough that ``n`` rows make several parts."""
    return min(most, max(least, math.ceil(n / parts)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


class _Splits:
    """Leaves of a pass that are to be split: by tree, sorted leaf numbers, depths and sampling rates."""

    def __init__(self, rows: list, size: int, levels: int):
        order = sorted(range(len(rows)), key=lambda i: (rows[i]["tree"], rows[i]["leaf"]))
        self.tree = np.array([rows[i]["tree"] for i in order], np.int32)
        self.leaf = np.array([rows[i]["leaf"] for i in order], np.int64)
        count = np.array([rows[i]["count"] for i in order], np.float64)
        # Aiming below the bound keeps most leaves from a further pass.
        self.depth = np.clip(np.ceil(np.log2(count / (0.8 * size))), 1, levels).astype(np.int64)
        self.rate = np.minimum(1.0, SAMPLE * 2.0**self.depth / count)

    def find(self, tree: int, leaf: np.ndarray) -> np.ndarray:
        """Number of the split of each leaf of a tree; -1 for leaves that stay."""
        a, b = np.searchsorted(self.tree, [tree, tree + 1])
        own = self.leaf[a:b]
        if not len(own):
            return np.full(len(leaf), -1)
        at = np.minimum(np.searchsorted(own, leaf), len(own) - 1)
        return np.where(own[at] == leaf, a + at, -1)


def _bit_length(leaf: np.ndarray) -> np.ndarray:
    return np.frexp(leaf.astype(np.float64))[1]


def _projected(x: np.ndarray, leaf: np.ndarray, depth: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Projections of each row on the next ``depth`` directions below its leaf."""
    level = _bit_length(leaf) - 1
    low, high = int(level.min()), int((level + depth).max())
    values = x @ planes[low:high].T
    at = (level - low)[:, None] + np.arange(int(depth.max()))
    return np.take_along_axis(values, np.minimum(at, values.shape[1] - 1), axis=1)


def _medians(values: np.ndarray, depth: int) -> np.ndarray:
    """Thresholds of the ``2 ** depth - 1`` nodes below a leaf, in heap order."""
    cuts = np.zeros(2**depth - 1)
    place = np.zeros(len(values), np.int64)
    for level in range(depth):
        for node in range(2**level - 1, 2 ** (level + 1) - 1):
            here = np.flatnonzero(place == node)
            cuts[node] = np.median(values[here, level]) if len(here) else 0.0
            place[here] = 2 * node + 1 + (values[here, level] > cuts[node])
    return cuts


def with_leaves(
    vectors: DataFrame, rows: int, trees: int = 1, seed: int = 42, levels: int = LEVELS, key: str = "rep"
) -> DataFrame:
    """``vectors`` (key, embedding) with ``leaf``: its leaf's number in each of ``trees`` trees.

    No leaf has more than ``rows`` rows. Leaf numbers are those of binary heaps: the root is 1, the
    children of i are 2i and 2i + 1. Vectors are all different, none is null; equal projections are
    told apart by a hash of the key. The driver sees counts and thresholds of ``SPLITS`` leaves.
    """
    root = F.array_repeat(F.lit(1).cast("long"), trees)
    state = vectors.select(key, F.col("embedding").cast("array<float>").alias("embedding"), root.alias("leaf"))
    while True:
        each = state.select(F.posexplode("leaf").alias("tree", "leaf"))
        full = each.groupBy("tree", "leaf").count().where(F.col("count") > rows)
        chosen = full.orderBy(F.desc("count"), "tree", "leaf").limit(SPLITS).collect()
        if not chosen:
            return state
        state = _split(state, _Splits(chosen, rows, levels), trees, seed, key)


def _split(state: DataFrame, splits: _Splits, trees: int, seed: int, key: str) -> DataFrame:
    """``state`` after one pass: the leaves in ``splits`` are replaced by those of their next levels."""

    def looked_up(batch: pa.RecordBatch, planes: dict[int, np.ndarray]) -> Iterator[tuple]:
        """By tree: the rows in a leaf to be split, its number, their projections, hashes of all rows."""
        leaf, x = matrix(batch["leaf"]).astype(np.int64), matrix(batch["embedding"])
        h = batch["h"].to_numpy().view(np.uint64)
        for tree in range(trees):
            if tree not in planes:
                rng = np.random.default_rng([seed, tree])
                planes[tree] = rng.standard_normal((DEPTH + LEVELS, x.shape[1]))
            found = splits.find(tree, leaf[:, tree])
            at = np.flatnonzero(found >= 0)
            if len(at):
                values = _projected(x[at], leaf[at, tree], splits.depth[found[at]], planes[tree])
                yield tree, at, found[at], values, _mixed(h[at] ^ np.uint64(tree * 1_000_003 + seed))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, _, number, values, own in looked_up(batch, planes) if batch.num_rows else ():
                taken = (own >> np.uint64(11)).astype(np.float64) / 2.0**53 < splits.rate[number]
                number, depths = number[taken], splits.depth[number[taken]]
                packed = [v[:d].tobytes() for v, d in zip(values[taken], depths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int64()), pa.array(packed, pa.binary())], ["split", "projections"]
                )

    def medians(key: tuple, table: pa.Table) -> pa.Table:
        depth = int(splits.depth[key[0].as_py()])
        values = np.frombuffer(b"".join(table["projections"].to_pylist()), "<f8").reshape(-1, depth)
        return pa.table({"split": [key[0].as_py()], "cuts": pa.array([_medians(values, depth).tobytes()], pa.binary())})

    hashed = state.select(key, "embedding", "leaf", F.xxhash64(key).alias("h"))
    sampled = hashed.drop(key).mapInArrow(sample, "split long, projections binary")
    cuts = np.zeros((len(splits.tree), 2 ** int(splits.depth.max()) - 1))
    for row in sampled.groupBy("split").applyInArrow(medians, "split long, cuts binary").collect():
        own = np.frombuffer(row["cuts"], "<f8")
        cuts[row["split"], : len(own)] = own

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = matrix(batch["leaf"]).astype(np.int64)
            for tree, at, number, values, own in looked_up(batch, planes):
                depth = splits.depth[number]
                place = np.zeros(len(at), np.int64)
                for level in range(int(depth.max())):
                    go = np.flatnonzero(depth > level)
                    v, c = values[go, level], cuts[number[go], place[go]]
                    bit = (own[go] >> np.uint64(level)) & np.uint64(1) == 1
                    place[go] = 2 * place[go] + 1 + ((v > c) | ((v == c) & bit))
                leaf[at, tree] = (leaf[at, tree] << depth) | (place - (2**depth - 1))
            yield pa.RecordBatch.from_arrays([batch[key], batch["embedding"], _longs(leaf)], [key, "embedding", "leaf"])

    kind = state.schema[key].dataType.simpleString()
    return cut(hashed.mapInArrow(route, f"{key} {kind}, embedding array<float>, leaf array<long>"), "leaves")


def _longs(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.int64()))

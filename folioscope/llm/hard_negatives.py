"""Hard negatives of anchors by coordinate pruning.

Rows are dealt by range into blocks of one dimension and label, long vectors first, and anchors by
hash into tiles; each block meets each tile that needs it in one group of bounded size. In a group the rows
form buckets of similar length. A score of at least ``t`` between an anchor and a row of a bucket
means a cosine of at least ``c = t / (anchor's length x longest of the bucket)``, and then every
coordinate of the row's unit vector lies within ``sqrt((1 - c^2) (1 - q^2))`` of ``c q``, where ``q``
is the anchor's. So for the coordinates in which the anchor is largest, a range of the bucket's sorted
list of that coordinate is feasible, and only rows feasible in all of them are scored exactly. A
bucket whose vectors are too short for any row to reach ``t`` is skipped whole.

Positives come first; each gives an interval of negative scores. What a negative's score must reach
rises with the best ones found so far in the group, and starts from what a sixteenth of the rows, by
hash, already guarantee. Neither changes the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut

SCALE = 256
MOST = 2**20  # components are held within this size, so that sums stay in 64 bits
BLOCK_ROWS = 32_768
TILE_ANCHORS = 4096
BUCKET_ROWS = 2048
SEED_EVERY = 16
FOCUS = 4  # coordinates looked at
LOOSE = 1e-6  # slack of the feasible ranges against rounding
NONE = -(2**62)

ROW_SCHEMA = "vec_id long, label long, dim int, length double, x binary"
HIT_SCHEMA = "anchor_id long, own int, positive_id long, positive_score long, other_id long, score long"


def usable(rows: DataFrame) -> DataFrame:
    """Rows that take part, as whole numbers: (vec_id, label, dim, length, x).

    Without a label, an id, a vector, or with a null or non-finite component a row takes no part.
    Rows of one id are one row, the least by label and vector. Components beyond ``MOST`` are held there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            flat = lists.flatten()
            values = np.nan_to_num(flat.fill_null(0).to_numpy().astype(np.float64))
            x = np.clip(np.floor(SCALE * values), -MOST, MOST).astype("<i4")
            ends = np.cumsum(lists.value_lengths().to_numpy()) if len(lists) else np.zeros(0, np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            own = [x[a:b] for a, b in zip(starts, ends, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"], batch["label"], pa.array([len(v) for v in own], pa.int32()),
                    pa.array([float(np.sqrt((v.astype(np.float64) ** 2).sum())) for v in own], pa.float64()),
                    pa.array([v.tobytes() for v in own], pa.binary()),
                ],
                ["vec_id", "label", "dim", "length", "x"],
            )

    good = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    )
    one = F.min(F.struct("label", "dim", "length", "x")).alias("r")
    return good.mapInArrow(run, ROW_SCHEMA).groupBy("vec_id").agg(one).select("vec_id", "r.*")


def dealt(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` with ``block``: runs of at most ``block_rows`` rows of one dimension and label, long ones first."""
    keys = ["dim", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            kinds = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
            blocks = []
            for kind in kinds:
                if last is not None and (kind != last or held == block_rows):
                    number, held = number + 1, 0
                held, last = held + 1, kind
                blocks.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], [*batch.schema.names, "block"])

    order = [*keys, F.desc("length"), "vec_id"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", block long")


def tiled(rows: DataFrame, tile_rows: int) -> DataFrame:
    """``rows`` with ``tile``: parts of some ``tile_rows`` rows of one dimension and label, by hash."""
    parts = rows.groupBy("dim", "label").agg(F.ceil(F.count("*") / tile_rows).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return rows.join(parts, ["dim", "label"]).withColumn("tile", F.concat_ws(":", "dim", "label", part)).drop("parts")


class Bucket:
    """Rows of similar length: whole numbers, unit vectors' sorted coordinate lists, the greatest length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lengths: np.ndarray):
        self.ids, self.x, self.longest = ids, x, float(lengths.max(initial=0.0))
        self.real = x.astype(np.float64)
        unit = x / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(unit, self.order, axis=0)

    def candidates(self, q: np.ndarray, q_length: float, focus: np.ndarray, least: int) -> np.ndarray | None:
        """Rows that may score at least ``least`` against ``q``; None means all of them."""
        if least <= 0 or q_length == 0 or not len(focus):
            return None if least <= 0 else np.zeros(0, np.int64)
        if self.longest * q_length < least * (1 - LOOSE):
            return np.zeros(0, np.int64)
        c = min(1.0, least * (1 - LOOSE) / (self.longest * q_length))
        times = np.zeros(len(self.ids), np.uint8)
        for f in focus:
            at = q[f] / q_length
            reach = np.sqrt(max(0.0, 1 - c * c) * max(0.0, 1 - at * at)) + LOOSE
            # A row may point closer to the anchor than c asks: from cosine q on, 1 is within reach.
            low = -1.0 if at <= -c else c * at - reach
            high = 1.0 if at >= c else c * at + reach
            a, b = np.searchsorted(self.lists[:, f], [low - LOOSE, high + LOOSE], "left")
            times[self.order[a:b, f]] += 1
        may = np.flatnonzero(times == len(focus))
        return may if 2 * len(may) < len(self.ids) else None  # taking most rows out costs more than scoring all

    def scores(self, q: np.ndarray, q_length: float, may: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact inner products of the rows ``may``, or of all."""
        exact = self.longest * q_length < 2**52  # no partial sum is longer, so doubles hold all of them
        x = self.real if exact else self.x.astype(np.int64)
        y = q.astype(x.dtype)
        if may is None:
            return self.ids, (x @ y).astype(np.int64)
        return self.ids[may], (x[may] @ y).astype(np.int64)


def buckets(ids: np.ndarray, x: np.ndarray, lengths: np.ndarray, rows: int = BUCKET_ROWS) -> list[Bucket]:
    order = np.lexsort((ids, -lengths))
    return [Bucket(ids[o], x[o], lengths[o]) for o in (order[i : i + rows] for i in range(0, len(order), rows))]


def top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by descending score, then ascending id."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _search_group(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """For each asked interval of each anchor the first ``k`` rows whose scores lie in it.

    Intervals of an anchor are looked at together, as they share its coordinate ranges. Rows of the
    anchor's own id never count.
    """
    out: dict[str, list] = {f.split()[0]: [] for f in HIT_SCHEMA.split(", ")}
    if anchors.num_rows and rows.num_rows:
        dim = rows["dim"][0].as_py()
        x = np.frombuffer(b"".join(rows["x"].to_pylist()), "<i4").reshape(-1, dim) if dim else np.zeros((rows.num_rows, 0), np.int32)
        found = buckets(rows["vec_id"].to_numpy(), x, rows["length"].to_numpy())
        for i in range(anchors.num_rows):
            anchor = anchors["anchor_id"][i].as_py()
            q = np.frombuffer(anchors["q"][i].as_py(), "<i4")
            length = anchors["q_length"][i].as_py()
            focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
            asked = anchors["asked"][i].as_py()
            least = [a["least"] for a in asked]
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
            for bucket in found:
                may = bucket.candidates(q, length, focus, min(least))
                if may is not None and not len(may):
                    continue
                ids, score = bucket.scores(q, length, may)
                for n, a in enumerate(asked):
                    fit = np.flatnonzero((score >= least[n]) & (score <= a["most"]) & (ids != anchor))
                    if not len(fit):
                        continue
                    s, d = np.concatenate([best[n][0], score[fit]]), np.concatenate([best[n][1], ids[fit]])
                    keep = top(s, d, k)
                    best[n] = (s[keep], d[keep])
                    if len(keep) == k:
                        least[n] = max(least[n], int(s[keep[-1]]))
            for n, a in enumerate(asked):
                s, d = best[n]
                out["anchor_id"] += [anchor] * len(s)
                out["own"] += [a["own"]] * len(s)
                out["positive_id"] += [a["positive_id"]] * len(s)
                out["positive_score"] += [a["positive_score"]] * len(s)
                out["other_id"] += d.tolist()
                out["score"] += s.tolist()
    kinds = {"own": pa.int32()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def search(anchors: DataFrame, rows: DataFrame, same: bool, k: int) -> DataFrame:
    """What may be among the first ``k`` of each asked interval, from each block.

    ``anchors`` has (anchor_id, label, dim, q, q_length, tile, asked); a tile meets the blocks of its
    dimension that have its label (``same``) or may have another one. Both sides of a group are bounded.
    """
    places = rows.groupBy("block", "dim", "label").agg(F.count("*").alias("n")).alias("b")
    tiles = anchors.groupBy("tile", "dim", "label").agg(F.count("*").alias("m")).alias("t")
    fits = F.col("b.label") == F.col("t.label") if same else F.col("b.label") != F.col("t.label")
    meet = tiles.join(places, (F.col("b.dim") == F.col("t.dim")) & fits).select("tile", "block").distinct()
    met = meet.select(F.col("tile").alias("met_tile"), F.col("block").alias("met_block"))
    left = anchors.join(met, F.col("tile") == F.col("met_tile")).select(
        F.col("met_tile").alias("left_tile"), F.col("met_block").alias("left_block"), "anchor_id", "q", "q_length", "asked"
    )
    right = rows.join(met, F.col("block") == F.col("met_block")).select(
        F.col("met_tile").alias("right_tile"), F.col("met_block").alias("right_block"), "vec_id", "dim", "length", "x"
    )

    def run(key: tuple, a: pa.Table, r: pa.Table) -> pa.Table:
        return _search_group(a, r, k)

    grouped = left.groupBy("left_tile", "left_block").cogroup(right.groupBy("right_tile", "right_block"))
    return grouped.applyInArrow(run, HIT_SCHEMA)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "own").orderBy(F.desc("score"), "other_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_floors(anchors: DataFrame, rows: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchors`` whose intervals begin where a sixteenth of the rows already give ``k`` results."""
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(SEED_EVERY)) == 0)
    last = _ranked(search(anchors, some, same, k), k).where(F.col("rank") == k)
    floors = last.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("own", "score"))).alias("floors"))
    raised = F.transform("asked", lambda a: F.struct(
        a["own"].alias("own"), a["positive_id"].alias("positive_id"), a["positive_score"].alias("positive_score"),
        F.coalesce(F.try_element_at("floors", a["own"]), a["least"]).alias("least"), a["most"].alias("most"),
    ))
    return anchors.join(floors, "anchor_id", "left").withColumn("asked", raised).drop("floors")


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    block_rows: int = BLOCK_ROWS, tile_anchors: int = TILE_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of labelled vectors.

    Anchors are the rows whose vec_id is divisible by ``every``, their positives the first
    ``positives`` other rows of the same label, and the negatives of a positive the first
    ``negatives`` rows of another label with ``low x positive <= 100 x negative <= high x positive``.
    Higher scores come first, ties by smaller vec_id. Only vectors of the same number of components
    are compared. An empty table, an anchor alone with its label, and a positive without a row in its
    interval give no rows. Rows that take no part: see ``usable``. Other columns are not read.
    """
    rows = cut(dealt(usable(vectors), block_rows), "rows")
    chosen = rows.where(F.col("vec_id") % every == 0).drop("block")
    anchors = cut(tiled(chosen, tile_anchors).select(
        F.col("vec_id").alias("anchor_id"), "label", "dim", F.col("x").alias("q"), F.col("length").alias("q_length"), "tile"
    ), "anchors")
    nothing = F.lit(NONE).cast("long")
    all_of_it = F.array(F.struct(
        F.lit(0).alias("own"), F.lit(None).cast("long").alias("positive_id"), F.lit(None).cast("long").alias("positive_score"),
        nothing.alias("least"), (-nothing).alias("most"),
    ))
    asking = cut(_with_floors(anchors.withColumn("asked", all_of_it), rows, True, positives), "asked")
    near = _ranked(search(asking, rows, True, positives), positives).select(
        "anchor_id", F.struct(
            F.col("rank").alias("own"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"),
            F.expr(f"({low} * score + 99) div 100").alias("least"), F.expr(f"({high} * score) div 100").alias("most"),
        ).alias("a"),
    ).where(F.col("a.positive_score") >= 0)  # below 0 the interval is empty
    asked = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list("a")).alias("asked"))
    asking = cut(_with_floors(cut(anchors.join(asked, "anchor_id"), "asked"), rows, False, negatives), "asked")
    return _ranked(search(asking, rows, False, negatives), negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )

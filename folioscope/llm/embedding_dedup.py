"""Near copies among embeddings: spherical k-means cells, blocked cosine products between cells.

Equal vectors are one class before anything is compared. Cells are fitted on a bounded sample for
each length of vectors; every vector lies in its nearest cell. Two vectors of different cells are
compared unless an angle bound proves that they cannot link, so no link is lost; where the bound
rules out nothing, the work grows with the square of the distinct vectors. Neighbouring cells are
packed into blocks of bounded size; each block pair is a task group of its own and sends a count
per vector and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from folioscope.llm.components import components
from folioscope.session import cut

CELL_ROWS = 1500  # distinct vectors that a cell holds on average
SAMPLE_ROWS = 20_000  # vectors that the cells are fitted on at most
MOST_CELLS = 4096  # cells of a vector length at most; beyond, cells grow and are cut into more blocks
BLOCK_BYTES = 1 << 21  # of packed vectors in a block
ROUNDS = 12
SLACK = 1e-6  # by which bounds are widened against rounding
SALTS = 16


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """``k`` unit centres of the rows of ``x``, which have length one."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms == 0
        if empty.any():  # an empty cell starts again at the rows that are worst placed
            worst = np.argsort((x * centres[nearest]).sum(axis=1))[: int(empty.sum())]
            sums[np.flatnonzero(empty)[: len(worst)]] = x[worst]
            norms = np.linalg.norm(sums, axis=1)
        centres = sums / np.where(norms == 0, 1, norms)[:, None]
    return centres


def _rows(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class _Cells:
    """Cells of the vectors of one length, numbered from ``first`` on."""

    first: int
    centres: np.ndarray
    radius: np.ndarray | None = None  # largest angle of a vector to its centre; -1 for an empty cell
    block: np.ndarray | None = None  # first block of each cell
    parts: np.ndarray | None = None  # blocks that a cell is cut into

    def reach(self, x: np.ndarray, home: np.ndarray, cells: np.ndarray, least: float) -> np.ndarray:
        """May row i of ``x``, of cell ``home[i]``, link with a vector of each of the ``cells``?

        What is nearer to a centre than to the own one lies beyond the plane between the two. A
        row whose angle to that plane, or to the cell's cone, is larger than that of ``least``
        links with nothing there.
        """
        out = np.zeros((len(x), len(cells)), bool)
        if least <= 0:
            return ~out
        far, angle = np.sqrt(1 - min(least, 1.0) ** 2) + SLACK, np.arccos(min(least, 1.0)) + SLACK
        to = self.centres[cells]
        for own in np.unique(home):
            apart = np.linalg.norm(to - self.centres[own], axis=1)
            rows = np.flatnonzero(home == own)
            for start in range(0, len(rows), 512):
                part = rows[start : start + 512]
                near = x[part] @ to.T
                beyond = (x[part] @ self.centres[own])[:, None] - near
                cone = np.arccos(np.clip(near, -1, 1)) <= self.radius[cells] + angle
                out[part] = (beyond <= far * apart + SLACK) & cone
            out[np.ix_(rows, np.flatnonzero(cells == own))] = True
        return out & (self.radius[cells] >= 0)


def _assigned(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch["width"].to_numpy()
            for width in np.unique(widths).tolist():
                same = batch.filter(pa.array(widths == width))
                model = models.value[width]
                for start in range(0, same.num_rows, 4096):
                    part = same.slice(start, 4096)
                    near = _unit(_rows(part["v"])) @ model.centres.T
                    angle = np.arccos(np.clip(near.max(axis=1), -1, 1))
                    cell = (model.first + near.argmax(axis=1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part["rep"], part["copies"], part["v"], part["width"], pa.array(cell), pa.array(angle)],
                        ["rep", "copies", "v", "width", "cell", "angle"],
                    )

    return run


def _chain(centres: np.ndarray) -> list[int]:
    """The centres in an order in which each is followed by the nearest of those left."""
    left = np.ones(len(centres), bool)
    order = [0]
    left[0] = False
    while left.any():
        order.append(int(np.argmax(np.where(left, centres @ centres[order[-1]], -np.inf))))
        left[order[-1]] = False
    return order


def _blocked(models: dict[int, _Cells], stats: dict[int, tuple[int, float]], item: int) -> None:
    """Give each cell its radius and its blocks: small neighbouring cells share one, large ones have several."""
    block = 0
    for width, model in models.items():
        k, limit = len(model.centres), max(1, BLOCK_BYTES // (item * width))
        model.radius, model.block, model.parts = np.full(k, -1.0), np.zeros(k, np.int64), np.ones(k, np.int64)
        filled = 0
        for cell in _chain(model.centres):
            n, model.radius[cell] = stats.get(model.first + cell, (0, -1.0))
            if filled and filled + n > limit:
                block, filled = block + 1, 0
            model.block[cell], model.parts[cell] = block, max(1, -(-n // limit))
            filled += n
            if n > limit:
                block, filled = block + int(model.parts[cell]), 0
        block += 1


def _packed(models, least: float, kind: str):
    """Block: its vectors, sorted by id, as one row, and the blocks that its vectors may link with."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, width = (k.as_py() for k in key)
        model = models.value[width]
        table = table.combine_chunks().sort_by("rep")
        x = _rows(table["v"].combine_chunks())
        home = table["cell"].to_numpy().astype(np.int64) - model.first
        cells = np.arange(len(model.centres))
        reached = np.zeros(len(cells), bool)
        for start in range(0, len(x), 1024):
            reached |= model.reach(_unit(x[start : start + 1024]), home[start : start + 1024], cells, least).any(axis=0)
        met = [np.arange(model.block[c], model.block[c] + model.parts[c]) for c in np.flatnonzero(reached)]
        return pa.table({
            "block": pa.array([block], pa.int64()),
            "width": pa.array([width], pa.int32()),
            "reps": pa.array([table["rep"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "copies": pa.array([table["copies"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "homes": pa.array([home.astype("<i4").tobytes()], pa.binary()),
            "vectors": pa.array([x.astype(kind).tobytes()], pa.binary()),
            "meets": pa.array([np.unique(np.concatenate(met))], pa.list_(pa.int64())),
        })

    return run


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable row for each of ``n`` rows, over links a - b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        open_ = label[a] != label[b]
        if not open_.any():
            break
        a, b = a[open_], b[open_]
    return label


def _compared(models, least: float, kind: str):
    """Block pair (left, right): counts of links and spanning edges, as (rep, root, linked) rows."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        left, right = (k.as_py() for k in key)
        sides = []
        for side in (left,) if left == right else (left, right):
            at = table["block"].to_pylist().index(side)
            model = models.value[table["width"][at].as_py()]
            reps, copies = (np.frombuffer(table[c][at].as_py(), "<i8") for c in ("reps", "copies"))
            x = np.frombuffer(table["vectors"][at].as_py(), kind).astype(np.float64).reshape(len(reps), -1)
            sides.append((reps, copies, np.frombuffer(table["homes"][at].as_py(), "<i4"), _unit(x)))
        if left != right:
            others = [np.unique(sides[1][2]), np.unique(sides[0][2])]
            keep = [model.reach(s[3], s[2], o, least).any(axis=1) for s, o in zip(sides, others, strict=True)]
            sides = [tuple(c[k] for c in s) for s, k in zip(sides, keep, strict=True)]
        reps, copies, x = (np.concatenate([s[c] for s in sides]) for c in (0, 1, 3))
        rows = len(sides[0][0])
        cols = np.arange(rows if left != right else 0, len(reps))
        count = np.zeros(len(reps), np.int64)
        label = np.arange(len(reps))
        for start in range(0, rows, 512):
            own = np.arange(start, min(start + 512, rows))
            i, j = np.nonzero(x[own] @ x[cols].T >= least - 1e-9)
            i, j = own[i], cols[j]
            keep = i < j
            i, j = i[keep], j[keep]
            # Close to the limit the sum of products in plain order decides.
            exact = np.concatenate([
                np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) >= least for k in range(0, len(i), 65536)
            ] or [np.zeros(0, bool)])
            i, j = i[exact], j[exact]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            i, j = np.concatenate([np.arange(len(reps)), i]), np.concatenate([label, j])
            label = forest(len(reps), i, j)
        hit = np.flatnonzero(count)
        return pa.table({"rep": reps[hit], "root": reps[label[hit]], "linked": count[hit]})

    return run


def link(vectors: DataFrame, least: float = 0.9, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Vectors link when their cosine in double precision is at least ``least``. Equal vectors link
    (their cosine is 1). Vectors that are null, zero, of length 0 or hold null or non-finite
    components link with nothing; vectors of different lengths do not link with each other. A
    repeated vec_id counts as another vector of that id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("v", lambda c: c != 0), F.lit(False)
    )
    # -0.0 and 0.0 are the same component; two hashes stand for the vector in the joins below.
    rows = rows.withColumn("fine", fine).withColumn("v", F.when(F.col("fine"), F.transform("v", lambda c: c + F.lit(0.0))))
    keyed = rows.select(
        "vec_id", "fine", "v", F.size("v").alias("width"), F.xxhash64("v").alias("h1"),
        F.xxhash64(F.lit(1), "v", F.lit(2)).alias("h2"),
    )
    good = keyed.where("fine")
    classes = good.groupBy("width", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")
    )
    classes = cut(classes, "classes")
    models, first = {}, 0
    # One row for each length that vectors have.
    for row in classes.groupBy("width").count().orderBy("width").collect():
        width, k = row["width"], max(1, min(MOST_CELLS, row["count"] // cell_rows))
        centres = np.zeros((1, width))
        if k > 1:
            sample = classes.where(F.col("width") == width).orderBy(F.xxhash64("h1"), "h1")
            sample = sample.limit(min(SAMPLE_ROWS, 8 * cell_rows * k)).select("v").toArrow()
            centres = spherical_kmeans(_unit(_rows(sample["v"].combine_chunks())), k)
        models[width] = _Cells(first, centres)
        first += len(centres)
    if not models:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    share = spark.sparkContext.broadcast
    placed = classes.select("rep", "copies", "v", "width").mapInArrow(
        _assigned(share(models)), "rep long, copies long, v array<double>, width int, cell int, angle double"
    )
    placed = cut(placed, "placed")
    # One row a cell.
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()
    single = vectors.schema["embedding"].dataType.elementType == FloatType()
    _blocked(models, {r["cell"]: (r["n"], r["angle"]) for r in sizes}, 4 if single else 8)
    known, kind = share(models), "<f4" if single else "<f8"
    of_cell = [
        (m.first + c, int(m.block[c]), int(m.parts[c])) for m in models.values() for c in range(len(m.centres))
    ]
    of_cell = F.broadcast(spark.createDataFrame(of_cell, "cell int, block long, parts long"))
    part = F.pmod(F.xxhash64("rep", "v"), F.col("parts"))
    blocks = placed.drop("angle").join(of_cell, "cell").withColumn("block", F.col("block") + part)
    blocks = cut(
        blocks.select("block", "width", "rep", "copies", "v", "cell").groupBy("block", "width").applyInArrow(
            _packed(known, least, kind),
            "block long, width int, reps binary, copies binary, homes binary, vectors binary, meets array<long>",
        ),
        "blocks",
    )
    met = blocks.select("block", F.explode("meets").alias("other"))
    # Either side must reach the other one.
    pairs = met.groupBy(F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).count()
    pairs = cut(pairs.where("count = 2 or left = right").select("left", "right"), "pairs")
    wanted = pairs.withColumn("block", F.explode(F.array_distinct(F.array("left", "right"))))
    found = wanted.join(blocks.drop("meets"), "block").groupBy("left", "right").applyInArrow(
        _compared(known, least, kind), "rep long, root long, linked long"
    )
    found = cut(found, "found")
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    out = classes.select("h1", "h2", "rep", "copies").join(counts, "rep", "left").join(
        reached.withColumnRenamed("id", "rep"), "rep", "left"
    )
    out = out.select(
        "h1", "h2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    # One vector may be held by a third of all rows, so both sides are spread over salts.
    out = out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    usable = F.col("fine")
    each = keyed.select(
        "vec_id", F.when(usable, F.col("h1")).alias("h1"), F.when(usable, F.col("h2")).alias("h2"),
        F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    joined = each.join(out, ["h1", "h2", "salt"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )

"""Links between documents whose sets of word shingles have a high Jaccard similarity.

Adaptive multi-match prefixes: shingles are ordered by how often they occur, rare ones first. Two
sets of at least ``t`` similarity share at least ``m`` of the first ``size - ceil(t size) + m``
shingles of either. Each document takes ``m = 1`` unless the counts say that this prefix would meet
many documents; then its prefix is lengthened and correspondingly more shared shingles are asked
for before a pair is verified on the whole sets.

Equal sets form one class before any pair is made. Inside a group of documents that share a prefix
shingle pairs are not enumerated: each document meets one leader of the group, verified links are
joined to components, and only documents of different components meet in the last round, where the
places of the common shingle in both sets must allow a link.

Links are then counted inside components: the whole sets of their classes are packed into blocks,
and each pair of blocks of a component is one small matrix of common shingles, so no row is made
for a pair of documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import (
    counting_table, hash_words, kept, mixed, presence_table, present, text_slices, unused, words_of,
)
from folioscope.llm.components import components
from folioscope.session import cut

TABLE_BITS = 20  # cells of the table that estimates how often a shingle occurs: 4 MB
FILTER_BITS = 22  # cells of the table that keeps most texts without a candidate out of a second scan
MANY = 32  # expected candidates from which on a prefix is lengthened
MOST_MATCHES = 6
SLICE = 2_000_000  # of text whose shingles are held at once, in several arrays as long as the words
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: offsets and values.

    Words are runs without ASCII white space, A-Z taken as a-z. A text with fewer words than
    ``words`` has all of them as its one shingle, one without words has none.
    """
    offsets, codes, distinct = words_of(pc.ascii_lower(texts))
    h = mixed(hash_words(distinct))[codes] if len(codes) else np.zeros(0, np.uint64)
    counts = np.diff(offsets)
    full = np.full(len(h), np.uint64(words))
    length = max(0, len(h) - words + 1)
    for k in range(words):
        full[:length] = full[:length] * STEP + h[k : k + length]
    full = mixed(full)
    sets, sizes = [], np.zeros(len(counts) + 1, np.int64)
    for i, n in enumerate(counts.tolist()):
        start = offsets[i]
        if n >= words:
            found = np.unique(full[start : start + n - words + 1])
        elif n:
            s = np.array([n], np.uint64)
            for k in range(n):
                s = s * STEP + h[start + k]
            found = mixed(s)
        else:
            found = full[:0]
        sets.append(found)
        sizes[i + 1] = len(found)
    return np.cumsum(sizes), np.concatenate(sets) if sets else full[:0]


def _prefixes(words: int, percent: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        counts = table.value
        usual = max(1.0, float(np.median(counts)))
        for batch, texts in text_slices(batches, size=SLICE):
            offsets, values = shingle_sets(texts, words)
            n_all = np.diff(offsets)
            seen = counts[(values >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            prefixes, matches, keys = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own, often = values[a:b], seen[a:b]
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                n = int(b - a)
                if not n:
                    prefixes.append(own.view(np.int64))
                    matches.append(1)
                    continue
                need = -(-percent * n // 100)
                order = np.lexsort((own, often))
                met = np.maximum(often[order[: n - need + 1]] - 2 * usual, 0).sum()
                m = 1 if met <= MANY else 1 + math.ceil(math.log2(met / MANY))
                m = max(1, min(m, MOST_MATCHES, need))
                prefixes.append(own[order[: n - need + m]].view(np.int64))
                matches.append(m)
            lists = pa.array(prefixes, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_all), pa.array(keys, pa.binary()),
                 pa.array(matches, pa.int32()), lists],
                ["doc_id", "n_shingles", "key", "matches", "prefix"],
            )

    return run


SET_BYTES = 6  # of a shingle's hash are compared in a pair of sets
BLOCK_SETS, BLOCK_SHINGLES = 1024, 500_000  # of a block on average, where links are counted
SPARSE = 100  # a shingle held by fewer than one in so many pairs of a block pair is counted pair by pair


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_x"], batch["set_y"], strict=True):
                x = np.frombuffer(x.as_py(), np.uint8).reshape(-1, SET_BYTES)
                y = np.frombuffer(y.as_py(), np.uint8).reshape(-1, SET_BYTES)
                both = len(np.intersect1d(_wide(x), _wide(y), assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _wide(packed: np.ndarray) -> np.ndarray:
    full = np.zeros((len(packed), 8), np.uint8)
    full[:, :SET_BYTES] = packed
    return full.view("<u8").ravel()


def _blocks(batches: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets of a table and all their shingles."""
    sets = batches["set"].to_pylist()
    sizes = np.array([len(x) // SET_BYTES for x in sets], np.int64)
    return sizes, _wide(np.frombuffer(b"".join(sets), np.uint8).reshape(-1, SET_BYTES))


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    """Block: its classes as one row."""
    sizes, values = _blocks(table)
    packed = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]
    return pa.table({
        "group": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()),
        "parts": pa.array([table["parts"][0].as_py()], pa.int64()),
        "keys": pa.array([b"".join(table["key"].to_pylist())], pa.binary()),
        "copies": pa.array([table["class_size"].to_numpy().astype("<i8").tobytes()], pa.binary()),
        "sizes": pa.array([sizes.astype("<i8").tobytes()], pa.binary()),
        "shingles": pa.array([packed.tobytes()], pa.binary()),
    })


def common_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Matrix of the number of shingles that each set on the left shares with each on the right.

    Sets come as their sizes and their values in a row. Shingles of many sets are counted by
    products of 0/1 matrices, the others pair by pair.
    """
    n, k = len(left[0]), len(right[0])
    held, codes = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)
    sides = []
    for (sizes, _), own in zip((left, right), (codes[: len(left[1])], codes[len(left[1]) :]), strict=True):
        rows = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(own, kind="stable")
        sides.append((rows[order], own[order], np.bincount(own, minlength=len(held))))
    met = sides[0][2] * sides[1][2]
    total = np.zeros((n, k), np.float32)
    dense = np.flatnonzero(met * SPARSE >= n * k)
    for start in range(0, len(dense), 1024):
        part = dense[start : start + 1024]
        place = np.full(len(held), -1)
        place[part] = np.arange(len(part))
        both = []
        for (rows, own, _), size in zip(sides, (n, k), strict=True):
            hit = place[own] >= 0
            matrix = np.zeros((size, len(part)), np.float32)
            matrix[rows[hit], place[own[hit]]] = 1
            both.append(matrix)
        total += both[0] @ both[1].T
    sparse = np.flatnonzero((met > 0) & (met * SPARSE < n * k))
    starts = [np.cumsum(side[2]) - side[2] for side in sides]
    ends = np.cumsum(met[sparse])
    flat = total.reshape(-1)
    first = 0
    while first < len(sparse):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + 4_000_000, "right")))
        cells, each = sparse[first:last], met[sparse[first:last]]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        width = np.repeat(sides[1][2][cells], each)
        i = sides[0][0][np.repeat(starts[0][cells], each) + at // width]
        j = sides[1][0][np.repeat(starts[1][cells], each) + at % width]
        flat += np.bincount(i * k + j, minlength=n * k)
        first = last
    return total.astype(np.int64)


def _counted(percent: int):
    """Block pair: (key, linked), the number of documents that each class links with here."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sides = []
        for part in sorted(set(table["part"].to_pylist())):
            at = table["part"].to_pylist().index(part)
            keys = table["keys"][at].as_py()
            copies, sizes = (np.frombuffer(table[c][at].as_py(), "<i8") for c in ("copies", "sizes"))
            values = _wide(np.frombuffer(table["shingles"][at].as_py(), np.uint8).reshape(-1, SET_BYTES))
            sides.append(([keys[i : i + 16] for i in range(0, len(keys), 16)], copies, sizes, values))
        x, y = sides[0], sides[-1]
        both = common_counts(x[2:], y[2:])
        links = 100 * both >= percent * (x[2][:, None] + y[2][None, :] - both)
        if len(sides) == 1:
            np.fill_diagonal(links, False)
        keys, linked = list(x[0]), links @ y[1]
        if len(sides) == 2:
            keys, linked = keys + y[0], np.concatenate([linked, x[1] @ links])
        hit = np.flatnonzero(linked)
        return pa.table({"key": pa.array([keys[i] for i in hit], pa.binary()), "linked": pa.array(linked[hit], pa.int64())})

    return run


class _Links:
    """Verification of candidate pairs against the whole sets of their texts."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent
        self.tables: list[Broadcast] = []

    def sets(self, ids: DataFrame, keyed: bool = False) -> DataFrame:
        """(doc_id, set) of the documents with these ids and of a few others, which joins leave out.

        ``keyed`` adds the key of the class.

        A table of fixed size, broadcast to the scan, keeps most other texts from being shuffled;
        if it fills up on a very large corpus, more texts pass and the join that follows decides.
        """

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for batch in batches:
                yield mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))

        spark = self.docs.sparkSession
        table = spark.sparkContext.broadcast(presence_table(ids, hashed, FILTER_BITS))
        self.tables.append(table)
        words, names = self.words, ["doc_id", "set", "key"] if keyed else ["doc_id", "set"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = table.value
            for batch in batches:
                own = mixed(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                some = batch.filter(pa.array(present(wanted, own, FILTER_BITS)))
                for part, texts in text_slices([some], size=SLICE):
                    offsets, values = shingle_sets(texts, words)
                    packed = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]
                    spans = list(zip(offsets[:-1], offsets[1:], strict=True))
                    columns = [part.column(0), pa.array([packed[a:b].tobytes() for a, b in spans], pa.binary())]
                    if keyed:
                        keys = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in spans]
                        columns.append(pa.array(keys, pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

        texts = self.docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
        return texts.mapInArrow(run, "doc_id long, set binary" + (", key binary" if keyed else ""))

    def close(self) -> None:
        """Drop the tables on driver and executors; what was read with them has been written."""
        for table in self.tables:
            table.destroy()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose documents link, written to the shared folder."""
        pairs = cut(pairs.select("a", "b"), "pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        x = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_x"))
        y = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_y"))
        met = pairs.join(x, "a").join(y, "b").select("a", "b", "set_x", "set_y")
        # Repeated rows of a document verify a pair again.
        return cut(met.mapInArrow(_verified(self.percent), "a long, b long").distinct(), "links")

    def counts(self, classes: DataFrame) -> DataFrame:
        """(key, linked): how many documents of other classes each class links with; none, no row.

        ``classes`` (key, rep, class_size, n_shingles, component). Links lie inside components, so
        small components share a block and large ones are cut into blocks that all meet.
        """
        sizes = classes.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")).where("n > 1")
        needs = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("long")
        members = cut(classes.join(sizes.withColumn("parts", needs).drop("n", "w"), "component"), "members")
        few = members.where("parts = 1").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")).first()
        buckets = 1 + 2 * max(few["n"] // BLOCK_SETS, (few["w"] or 0) // BLOCK_SHINGLES)
        # A group of small components has its hash as number and one part, -1; a large component its id.
        small = F.col("parts") == 1
        members = members.withColumns({
            "group": F.when(small, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component")),
            "part": F.when(small, F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("key"), F.col("parts"))),
        })
        sets = self.sets(members.select(F.col("rep").alias("id")).distinct(), keyed=True)
        sets = sets.withColumnRenamed("doc_id", "rep")
        full = members.join(sets, ["rep", "key"]).groupBy("key").agg(
            *[F.first(c).alias(c) for c in ("group", "part", "parts", "class_size", "set")]
        )
        blocks = cut(
            full.select("group", "part", "parts", "key", "class_size", "set").groupBy("group", "part").applyInArrow(
                _packed, "group long, part long, parts long, keys binary, copies binary, sizes binary, shingles binary"
            ),
            "blocks",
        )
        others = F.when(F.col("part") < 0, F.array("part")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        met = blocks.withColumn("o", F.explode(others))
        met = met.withColumns({"left": F.least("part", "o"), "right": F.greatest("part", "o")}).drop("o", "parts")
        found = met.groupBy("group", "left", "right").applyInArrow(_counted(self.percent), "key binary, linked long")
        return cut(found.groupBy("key").agg(F.sum("linked").alias("linked")), "counts")


def _sized(pairs: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """Pairs that their sizes allow and that share enough prefix shingles.

    Two sets of sizes n and k link if they share ``percent (n + k) / (100 + percent)``. What one of
    them has after its prefix can be common as well; all else must be shared in the prefixes. So
    longer prefixes ask for more, and pairs that share a rare passage by chance fall here.
    """

    def side(name: str) -> DataFrame:
        need = F.floor((F.lit(percent) * F.col("n_shingles") + 99) / 100)
        return meta.select(
            F.col("rep").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("matches").alias(f"m_{name}"),
            (need - F.col("matches")).alias(f"rest_{name}"),
        )

    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    common = _common(F.col("n_a"), F.col("n_b"), percent)
    asked = F.greatest(F.least("m_a", "m_b").cast("long"), common - F.greatest("rest_a", "rest_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fits & (F.col("shared") >= asked))


def _common(n: Column, k: Column, percent: int) -> Column:
    """Shingles that linked sets of these sizes share at least."""
    return F.ceil((F.lit(percent) * (n + k)) / (100 + percent))


def _across(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may link, from (token, rep, n, place, component).

    All prefixes are in one order of shingles. From the first common shingle on, either set must
    still hold all that the two have to share, so its place in a set of size n is at most n less
    that number. The smallest set that holds the shingle tells which rows can fit no partner.
    """
    n, place, percents = F.col("n"), F.col("place"), F.lit(percent)
    open_ = placed.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least_n")
    )
    partner = F.greatest(F.col("least_n"), F.ceil(percents * n / 100))
    fitting = placed.join(open_.where("lo < hi").drop("lo", "hi"), "token").where(place <= n - _common(n, partner, percent))
    fitting = cut(fitting.drop("least_n"), "open")
    other = fitting.select(
        "token", F.col("rep").alias("r"), F.col("component").alias("c"), F.col("n").alias("k"), F.col("place").alias("p")
    )
    k, asked = F.col("k"), _common(F.col("n"), F.col("k"), percent)
    sizes = 100 * F.least(n, k) >= percents * F.greatest(n, k)
    places = (place <= n - asked) & (F.col("p") <= k - asked)
    met = fitting.join(other, "token").where((F.col("component") < F.col("c")) & sizes & places)
    return met.select(F.least("rep", "r").alias("a"), F.greatest("rep", "r").alias("b")).distinct()


def _shared(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs with the number of shingles that their prefixes have in common; the most over texts of an id."""
    x = firsts.select(F.col("rep").alias("a"), F.col("prefix").alias("prefix_a"))
    y = firsts.select(F.col("rep").alias("b"), F.col("prefix").alias("prefix_b"))
    both = F.size(F.array_intersect("prefix_a", "prefix_b")).cast("long")
    return pairs.join(x, "a").join(y, "b").groupBy("a", "b").agg(F.max(both).alias("shared"))


def _stars(known: DataFrame) -> DataFrame:
    """Components (id, component) as edges (a, b)."""
    return known.select(F.col("id").alias("a"), F.col("component").alias("b"))


def link(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, class_size, n_links, component_id), one row for each row of ``docs``.

    Documents link when 100 * intersection >= ``percent`` * union of their sets of shingles.
    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable.
    ``n_links`` is the number of other rows that a row links with, those with the same set included.
    Null and empty texts and texts without words have no shingles and link with nothing. Repeated
    rows of a document give repeated rows. Rows with a null id are their own, unlinked class.
    Other columns are ignored. Only ``doc_id`` and ``text`` are read.
    """
    return _linked(docs, words, percent, counted=True)


def _linked(docs: DataFrame, words: int, percent: int, counted: bool) -> DataFrame:
    """The result of ``link``; without ``n_links`` unless they are to be counted."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        kept(None)
        for _, texts in text_slices(batches, size=SLICE):
            yield shingle_sets(texts, words)[1]

    table = spark.sparkContext.broadcast(counting_table(rows.select("text"), hashes, TABLE_BITS))
    found = cut(
        rows.mapInArrow(
            _prefixes(words, percent, table),
            "doc_id long, n_shingles long, key binary, matches int, prefix array<long>",
        ),
        "prefixes",
    )
    table.destroy()
    full = found.where("n_shingles > 0 and doc_id is not null")
    classes = cut(
        full.groupBy("key").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("class_size"),
            F.first("n_shingles").alias("n_shingles"), F.first("matches").alias("matches"),
        ),
        "classes",
    )
    meta = classes.select("rep", "n_shingles", "matches")
    firsts = full.select("doc_id", "key", "n_shingles", "prefix").join(
        classes.select(F.col("rep").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi"
    ).withColumnRenamed("doc_id", "rep")
    tokens = firsts.select("rep", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("place", "token"))
    common = tokens.groupBy("token").agg(F.min("rep").alias("first"), F.max("rep").alias("last"))
    # Shingles of one class only are dropped here; what is left concerns near copies.
    tokens = cut(tokens.join(common.where("first < last"), "token"), "tokens")

    links = _Links(rows, words, percent)
    known = None
    for leader in ("first", "last"):
        pairs = tokens.where(F.col("rep") != F.col(leader)).select(
            F.least("rep", leader).alias("a"), F.greatest("rep", leader).alias("b")
        )
        if known is not None:
            pairs = pairs.join(known.select(F.col("id").alias("a"), F.col("component").alias("c_a")), "a", "left")
            pairs = pairs.join(known.select(F.col("id").alias("b"), F.col("component").alias("c_b")), "b", "left")
            pairs = pairs.where("coalesce(c_a, a) <> coalesce(c_b, b)")
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
        new = links.verified(_sized(pairs, meta, percent))
        # What is connected already goes on as stars, so that a round starts from few edges.
        known = components(new if known is None else _stars(known).union(new))

    placed = tokens.join(known.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    pairs = cut(_across(placed, percent), "across")
    new = links.verified(_sized(_shared(pairs, firsts), meta, percent))
    final = components(_stars(known).union(new)).withColumnRenamed("id", "rep")
    classes = classes.join(final, "rep", "left")
    classes = classes.withColumn("component", F.coalesce("component", "rep"))
    counts = []
    if counted:
        # Different texts of one id have one component, also where nothing else is in it.
        linked = links.counts(classes.select("key", "rep", "class_size", "n_shingles", "component"))
        classes = classes.join(linked, "key", "left")
        n_links = F.col("class_size") - 1 + F.coalesce("linked", F.lit(0))
        counts = [n_links.cast("long").alias("n_links")]
    links.close()
    of_class = classes.select(
        "key", F.col("rep").alias("class_id"), "class_size", *counts, F.col("component").alias("component_id"),
    )
    # One class may hold a third of all rows, so both sides are spread over salts.
    salts = 16
    salted = of_class.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    members = found.select("doc_id", "n_shingles", "key", F.pmod(F.hash("doc_id"), F.lit(salts)).alias("salt"))
    real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    members = members.withColumn("key", F.when(real, F.col("key")))
    out = members.join(salted, ["key", "salt"], "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        *[F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links") for _ in counts],
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component of texts the row with the smallest id.

    Rows are told apart by themselves, not by id: where an id repeats, each of its rows is a node of
    the components, so a text that is like no other stays, whatever other texts share its id. Equal
    ids are decided by the smaller text, equal rows keep any one. Rows with a null id are all kept,
    as are rows without words. An empty table gives an empty table; other columns may have any names.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        linked = cut(_linked(docs, words, percent, counted=False), "linked")
        gone = linked.where("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    row = unused("row", docs.columns)
    numbered = cut(known.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(row).alias("doc_id"), "text")
    linked = cut(_linked(rows, words, percent, counted=False), "linked")
    linked = linked.select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct("doc_id", "text", row)).alias("first")
    best = numbered.select("doc_id", "text", row).join(linked, row).groupBy("component_id").agg(first)
    chosen = numbered.join(best.select(F.col("first")[row].alias(row)), row, "left_semi")
    return chosen.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))

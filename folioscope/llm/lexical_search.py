"""Ranked lexical search by presence masks.

One pass over the documents keeps what the items ask for: for blocks of documents, the terms of the
items that each document holds, how often, and its length. Counts over all blocks give the weights.

In a block, every term is a bitmap over the documents. For an item, the bitmaps of its terms are
turned round into one mask a document, which says which terms it holds, and documents of equal masks
form a group. No document of a group can score more than its mask: the sum, over the mask's terms, of
the term's weight times the most that any document of the block gets for the term. Masks are
evaluated by descending maximum until it is below the score that the best documents so far guarantee;
documents without one of the terms that such a score needs are never given a mask.

A first search of every sixteenth block (by hash) gives each item a score that its last place will
have at least. It leaves the results as they are, but blocks then send only documents that matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import text_slices, words_of
from folioscope.session import cut

TILE_TERMS = 200_000  # distinct (item, term) pairs that are searched for together
BLOCK_DOCS = 16_384
SEED_EVERY = 16  # blocks, of which one is searched first
ITEM_SCHEMA = "item long, term string"
BLOCK_SCHEMA = "block long, n_docs long, n_terms long, ids binary, nulls binary, lengths binary, ends binary, terms binary, counts binary, dfs binary"
HIT_SCHEMA = "item long, doc_id long, score long"

# Bytes of a term become themselves, A-Z in lower case; all other bytes below 128 become spaces.
TERM_BYTES = bytes(
    b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Term offsets by text, the code of each term, and the distinct terms; no nulls in ``texts``."""
    strings = texts.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    own = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    lowered = data.slice(own[0], own[-1] - own[0]).to_pybytes().translate(TERM_BYTES) if data else b""
    buffers = [None, pa.py_buffer(own - own[0]), pa.py_buffer(lowered)]
    return words_of(pa.Array.from_buffers(pa.large_string(), len(strings), buffers, 0))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows of the same id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            offsets, codes, distinct = terms_of(texts)
            rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), distinct.cast(pa.string()).take(pa.array(codes))], ["item_id", "term"]
            )

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id long, term string").distinct()


@dataclass
class Block:
    """Documents of a block: ids, lengths, and the terms of the items that each holds."""

    ids: np.ndarray
    nulls: np.ndarray
    lengths: np.ndarray
    ends: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


def postings(docs: DataFrame, vocabulary: pa.Array, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of at most ``block_docs`` documents with the terms in ``vocabulary`` that they hold.

    ``n_docs`` counts documents with a term of any kind and ``n_terms`` all their terms, ``dfs``
    holds (term, documents) pairs of the block. Documents without one of the terms are only counted.
    """

    def pack(number: int, parts: list[tuple], n_docs: int, n_terms: int) -> pa.RecordBatch:
        ids, nulls, lengths, sizes, terms, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
        df = np.bincount(terms, minlength=len(vocabulary))
        held = np.flatnonzero(df)
        fields = [ids, nulls, lengths, np.cumsum(sizes), terms, counts, np.stack([held, df[held]])]
        kinds = ["<i8", "u1", "<i8", "<i8", "<i4", "<i4", "<i8"]
        binary = [pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(fields, kinds, strict=True)]
        head = [pa.array([x], pa.int64()) for x in (number, n_docs, n_terms)]
        return pa.RecordBatch.from_arrays(head + binary, [f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        number, held, n_docs, n_terms, parts = 0, 0, 0, 0, []
        for batch, texts in text_slices(batches):
            offsets, codes, distinct = terms_of(texts)
            each = np.diff(offsets)
            n_docs += int((each > 0).sum())
            n_terms += int(each.sum())
            known = pc.fill_null(pc.index_in(distinct.cast(pa.string()), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            found = known[codes] if len(codes) else codes
            keys = np.repeat(np.arange(len(each)), each)[found >= 0] * len(vocabulary) + found[found >= 0]
            pairs, counts = np.unique(keys, return_counts=True)
            rows, terms = np.divmod(pairs, max(1, len(vocabulary)))
            own, sizes = np.unique(rows, return_counts=True)
            id_column = batch.column(0).take(pa.array(own))
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            for start in range(0, len(own), block_docs):
                stop = min(start + block_docs, len(own))
                a, b = cuts[start], cuts[stop]
                ids = id_column.slice(start, stop - start)
                parts.append((
                    ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                    each[own[start:stop]], sizes[start:stop], terms[a:b], counts[a:b],
                ))
                held += stop - start
                if held >= block_docs:
                    yield pack(first + number, parts, n_docs, n_terms)
                    number, held, n_docs, n_terms, parts = number + 1, 0, 0, 0, []
        if parts or n_docs:
            none = np.zeros(0, np.int64)
            yield pack(first + number, parts or [(none,) * 6], n_docs, n_terms)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, BLOCK_SCHEMA)


def opened(batch: pa.RecordBatch) -> Iterator[tuple[Block, np.ndarray]]:
    """The blocks of a batch and their (term, documents) pairs."""
    kinds = {"ids": "<i8", "nulls": "u1", "lengths": "<i8", "ends": "<i8", "terms": "<i4", "counts": "<i4", "dfs": "<i8"}
    for i in range(batch.num_rows):
        x = {name: np.frombuffer(batch[name][i].as_buffer(), kind) for name, kind in kinds.items()}
        dfs = x.pop("dfs").reshape(2, -1)
        yield Block(**x), dfs


def document_counts(blocks: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents that hold each term."""
    totals = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for dfs in batch["dfs"]:
                term, df = np.frombuffer(dfs.as_buffer(), "<i8").reshape(2, -1)
                total[term] += df
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    counted = np.zeros(n_terms, np.int64)
    for row in blocks.select("dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        counted[row["term"]] = row["df"]
    return totals["n"] or 0, totals["l"] or 0, counted


def weights_of(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Postings:
    """A block turned round: by term, the documents and their parts of a score, and its bitmap."""

    def __init__(self, block: Block, weights: np.ndarray, n_docs: int, n_terms: int):
        self.size = len(block.ids)
        rows = np.repeat(np.arange(self.size), np.diff(np.concatenate([[0], block.ends])))
        m = 50 + (50 * block.lengths * n_docs) // n_terms
        counts = block.counts.astype(np.int64)
        parts = weights[block.terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[rows]))
        order = np.argsort(block.terms, kind="stable")
        self.terms, starts = np.unique(block.terms[order], return_index=True)
        self.rows, self.parts = rows[order], parts[order]
        self.starts = np.append(starts, len(order))
        self.most = np.maximum.reduceat(self.parts, starts) if len(starts) else self.parts
        self.bits = np.zeros((len(self.terms), -(-self.size // 8)), np.uint8)
        at = np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * self.bits.shape[1]
        # Each bit is set once, so adding sets it.
        np.add.at(self.bits.ravel(), at + (self.rows >> 3), np.uint8(1) << (self.rows & 7).astype(np.uint8))

    def search(self, wanted: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of all documents that score at least ``floor`` and may be among the best ``k``."""
        at = np.searchsorted(self.terms, wanted)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == wanted)] if len(self.terms) else at[:0]
        most = self.most[at]
        at = at[most > 0]
        if not len(at):
            return at, at
        at = at[np.argsort(self.most[at], kind="stable")]
        most = self.most[at]
        # Documents that hold only the first of these terms stay below the floor.
        needed = int(np.searchsorted(np.cumsum(most), max(floor, 1)))
        if needed == len(at):
            return at[:0], at[:0]
        may = np.bitwise_or.reduce(self.bits[at[needed:]], axis=0)
        rows = np.flatnonzero(np.unpackbits(may, count=self.size, bitorder="little"))
        masks = self._masks(at, may, rows)
        groups, member, sizes = np.unique(masks, return_inverse=True, return_counts=True)
        held = np.unpackbits(groups.view(np.uint8).reshape(len(groups), -1), axis=1, count=len(at), bitorder="little")
        bound = held.astype(np.int64) @ most
        best_first = np.argsort(-bound, kind="stable")
        place = np.empty_like(best_first)
        place[best_first] = np.arange(len(best_first))
        order = np.argsort(place[member.ravel()], kind="stable")  # documents by their mask's maximum
        ends, bound = np.cumsum(sizes[best_first]), bound[best_first]
        scores, taken, g, lowest = np.zeros(0, np.int64), 0, 0, floor
        while g < len(ends) and bound[g] >= max(lowest, 1):
            # As many masks as hold the documents still missing, and twice as many each time.
            h = max(g + 1, int(np.searchsorted(ends, max(k, 2 * taken), "left")) + 1)
            h = max(g + 1, min(h, int(np.searchsorted(-bound, -max(lowest, 1), "right"))))
            scores = np.concatenate([scores, self._scores(at, rows[order[taken : ends[h - 1]]])])
            taken, g = int(ends[h - 1]), h
            if taken >= k:
                lowest = max(floor, int(np.partition(scores, taken - k)[taken - k]))
        good = scores >= max(lowest, 1)
        return rows[order[:taken]][good], scores[good]

    def _masks(self, at: np.ndarray, may: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each of ``rows`` the bits of the terms ``at`` that it holds, as one opaque value."""
        cells = np.flatnonzero(may)  # bytes of the bitmaps that have a document
        bits = np.unpackbits(self.bits[at][:, cells], axis=1, bitorder="little")
        column = np.searchsorted(cells, rows >> 3) * 8 + (rows & 7)
        masks = np.packbits(bits[:, column], axis=0, bitorder="little")
        width = 8 * -(-len(masks) // 8)
        wide = np.zeros((len(rows), width), np.uint8)
        wide[:, : len(masks)] = masks.T
        return wide.view(np.uint64).ravel() if width == 8 else wide.view(f"V{width}").ravel()

    def _scores(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        place = np.full(self.size, -1, np.int64)
        place[rows] = np.arange(len(rows))
        total = np.zeros(len(rows), np.int64)
        for t in at:
            own = slice(self.starts[t], self.starts[t + 1])
            to = place[self.rows[own]]
            asked = to >= 0
            total[to[asked]] += self.parts[own][asked]
        return total


def best_of(
    blocks: DataFrame, items: dict[int, np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int,
    floors: dict[int, int] | None = None,
) -> DataFrame:
    """(item, doc_id, score): of each block, what may be among an item's best ``k`` of all blocks."""
    told = blocks.sparkSession.sparkContext.broadcast((items, weights, floors or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, floors = told.value
        lowest = dict(floors)
        for batch in batches:
            for block, _ in opened(batch):
                inverted = Postings(block, weights, n_docs, n_terms)
                found = []
                for item, wanted in items.items():
                    rows, scores = inverted.search(wanted, k, lowest.get(item, 0))
                    if len(rows) > k:
                        # Of equal scores the smaller id, null last.
                        order = np.lexsort((block.ids[rows], block.nulls[rows], -scores))[:k]
                        rows, scores = rows[order], scores[order]
                    if len(rows) >= k:
                        lowest[item] = max(lowest.get(item, 0), int(scores.min()))
                    found.append((np.full(len(rows), item), rows, scores))
                item, rows, scores = (np.concatenate(c) for c in zip(*found, strict=True))
                doc = pa.array(block.ids[rows], mask=block.nulls[rows].astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(item), doc, pa.array(scores)], ["item", "doc_id", "score"])

    return blocks.mapInArrow(run, HIT_SCHEMA)


def search(docs: DataFrame, items: DataFrame, k: int = 50, tile_terms: int = TILE_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, scores above 0 only.

    Every row of ``docs`` is a document of its own; one without text has no terms. Equal scores are
    ranked by ascending doc_id, null last. Rows of one item_id (null is one too) are one item with
    all their terms; an item without terms, and an empty table, give no rows. Other columns are not
    read. Items are searched for in tiles of about ``tile_terms`` terms: a tile's terms are what the
    driver and the tasks hold, so the bound is on them whatever the number of items.
    """
    spark = docs.sparkSession
    asked = cut(item_terms(items), "terms")
    sizes = asked.groupBy("item_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tiles = -(-total // tile_terms)
    parts = []
    for tile in range(tiles):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(tiles)) == tile)
        parts.append(_search_tile(docs, own, k))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _search_tile(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    table = asked.select("item_id", "term").toArrow()
    coded = pc.dictionary_encode(table["term"].combine_chunks())
    numbers = pc.dictionary_encode(table["item_id"].combine_chunks(), null_encoding="encode")
    item, terms = numbers.indices.to_numpy(), coded.indices.to_numpy()
    order = np.lexsort((terms, item))
    cuts = np.flatnonzero(np.diff(item[order])) + 1
    wanted = {int(item[part[0]]): terms[part].astype(np.int32) for part in np.split(order, cuts) if len(part)}
    blocks = cut(postings(docs, coded.dictionary), "postings")
    n_docs, n_terms, df = document_counts(blocks, len(coded.dictionary))
    weights = weights_of(n_docs, df)
    if not n_terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    some = blocks.where(F.pmod(F.xxhash64("block"), F.lit(SEED_EVERY)) == 0)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    first = best_of(some, wanted, weights, n_docs, n_terms, k)
    last = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("item", "score")
    floors = {r["item"]: r["score"] for r in last.collect()}
    found = best_of(blocks, wanted, weights, n_docs, n_terms, k, floors)
    names = spark.createDataFrame(
        pa.table({"item": pa.array(range(len(numbers.dictionary)), pa.int64()), "item_id": numbers.dictionary})
    )
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

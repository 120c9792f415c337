"""Arrow batches of bounded size, words of texts, bounded tables of hashes, label samples, what workers keep."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 6_000_000  # of text looked at together in a task
CHUNKS = 64  # rows that a counting table is shipped in
BATCH_ROWS = "1000"  # rows that Spark hands to a Python worker at once, where the session has its default
_kept: dict[str, object] = {}
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # multipliers of the finishing step of splitmix64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lean_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches of whole texts and sets be small, unless the session's owner chose a size."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, BATCH_ROWS)
    return spark


def kept(key: str | None, build: Callable[[], object] | None = None) -> object:
    """What this Python worker keeps from task to task under ``key``; anything kept under another key goes.

    Workers serve one stage after the other, so what an earlier operator kept would stay for good.
    """
    if key not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        if key is not None:
            _kept[key] = build()
    return _kept.get(key)


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, or ``name`` with underscores, that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def remainder(key: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batches with at most ``size`` bytes of text (or one row), and their texts.

    Null texts come as empty ones.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: offsets by text, code of each word, the distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def counting_table(
    df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int
) -> np.ndarray:
    """How many of the hashes of all rows fall into each of ``2 ** bits`` cells.

    Each task sends one table of that fixed size, in chunks; chunks are added up one by one, and
    the driver receives the sum, whose size depends on ``bits`` only. Counts stop at 2^31 - 1.
    """
    width = (1 << bits) // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for part in hashes(batches):
            cells = (part >> np.uint64(64 - bits)).astype(np.int64)
            if len(cells) * 8 > len(total):
                total += np.bincount(cells, minlength=len(total))
            else:
                np.add.at(total, cells, 1)
        rows = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(CHUNKS, width)
        for i in np.flatnonzero(rows.any(axis=1)):
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([i], pa.int32()), "counts": pa.array([rows[i].tobytes()], pa.binary())}
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                part = np.frombuffer(counts, np.int32).astype(np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        for chunk, total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([chunk], pa.int32()),
                 "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())}
            )

    schema = "chunk int, counts binary"
    parts = df.mapInArrow(count, schema).repartition(CHUNKS, "chunk").mapInArrow(add, schema)
    table = np.zeros((CHUNKS, width), np.int32)
    for row in parts.collect():
        table[row["chunk"]] = np.frombuffer(row["counts"], np.int32)
    return table.ravel()


def presence_table(
    df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int
) -> np.ndarray:
    """Which of ``2 ** bits`` cells the hashes of all rows fall into, one bit a cell.

    As with ``counting_table``, tasks send tables of fixed size in chunks and the driver gets one.
    """
    width = (1 << bits) // CHUNKS // 8
    schema = "chunk int, cells binary"

    def rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in np.flatnonzero(table.any(axis=1)):
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([i], pa.int32()), "cells": pa.array([table[i].tobytes()], pa.binary())}
            )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for part in hashes(batches):
            seen[(part >> np.uint64(64 - bits)).astype(np.int64)] = True
        yield from rows(np.packbits(seen, bitorder="little").reshape(CHUNKS, width))

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((CHUNKS, width), np.uint8)
        for batch in batches:
            for chunk, cells in zip(batch["chunk"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                table[chunk] |= np.frombuffer(cells, np.uint8)
        yield from rows(table)

    table = np.zeros((CHUNKS, width), np.uint8)
    for row in df.mapInArrow(mark, schema).repartition(CHUNKS, "chunk").mapInArrow(either, schema).collect():
        table[row["chunk"]] |= np.frombuffer(row["cells"], np.uint8)
    return table.ravel()


def present(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of the hashes fall into a cell that ``presence_table`` marked."""
    cell = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, fold: int, bound: int, chars: int
) -> list[tuple[str, int]]:
    """At most ``bound`` labelled texts outside the held-out fold, in an order set by their ids.

    Training reads at most ``chars`` characters of a text: its head, and a window from its middle
    and its end. Ids with two different labels take the larger one, ids with several texts the least.
    """
    marked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != fold))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    third = chars // 3
    text, n = F.coalesce("text", F.lit("")), F.length("text")
    shown = F.when(n <= chars, text).otherwise(
        F.concat(F.substring(text, 1, third), F.lit("\n"), text.substr((n / 2).cast("int"), F.lit(third)),
                 F.lit("\n"), text.substr(n - third + 1, F.lit(third)))
    )
    rows = docs.select("doc_id", shown.alias("text")).join(F.broadcast(marked), "doc_id")
    # One text an id, so that an id of very many rows brings one.
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy("doc_id")
    table = rows.select("text", "y").toArrow()
    return list(zip(table["text"].to_pylist(), table["y"].to_pylist(), strict=True))

"""Vector columns as numpy matrices, and sums of matrix functions over a table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

MERGE_TASKS = 16


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column of equally long vectors as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def list_column(rows: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Matrix as a list column."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind or pa.float64()))


def sum_over(
    df: DataFrame, column: str, fn: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray | None:
    """Sum of ``fn(vectors)``, a vector of fixed length, over all rows; None without rows.

    Every task reduces its rows to one vector, a few tasks add those up, and the driver adds the
    last few; what it receives does not depend on the number of rows or tasks.
    """

    def reduce(batches: Iterator[pa.RecordBatch], f: Callable) -> Iterator[pa.RecordBatch]:
        parts = (f(matrix(batch.column(0))) for batch in batches if batch.num_rows)
        total = None
        for part in parts:
            total = part if total is None else total + part
        if total is not None:
            task = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([list_column(total[None, :]), task], ["total", "task"])

    schema = "total array<double>, task int"
    partial = df.select(column).mapInArrow(lambda b: reduce(b, fn), schema)
    # Adding up in task order makes the result the same in every run.
    ordered = partial.repartition(MERGE_TASKS, "task").sortWithinPartitions("task")
    merged = ordered.mapInArrow(lambda b: reduce(b, lambda m: m.sum(axis=0)), schema)
    totals = [r["total"] for r in sorted(merged.collect(), key=lambda r: r["task"])]
    return np.sum(totals, axis=0) if totals else None


def moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and covariance of a vector column."""

    def sums(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    total = sum_over(df, column, sums)
    if total is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    dim = math.isqrt(len(total) - 1)  # there are 1 + dim + dim^2 numbers
    mean = total[1 : dim + 1] / total[0]
    second = total[dim + 1 :].reshape(dim, dim) / total[0]
    return int(total[0]), mean, second - np.outer(mean, mean)


def principal_axes(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their axes (rows); largest loading positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    axes = vectors[:, order].T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return values[order], axes * np.where(signs == 0, 1.0, signs)[:, None]


def coordinates(column: Column | str, mean: np.ndarray, axes: np.ndarray) -> Column:
    """Coordinates on the given axes (rows) of vectors without nulls."""

    @arrow_udf("array<double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield list_column((matrix(part) - mean) @ axes.T if len(part) else axes[:0])

    return run(column)


def cosine_to(query: Sequence[float], column: Column | str) -> Column:
    """Cosine similarity to a constant vector of vectors without nulls; null for a zero vector.

    On vectors this is several times faster than the built-in array functions, which are
    interpreted element by element. Sums run row by row, so equal vectors score the same.
    """
    q = np.asarray(query, dtype=np.float64)
    q = q / np.linalg.norm(q) if q.any() else q

    @arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            x = matrix(part) if len(part) else np.zeros((0, len(q)))
            lengths = np.sqrt((x * x).sum(axis=1))
            dots = (x * q).sum(axis=1)
            none = (lengths == 0) | (not q.any())
            yield pa.array(dots / np.where(none, 1.0, lengths), mask=none)

    return run(column)

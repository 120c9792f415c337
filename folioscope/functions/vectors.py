"""Expressions over vectors held as arrays. Arithmetic is done in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vector(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(
        _c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of the angle between two vectors; null when one of them is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance."""
    squares = F.zip_with(
        _c(a),
        _c(b),
        lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
    )
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, p: total + p))


def normalise(a: Column | str) -> Column:
    """Vector of length one as floats, so that a later cosine is a dot product."""
    a = _c(a)
    length = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), length).cast("float"))


def dominant_topic(weights: Column | str) -> Column:
    """Index of the largest weight, the first one on ties."""
    w = _c(weights)
    return (F.array_position(w, F.array_max(w)) - 1).cast("int")


def round_all(values: Column | str, digits: int = 4) -> Column:
    return F.transform(_c(values), lambda x: F.round(x.cast("double"), digits))

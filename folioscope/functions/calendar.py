"""Year-month arithmetic on string keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ym(year: Column | str = "year", month: Column | str = "month") -> Column:
    """``YYYY-MM`` key."""
    return F.concat_ws("-", _c(year), _c(month))


def months_back(now: str, n: int) -> str:
    """Year-month ``n`` months before ``now`` (``YYYY-MM``)."""
    year, month = (int(p) for p in now.split("-"))
    index = year * 12 + month - 1 - n
    return f"{index // 12:04d}-{index % 12 + 1:02d}"


def months_of_year(year: str, now: str) -> list[str]:
    """Months to offer for a year: up to ``now`` in the current year, else all twelve."""
    last = int(now[5:7]) if year == now[:4] else 12
    return [f"{m:02d}" for m in range(1, last + 1)]


def not_after(now: str, year: Column | str = "year", month: Column | str = "month") -> Column:
    """Partition predicate: the month is not later than ``now``."""
    y, m = now.split("-")
    return (_c(year) < y) | ((_c(year) == y) & (_c(month) <= m))


def not_before(first: str, year: Column | str = "year", month: Column | str = "month") -> Column:
    """Partition predicate: the month is not earlier than ``first``."""
    y, m = first.split("-")
    return (_c(year) > y) | ((_c(year) == y) & (_c(month) >= m))

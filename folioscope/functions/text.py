"""Expressions over the raw metadata strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data format.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SUBJECT_PATTERN = r"\(([^)]+)\)"
CODE_PATTERN = r"\(([a-z-]+\.[A-Z]+)\)"
LENIENT_DATE_PATTERN = r"(?U)\d{1,2}\s+(\w{3})\s+(\d{4})"
STRICT_DATE_PATTERN = r"(?U)^\s*\S+\s+(\S+)\s+(\S+)\s*$"
TEXT_CHARS = 512
TITLE_CHARS = 100
ABSTRACT_CHARS = 500
AUTHORS_SHOWN = 3


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _group(c: Column, pattern: str, index: int) -> Column:
    """Capture group of the first match; null when there is no match."""
    return F.nullif(F.regexp_extract(c, pattern, index), F.lit(""))


def month_number(name: Column | str) -> Column:
    """``'Jan'`` to ``'01'``; null for anything that is not a month name."""
    pairs = [F.lit(part) for n, m in enumerate(MONTHS, 1) for part in (m, f"{n:02d}")]
    return F.try_element_at(F.create_map(*pairs), _c(name))


def subject_code(primary_subject: Column | str, strict: bool = False) -> Column:
    """Text of the first parenthesised group, or of the last one when ``strict``."""
    pattern = r"(?s)^.*" + SUBJECT_PATTERN if strict else SUBJECT_PATTERN
    return _group(_c(primary_subject), pattern, 1)


def partition_month(submission_date: Column | str) -> Column:
    """Month of a day-month-year date found anywhere in the string."""
    return month_number(_group(_c(submission_date), LENIENT_DATE_PATTERN, 1))


def partition_year(submission_date: Column | str) -> Column:
    """Year of a day-month-year date found anywhere in the string; null without a known month."""
    year = _group(_c(submission_date), LENIENT_DATE_PATTERN, 2)
    return F.when(partition_month(submission_date).isNotNull(), year)


def year_month(submission_date: Column | str) -> Column:
    """``YYYY-MM`` of a string of exactly three tokens; day and year are not checked."""
    c = _c(submission_date)
    month = month_number(_group(c, STRICT_DATE_PATTERN, 1))
    return F.concat(F.regexp_extract(c, STRICT_DATE_PATTERN, 2), F.lit("-"), month)


def subject_codes(subjects: Column | str, pattern: str = CODE_PATTERN) -> Column:
    """Every subject code in the string; null stays null, no match gives an empty array."""
    return F.regexp_extract_all(_c(subjects), F.lit(pattern), F.lit(1))


def embed_text(
    title: Column | str = "title",
    abstract: Column | str = "abstract",
    chars: int | None = TEXT_CHARS,
) -> Column:
    """Text that stands for a paper; ``chars=None`` takes it whole."""
    text = F.concat(_c(title), F.lit(" "), _c(abstract))
    return text if chars is None else F.substring(text, 1, chars)


def shorten(c: Column | str, chars: int) -> Column:
    """Text for display, with an ellipsis where it was cut."""
    c = _c(c)
    cut = F.concat(F.substring(c, 1, chars), F.lit("..."))
    return F.when(F.length(c) > chars, cut).otherwise(c)


def subject_group(code: Column | str) -> Column:
    """Part before the first dot; the whole code when no dot follows a character."""
    c = _c(code)
    return F.when(F.instr(c, ".") > 1, F.substring_index(c, ".", 1)).otherwise(c)


def terms(text: Column | str) -> Column:
    """Distinct lower-case words of two or more letters or digits."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.array_distinct(words)

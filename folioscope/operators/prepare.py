"""From raw metadata to keyed papers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.schemas import KEYS


def add_keys(raw: DataFrame) -> DataFrame:
    """Add subject, year and month."""
    return raw.withColumns(
        {
            "subject": X.subject_code("primary_subject"),
            "year": X.partition_year("submission_date"),
            "month": X.partition_month("submission_date"),
        }
    )


def drop_unkeyed(df: DataFrame) -> DataFrame:
    """Keep rows whose three keys are known."""
    return df.dropna(subset=list(KEYS))


def prepare(raw: DataFrame) -> DataFrame:
    return drop_unkeyed(add_keys(raw))


def dedupe(
    df: DataFrame, key: str = "arxiv_id", order_by: Sequence[str] = KEYS
) -> DataFrame:
    """One row per key: the first in the given order, rows that are equal there by content.

    ``row_number() = 1`` is pruned inside every map task before the shuffle, so a key that holds
    a large share of all rows sends one row per task.
    """
    order = [F.col(c).asc_nulls_last() for c in order_by if c in df.columns]
    window = Window.partitionBy(key).orderBy(*order, F.xxhash64(*df.columns))
    numbered = df.withColumn("_n", F.row_number().over(window))
    return numbered.where("_n = 1").drop("_n")


def sample_rows(df: DataFrame, n: int, key: str = "arxiv_id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows chosen by a seeded hash of the key; 0 keeps all rows.

    Rows are compared by hash. A histogram of the first four hex digits tells in which of the
    65,536 bands the n-th row lies: lower bands are kept by a plain filter, and only that one
    band is sorted.
    """
    if n <= 0:
        return df
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    hashed = df.withColumn("_h", digest).withColumn("_band", F.substring("_h", 1, 4))
    bands = hashed.groupBy("_band").count().orderBy("_band").collect()  # at most 65,536 rows
    before = 0
    for band, count in bands:
        if before + count >= n:
            break
        before += count
    else:
        return df
    whole = hashed.where(F.col("_band") < band)
    rest = hashed.where(F.col("_band") == band).orderBy("_h", key).limit(n - before)
    return whole.unionByName(rest).drop("_h", "_band")


def hash_sample(df: DataFrame, key: str, total: int, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` of ``total`` rows, never more, chosen by a seeded hash of the key.

    For planning on a bounded part of the data. A filter on the hash comes first, so that the
    final sort sees little more than ``n`` rows from all tasks together.
    """
    if total <= n:
        return df
    bound = min(1.0, 1.1 * n / total)
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))
    chosen = df.where(place < int(bound * (1 << 40)))
    return chosen.orderBy(place, key).limit(n)


def subject_codes_column(df: DataFrame, category: str = "subject") -> DataFrame:
    """Add ``subject_codes``; without a ``subjects`` column it is the category alone."""
    if "subjects" in df.columns:
        return df.withColumn("subject_codes", X.subject_codes("subjects"))
    return df.withColumn("subject_codes", F.array(category))


def paper_projection(df: DataFrame, chars: int | None = X.TEXT_CHARS) -> DataFrame:
    """Columns the embedding step reads; ``chars=None`` keeps the text whole."""
    coded = subject_codes_column(df)
    keys = [k for k in KEYS if k in df.columns]
    return coded.select(
        "arxiv_id",
        "title",
        "authors",
        "submission_date",
        "primary_subject",
        "subject_codes",
        "abstract",
        X.embed_text(chars=chars).alias("text"),
        *keys,
    )

"""Is a stored layout or topic result still good for a selection?"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import calendar as C
from folioscope.schemas import KEYS

KEY_LENGTH = 12  # fixed value: hex digits of a stored key


def _json_list(values: Column) -> Column:
    quoted = F.transform(values, lambda v: F.to_json(F.array(v)))
    bare = F.transform(quoted, lambda q: F.substr(q, F.lit(2), F.length(q) - 2))
    return F.concat(F.lit("["), F.array_join(bare, ", "), F.lit("]"))


def _key(text: Column) -> Column:
    return F.substring(F.md5(text), 1, KEY_LENGTH)


def selection_key(categories: Column, year_months: Column) -> Column:
    """Key of a selection, independent of the order in which it was made.

    Digest of the JSON object ``{"categories": [...], "year_months": [...]}`` with sorted lists.
    """
    return _key(
        F.concat(
            F.lit('{"categories": '),
            _json_list(F.array_sort(categories)),
            F.lit(', "year_months": '),
            _json_list(F.array_sort(year_months)),
            F.lit("}"),
        )
    )


def topics_key(n_components: Column, year_months: Column, categories: Column) -> Column:
    """Key of a topic request; a null list stands for no filter."""

    def listed(values: Column) -> Column:
        return F.coalesce(_json_list(F.array_sort(values)), F.lit("null"))

    return _key(
        F.concat(
            F.lit('{"cat": '),
            listed(categories),
            F.lit(', "n": '),
            n_components.cast("string"),
            F.lit(', "ym": '),
            listed(year_months),
            F.lit("}"),
        )
    )


def selection_hash(selections: DataFrame, by: str | Sequence[str] = "selection_id") -> DataFrame:
    """Key of each selection in a (selection, subject, year, month) table.

    The two sets are at most as long as the lists of codes and of months.
    """
    by = [by] if isinstance(by, str) else list(by)
    sets = selections.groupBy(*by).agg(
        F.collect_set("subject").alias("categories"),
        F.collect_set(C.ym()).alias("year_months"),
    )
    return sets.select(*by, selection_key(F.col("categories"), F.col("year_months")).alias("key"))


def layout_cache_valid(
    selections: DataFrame,
    manifest: DataFrame,
    layouts: DataFrame,
    by: str = "selection_id",
    ignore_absent: bool = False,
) -> DataFrame:
    """Whether each stored layout may be reused.

    ``layouts`` has (selection, layout_at). It is valid when every partition of the selection is
    embedded and none is newer than the layout. With ``ignore_absent`` partitions that the
    manifest does not list are left out instead.
    """
    known = manifest.select(*KEYS, "embedded", "embedded_at", F.lit(True).alias("present"))
    cells = selections.join(known, list(KEYS), "left")
    if ignore_absent:
        cells = cells.where("present")
    sources = cells.groupBy(by).agg(
        F.min(F.coalesce("embedded", F.lit(False))).alias("complete"),
        F.max(F.when(F.col("embedded"), F.col("embedded_at"))).alias("newest"),
    )
    joined = sources.join(layouts, by, "left")
    valid = F.col("complete") & (F.col("newest") <= F.col("layout_at"))
    return joined.select(by, F.coalesce(valid, F.lit(False)).alias("is_valid"))


def options_key(**options: object) -> str:
    """Key of the method and options a result was made with, independent of their order."""
    listed = json.dumps(options, sort_keys=True, default=str)
    return hashlib.md5(listed.encode()).hexdigest()[:KEY_LENGTH]


def dataset_fingerprint(papers: DataFrame, *by: Column | str, vectors: bool = False) -> DataFrame:
    """Row count and an order-independent digest of the ids, in all or per group.

    Two datasets of equal size but different papers get different fingerprints; with ``vectors``
    so do the same papers with other vectors.
    """
    text = F.col("arxiv_id")
    if vectors:
        text = F.concat_ws(":", text, F.xxhash64("embedding").cast("string"))
    digest = F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(20,0)"))
    return papers.groupBy(*by).agg(
        F.count("*").alias("paper_count"),
        F.coalesce(digest, F.lit(0)).cast("decimal(38,0)").cast("string").alias("fingerprint"),
    )


def topics_cache_valid(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Whether each request (key, paper_count, fingerprint) is answered by a stored result."""
    kept = stored.select(
        "key",
        F.col("paper_count").alias("_n"),
        F.col("fingerprint").alias("_f"),
    )
    same = (F.col("_n") == F.col("paper_count")) & (F.col("_f") == F.col("fingerprint"))
    joined = requests.join(kept, "key", "left")
    return joined.select("key", F.coalesce(same, F.lit(False)).alias("is_valid"))

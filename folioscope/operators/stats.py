"""Statistics and facets of the current dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X

# Readable names of the subject groups.
GROUP_NAMES = {
    "cs": "Computer Science",
    "physics": "Physics",
    "math": "Mathematics",
    "astro-ph": "Astrophysics",
    "quant-ph": "Quantum Physics",
    "cond-mat": "Condensed Matter",
    "stat": "Statistics",
    "econ": "Economics",
    "eess": "Electrical Engineering & Systems Science",
    "q-bio": "Quantitative Biology",
    "q-fin": "Quantitative Finance",
    "gr-qc": "General Relativity & Quantum Cosmology",
    "hep-ex": "High Energy Physics - Experiment",
    "hep-lat": "High Energy Physics - Lattice",
    "hep-ph": "High Energy Physics - Phenomenology",
    "hep-th": "High Energy Physics - Theory",
    "math-ph": "Mathematical Physics",
    "nlin": "Nonlinear Sciences",
    "nucl-ex": "Nuclear Experiment",
    "nucl-th": "Nuclear Theory",
}


def top_subjects(papers: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent subjects; papers without one form a group."""
    counts = papers.groupBy("primary_subject").agg(F.count("*").alias("n_papers"))
    order = (F.col("n_papers").desc(), F.col("primary_subject").asc_nulls_last())
    return counts.orderBy(*order).limit(n)


def month_counts(papers: DataFrame) -> DataFrame:
    """Papers per year-month; a missing or empty month is left out."""
    known = papers.where(F.col("year_month") != "")
    return known.groupBy("year_month").agg(F.count("*").alias("n_papers")).orderBy("year_month")


def totals(papers: DataFrame) -> DataFrame:
    """Row count and column names."""
    names = F.array(*[F.lit(c) for c in papers.columns])
    return papers.agg(F.count("*").alias("total_papers")).withColumn("columns", names)


def load_summary(papers: DataFrame) -> DataFrame:
    """Row count and the sorted year-months of a loaded dataset (months are few)."""
    months = F.array_sort(F.collect_set("year_month"))
    return papers.agg(F.count("*").alias("n_papers"), months.alias("year_months"))


def facet_counts(papers: DataFrame) -> DataFrame:
    """Counts per year-month and per category from one pass over the papers."""
    counted = papers.groupingSets(
        [[F.col("year_month")], [F.col("primary_subject")]],
        F.col("year_month"),
        F.col("primary_subject"),
    ).agg(
        F.count("*").alias("n_papers"),
        F.grouping("year_month").alias("is_category"),
    )
    facet = F.when(F.col("is_category") == 1, "category").otherwise("year_month")
    value = F.when(F.col("is_category") == 1, F.col("primary_subject")).otherwise(
        F.col("year_month")
    )
    named = counted.select(facet.alias("facet"), value.alias("value"), "n_papers")
    return named.where(F.col("value") != "").orderBy("facet", F.desc("n_papers"), "value")


def year_facets(papers: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Months present and months selected per year; without a selection all are selected."""
    months = month_counts(papers).select(
        F.substring("year_month", 1, 4).alias("year"),
        F.substring("year_month", 6, 2).alias("month"),
        "year_month",
        "n_papers",
    )
    chosen = F.lit(True) if selected is None else F.col("year_month").isin(selected)
    return (
        months.groupBy("year")
        .agg(
            F.count("*").alias("months_available"),
            F.count_if(chosen).alias("months_selected"),
            F.sum("n_papers").alias("n_papers"),
            F.array_join(F.array_sort(F.collect_list("month")), ",").alias("months"),
        )
        .orderBy(F.desc("year"))
    )


def topics_status(papers: DataFrame) -> DataFrame:
    """Whether topics can be extracted, and how many."""
    counted = papers.agg(
        F.count("*").alias("paper_count"),
        F.count("embedding").alias("valid_embedding_count"),
    )
    valid = F.col("valid_embedding_count")
    suggested = F.least(F.greatest(F.lit(3), F.floor(valid / 100)), F.lit(15))
    return counted.select(
        (valid > 2).alias("available"),
        "paper_count",
        "valid_embedding_count",
        F.greatest(F.lit(2), valid - 1).cast("long").alias("max_topics"),
        suggested.cast("long").alias("suggested_topics"),
    )


def topic_doc_counts(assignments: DataFrame, n_topics: int) -> DataFrame:
    """Documents per dominant topic, with zero for a topic nobody has."""
    topics = assignments.sparkSession.range(n_topics).select(F.col("id").cast("int").alias("topic_id"))
    counts = assignments.groupBy(F.col("dominant_topic").alias("topic_id")).agg(
        F.count("*").alias("n")
    )
    joined = topics.join(counts, "topic_id", "left")
    return joined.select("topic_id", F.coalesce("n", F.lit(0)).alias("doc_count"))


def group_name(prefix: Column | str) -> Column:
    """Readable name of a subject group; the prefix itself when it has none."""
    prefix = F.col(prefix) if isinstance(prefix, str) else prefix
    pairs = [F.lit(part) for item in GROUP_NAMES.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), prefix), prefix)


def subject_group_rollup(codes: DataFrame) -> DataFrame:
    """(code, name) rows gathered by group prefix; a group holds at most a few dozen codes."""
    grouped = codes.groupBy(X.subject_group("code").alias("prefix")).agg(
        F.count("*").alias("n_codes"),
        F.array_sort(F.collect_list("code")).alias("codes"),
    )
    return grouped.select(
        "prefix",
        group_name("prefix").alias("description"),
        "n_codes",
        F.array_join("codes", ",").alias("codes"),
    ).orderBy("prefix")


def layout_extent(papers: DataFrame) -> DataFrame:
    """Bounding box of the layout."""
    return papers.agg(
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
    )


def scale_layout(papers: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Coordinates scaled linearly into a box as ``x01``, ``y01``.

    The box is a one-row result, read as scalar subqueries.
    """
    extent = layout_extent(papers)

    def scaled(axis: str) -> Column:
        least = extent.select(f"min_{axis}").scalar()
        most = extent.select(f"max_{axis}").scalar()
        share = F.try_divide(F.col(axis) - least, most - least)
        return F.lit(low) + share * F.lit(high - low)

    return papers.withColumns({"x01": scaled("x"), "y01": scaled("y")})

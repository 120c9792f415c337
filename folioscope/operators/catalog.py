"""Operators over the manifest: what exists, what a selection holds, what is to be done.

The manifest has one row per (subject, year, month), so it stays small however many papers
there are. A request grid is a selection of such keys with the position of each in the request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import calendar as C
from folioscope.schemas import KEYS

# Fixed values of the cost model.
BYTES_PER_PAPER = 600
GPU_PAPERS_PER_MINUTE = 40000
CPU_PAPERS_PER_MINUTE = 6700
LAYOUT_MINUTES = 0.37
LAYOUT_PAPERS = 17342
LAYOUT_GROWTH = 0.1


def request_grid(categories: DataFrame, year_months: Sequence[tuple[str, str]]) -> DataFrame:
    """Every category (column ``subject``) in every month, with the month's place in the request."""
    months = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(y).alias("year"), F.lit(m).alias("month"))
            for i, (y, m) in enumerate(year_months)
        ]
    )
    cells = categories.select("subject").distinct().select("subject", F.explode(months).alias("m"))
    return cells.select("subject", "m.year", "m.month", "m.pos")


def default_months(now: str, year: str | None = None) -> list[tuple[str, str]]:
    """Months taken when a request names none: this year's so far, or a past year's twelve."""
    year = year or now[:4]
    return [(year, m) for m in C.months_of_year(year, now)]


def known_months(manifest: DataFrame) -> list[tuple[str, str]]:
    """Distinct months of the manifest in order; a few hundred for decades of papers."""
    rows = manifest.select("year", "month").distinct().orderBy("year", "month").collect()
    return [(r["year"], r["month"]) for r in rows]


def grid_status(grid: DataFrame, manifest: DataFrame) -> DataFrame:
    """Grid cells with what the manifest knows of them; nothing known means 0 and false."""
    known = manifest.withColumn("present", F.lit(True))
    return grid.join(known, list(KEYS), "left").select(
        *grid.columns,
        F.coalesce("present", F.lit(False)).alias("present"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.coalesce("downloaded", F.lit(False)).alias("downloaded"),
        F.coalesce("embedded", F.lit(False)).alias("embedded"),
    )


def embedding_work_plan(status: DataFrame, now: str, force: bool = False) -> DataFrame:
    """What to do with each cell: skip, embed, or fetch and embed.

    Embedded cells are skipped, except in the current month or when forced.
    """
    current = C.ym() == now
    done = F.col("embedded") & ~current & F.lit(not force)
    action = F.when(done, "skip").when(F.col("downloaded"), "embed").otherwise("fetch+embed")
    return status.withColumn("action", action)


def todo_partitions(plan: DataFrame) -> DataFrame:
    """Cells of a work plan that need work."""
    return plan.where(F.col("action") != "skip")


def run_totals(plan: DataFrame, embedded_counts: DataFrame) -> DataFrame:
    """Totals of a run: tasks, skipped cells, papers embedded by it, papers after assembly.

    ``embedded_counts`` has the row count of each partition once the run is over.
    """
    counts = embedded_counts.select(*KEYS, F.col("n_rows").alias("n_after"))
    joined = plan.join(counts, list(KEYS), "left")
    skipped = F.col("action") == "skip"
    after = F.coalesce("n_after", F.lit(0))
    return joined.agg(
        F.count("*").alias("tasks"),
        F.count_if(skipped).alias("skipped"),
        F.coalesce(F.sum(F.when(~skipped, after)), F.lit(0)).alias("papers_embedded"),
        F.coalesce(F.sum(after), F.lit(0)).alias("papers_total"),
    )


def missing_partitions(grid: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cells that are not embedded."""
    done = manifest.where("embedded").select(*KEYS)
    return grid.select(*KEYS).join(done, list(KEYS), "left_anti")


def partition_flags(grid: DataFrame, manifest: DataFrame) -> DataFrame:
    """Landed and embedded tests of each cell."""
    return grid_status(grid, manifest).select(
        *KEYS,
        F.col("downloaded").alias("is_landed"),
        F.col("embedded").alias("is_embedded"),
    )


def partition_counts(corpus: DataFrame) -> DataFrame:
    """Exact row count of each partition; reads no data column of a partitioned table."""
    return corpus.groupBy(*KEYS).agg(F.count("*").alias("n_rows"))


def landed_listing(manifest: DataFrame) -> DataFrame:
    """Per landed month: its subjects, sorted (a month has at most as many as there are codes)."""
    landed = manifest.where("downloaded").select(*KEYS).distinct()
    subjects = F.array_sort(F.collect_list("subject"))
    return (
        landed.groupBy("year", "month")
        .agg(F.count("*").alias("n_subjects"), F.array_join(subjects, ",").alias("subjects"))
        .orderBy("year", "month")
    )


def landed_months(manifest: DataFrame) -> DataFrame:
    """Landed years with their landed months."""
    months = manifest.where("downloaded").select("year", "month").distinct()
    listed = F.array_join(F.array_sort(F.collect_list("month")), ",")
    return months.groupBy("year").agg(listed.alias("months")).orderBy("year")


def cache_summary(manifest: DataFrame) -> DataFrame:
    """Subjects, papers and partitions per landed month, per year and in total."""
    landed = manifest.where("downloaded")
    return landed.rollup("year", "month").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count_distinct("subject").alias("subjects"),
        F.sum("n_rows").alias("papers"),
        F.count("*").alias("partitions"),
    )


def estimate_rows(status: DataFrame, bytes_per_row: int = BYTES_PER_PAPER) -> DataFrame:
    """Paper count of each cell: exact when landed, else estimated from the file size."""
    exact = F.col("downloaded")
    estimated = F.floor(F.col("size_bytes") / F.lit(bytes_per_row)).cast("long")
    return status.withColumns(
        {"paper_count": F.when(exact, F.col("n_rows")).otherwise(estimated), "is_exact": exact}
    )


def _count_columns() -> list[Column]:
    exact, n = F.col("is_exact"), F.col("paper_count")
    return [
        F.coalesce(F.sum(F.when(exact, n)), F.lit(0)).alias("total_exact"),
        F.coalesce(F.sum(F.when(~exact, n)), F.lit(0)).alias("total_estimated"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total"),
        F.count_if(exact).alias("exact_cells"),
        F.count_if(~exact).alias("estimated_cells"),
    ]


def selection_counts(status: DataFrame, bytes_per_row: int = BYTES_PER_PAPER) -> DataFrame:
    """Exact and estimated papers by category, by month and in total, in one pass."""
    cells = estimate_rows(status, bytes_per_row).withColumn("year_month", C.ym())
    return cells.groupingSets(
        [[F.col("subject")], [F.col("year_month")], []], F.col("subject"), F.col("year_month")
    ).agg(F.grouping_id().cast("int").alias("level"), *_count_columns())


def top_categories_breakdown(status: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest categories of a selection."""
    per_category = estimate_rows(status).groupBy("subject").agg(F.sum("paper_count").alias("total"))
    return per_category.where("total > 0").orderBy(F.desc("total"), "subject").limit(n)


def estimate_cost(
    counts: DataFrame,
    papers: str = "total",
    gpu_rate: float = GPU_PAPERS_PER_MINUTE,
    cpu_rate: float = CPU_PAPERS_PER_MINUTE,
    layout_papers: float = LAYOUT_PAPERS,
) -> DataFrame:
    """Add the estimated minutes of embedding plus layout to every row."""
    n = F.col(papers).cast("double")
    ratio = n / F.lit(float(layout_papers))
    layout = F.lit(LAYOUT_MINUTES) * ratio * (F.lit(1.0) + F.lit(LAYOUT_GROWTH) * ratio)
    return counts.withColumns(
        {
            "gpu_minutes": F.round(n / F.lit(float(gpu_rate)) + layout, 2),
            "cpu_minutes": F.round(n / F.lit(float(cpu_rate)) + layout, 2),
            "layout_seconds": F.round(layout * F.lit(60.0)).cast("long"),
        }
    )


def category_status(status: DataFrame) -> DataFrame:
    """Per category over the requested months: counts, flags and month lists in request order."""
    embedded, landed = F.col("embedded"), F.col("downloaded")
    entry = F.struct("pos", C.ym().alias("ym"))

    def month_list(flag: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(flag, entry)))
        return F.array_join(F.transform(found, lambda e: e["ym"]), ",")

    return status.groupBy("subject").agg(
        (F.count_if(embedded) > 0).alias("embedded"),
        (F.count_if(landed) > 0).alias("downloaded"),
        F.coalesce(F.sum(F.when(embedded, F.col("n_rows"))), F.lit(0)).alias("n_embedded"),
        F.count_if(embedded).alias("months_embedded"),
        F.count_if(landed).alias("months_downloaded"),
        month_list(embedded).alias("embedded_months"),
        month_list(landed).alias("downloaded_months"),
    )


def status_label(per_category: DataFrame, months_selected: int) -> DataFrame:
    """Short label of each category of :func:`category_status`.

    With no month selected, any embedded month counts as complete.
    """
    complete = F.col("months_embedded") == months_selected if months_selected else F.lit(True)
    label = (
        F.when(F.col("embedded") & complete, F.format_string("%d embedded", "n_embedded"))
        .when(F.col("embedded"), F.format_string("%d mo", "months_embedded"))
        .when(F.col("downloaded"), F.format_string("%d mo cached", "months_downloaded"))
        .otherwise("New")
    )
    return per_category.select("subject", label.alias("label"))


def availability(upstream: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where each year (or year and month) can be found: upstream, landed, or both."""
    there = upstream.select(*keys).distinct().withColumn("_up", F.lit(True))
    here = landed.select(*keys).distinct().withColumn("_landed", F.lit(True))
    return there.join(here, list(keys), "full_outer").select(
        *keys,
        F.coalesce("_up", F.lit(False)).alias("available_upstream"),
        F.coalesce("_landed", F.lit(False)).alias("landed"),
    )


def union_years(upstream: DataFrame, landed: DataFrame) -> DataFrame:
    """Years found upstream or landed, newest first."""
    return upstream.select("year").union(landed.select("year")).distinct().orderBy(F.desc("year"))


def union_months(upstream: DataFrame, landed: DataFrame) -> DataFrame:
    """Months found upstream or landed, oldest first."""
    keys = ("year", "month")
    return upstream.select(*keys).union(landed.select(*keys)).distinct().orderBy(*keys)


def monthly_status(manifest: DataFrame, now: str, year: str | None = None) -> DataFrame:
    """Months of a year up to ``now``: offered upstream, landed subjects and landed papers."""
    months = [m for _, m in default_months(now, year)]
    year = year or now[:4]
    calendar = manifest.sparkSession.createDataFrame(
        [(year, m) for m in months], "year string, month string"
    )
    landed = F.col("downloaded")
    found = (
        manifest.where((F.col("year") == year) & F.col("month").isin(months))
        .groupBy("year", "month")
        .agg(F.count_if(landed).alias("n"), F.sum(F.when(landed, F.col("n_rows"))).alias("papers"))
    )
    return calendar.join(found, ["year", "month"], "left").select(
        "year",
        "month",
        F.col("n").isNotNull().alias("available"),
        F.coalesce("n", F.lit(0)).alias("landed_subjects"),
        F.coalesce("papers", F.lit(0)).alias("papers"),
    )

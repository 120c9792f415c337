"""Manifest queries: grids, status, estimates, reuse of stored results."""

from pyspark.sql import functions as F

from folioscope.operators import catalog, listing, reuse
from folioscope.registry import base as B
from folioscope.registry.base import query
from folioscope.schemas import KEYS


@query("request_grid", "SELECT subject, year, month, pos FROM grid")
def _(spark, sf):
    return B.grid(spark, sf)


@query("grid_status", "SELECT * FROM status")
def _(spark, sf):
    return B.status(spark, sf)


@query("embedding_work_plan", "SELECT subject, year, month, action FROM plan")
def _(spark, sf):
    return B.plan(spark, sf).select(*KEYS, "action")


@query(
    "embed_run_totals",
    """SELECT count(*) AS tasks, count(*) FILTER (action = 'skip') AS skipped,
    cast(sum(n_rows) FILTER (action <> 'skip') AS bigint) AS papers_embedded,
    cast(sum(n_rows) AS bigint) AS papers_total FROM plan""",
)
def _(spark, sf):
    after = catalog.partition_counts(B.keyed(spark, sf))
    return catalog.run_totals(B.plan(spark, sf), after)


@query(
    "categories_with_names",
    """SELECT k.subject AS code, coalesce(n.name, k.subject) AS name
    FROM (SELECT DISTINCT subject FROM keyed) k LEFT JOIN
      (SELECT subject, min(trim(regexp_extract(primary_subject, '^[^(]*'))) AS name
       FROM keyed WHERE subject LIKE '%.%' GROUP BY subject) n ON n.subject = k.subject""",
)
def _(spark, sf):
    codes = B.keyed(spark, sf).select(F.col("subject").alias("code"), "primary_subject")
    name = F.trim(F.regexp_extract("primary_subject", "^[^(]*", 0))
    names = codes.where(F.col("code").contains(".")).groupBy("code").agg(F.min(name).alias("name"))
    return listing.categories_with_names(codes, names)


def _sides(spark, sf):
    known = B.manifest(spark, sf)
    return known.where("NOT embedded"), known.where("downloaded")


@query(
    "availability",
    """SELECT subject, year, month, coalesce(up, false) AS available_upstream,
    coalesce(here, false) AS landed FROM
    (SELECT subject, year, month, true AS up FROM manifest WHERE NOT embedded) u FULL OUTER JOIN
    (SELECT subject, year, month, true AS here FROM manifest WHERE downloaded) l
    USING (subject, year, month)""",
)
def _(spark, sf):
    return catalog.availability(*_sides(spark, sf), KEYS)


@query(
    "availability_years",
    """SELECT year, coalesce(up, false) AS available_upstream, coalesce(here, false) AS landed FROM
    (SELECT DISTINCT year, true AS up FROM manifest WHERE NOT embedded) u FULL OUTER JOIN
    (SELECT DISTINCT year, true AS here FROM manifest WHERE downloaded) l USING (year)""",
)
def _(spark, sf):
    return catalog.availability(*_sides(spark, sf), ["year"])


@query("union_years", "SELECT DISTINCT year FROM manifest")
def _(spark, sf):
    return catalog.union_years(*_sides(spark, sf))


@query(
    "union_months",
    "SELECT DISTINCT year, month FROM manifest WHERE downloaded OR NOT embedded",
)
def _(spark, sf):
    return catalog.union_months(*_sides(spark, sf))


@query(
    "missing_partitions",
    """SELECT subject, year, month FROM grid EXCEPT
    SELECT subject, year, month FROM manifest WHERE embedded""",
)
def _(spark, sf):
    return catalog.missing_partitions(B.grid(spark, sf), B.manifest(spark, sf))


@query(
    "partition_flags",
    "SELECT subject, year, month, downloaded AS is_landed, embedded AS is_embedded FROM status",
)
def _(spark, sf):
    return catalog.partition_flags(B.grid(spark, sf), B.manifest(spark, sf))


@query("partition_counts", "SELECT subject, year, month, n_rows FROM manifest")
def _(spark, sf):
    return catalog.partition_counts(B.keyed(spark, sf))


@query(
    "landed_listing",
    """SELECT year, month, count(*) AS n_subjects, string_agg(subject, ',' ORDER BY subject) AS subjects
    FROM manifest WHERE downloaded GROUP BY year, month""",
)
def _(spark, sf):
    return catalog.landed_listing(B.manifest(spark, sf))


@query(
    "landed_months",
    """SELECT year, string_agg(DISTINCT month, ',' ORDER BY month) AS months
    FROM manifest WHERE downloaded GROUP BY year""",
)
def _(spark, sf):
    return catalog.landed_months(B.manifest(spark, sf))


@query(
    "cache_summary",
    """SELECT year, month, cast(grouping(year, month) AS int) AS level,
    count(DISTINCT subject) AS subjects, cast(sum(n_rows) AS bigint) AS papers, count(*) AS partitions
    FROM manifest WHERE downloaded GROUP BY ROLLUP (year, month)""",
)
def _(spark, sf):
    return catalog.cache_summary(B.manifest(spark, sf))


@query("estimate_rows", "SELECT subject, year, month, paper_count, is_exact FROM estimated")
def _(spark, sf):
    return catalog.estimate_rows(B.status(spark, sf)).select(*KEYS, "paper_count", "is_exact")


_COUNTS = """cast(coalesce(sum(paper_count) FILTER (is_exact), 0) AS bigint) AS total_exact,
    cast(coalesce(sum(paper_count) FILTER (NOT is_exact), 0) AS bigint) AS total_estimated,
    cast(sum(paper_count) AS bigint) AS total,
    count(*) FILTER (is_exact) AS exact_cells, count(*) FILTER (NOT is_exact) AS estimated_cells"""


@query(
    "selection_counts",
    f"""SELECT subject, year_month, cast(grouping(subject, year_month) AS int) AS level, {_COUNTS}
    FROM estimated GROUP BY GROUPING SETS ((subject), (year_month), ())""",
)
def _(spark, sf):
    return catalog.selection_counts(B.status(spark, sf))


@query(
    "estimate_cost",
    """SELECT subject, year_month, level, total,
      round(total::double / 40000::double + lay, 2) AS gpu_minutes,
      round(total::double / 6700::double + lay, 2) AS cpu_minutes,
      cast(round(lay * 60::double) AS bigint) AS layout_seconds
    FROM (SELECT *, 0.37::double * (total::double / 17342::double)
            * (1::double + 0.1::double * (total::double / 17342::double)) AS lay
          FROM (SELECT subject, year_month, cast(grouping(subject, year_month) AS int) AS level,
                  cast(sum(paper_count) AS bigint) AS total
                FROM estimated GROUP BY GROUPING SETS ((subject), (year_month), ())) c) d""",
)
def _(spark, sf):
    costs = catalog.estimate_cost(catalog.selection_counts(B.status(spark, sf)))
    return costs.select(
        "subject", "year_month", "level", "total", "gpu_minutes", "cpu_minutes", "layout_seconds"
    )


@query(
    "top_categories_breakdown",
    """SELECT subject, cast(sum(paper_count) AS bigint) AS total FROM estimated GROUP BY subject
    HAVING sum(paper_count) > 0 ORDER BY total DESC, subject LIMIT 5""",
)
def _(spark, sf):
    return catalog.top_categories_breakdown(B.status(spark, sf))


@query(
    "category_status",
    """SELECT subject, bool_or(embedded) AS embedded, bool_or(downloaded) AS downloaded,
    cast(coalesce(sum(n_rows) FILTER (embedded), 0) AS bigint) AS n_embedded,
    count(*) FILTER (embedded) AS months_embedded,
    count(*) FILTER (downloaded) AS months_downloaded,
    coalesce(string_agg(year || '-' || month, ',' ORDER BY pos) FILTER (embedded), '') AS embedded_months,
    coalesce(string_agg(year || '-' || month, ',' ORDER BY pos) FILTER (downloaded), '') AS downloaded_months
    FROM status GROUP BY subject""",
)
def _(spark, sf):
    return catalog.category_status(B.status(spark, sf))


@query(
    "monthly_status",
    f"""SELECT '2024' AS year, c.month, bool_or(m.subject IS NOT NULL) AS available,
    count(*) FILTER (m.downloaded) AS landed_subjects,
    cast(coalesce(sum(m.n_rows) FILTER (m.downloaded), 0) AS bigint) AS papers
    FROM (SELECT lpad(cast(i AS varchar), 2, '0') AS month FROM range(1, {int(B.NOW[5:7]) + 1}) r(i)) c
    LEFT JOIN manifest m ON m.year = '2024' AND m.month = c.month GROUP BY c.month""",
)
def _(spark, sf):
    return catalog.monthly_status(B.manifest(spark, sf), B.NOW)


@query(
    "layout_cache_valid",
    """SELECT selection_id,
      bool_and(embedded) AND coalesce(max(embedded_at) <= 1700000000 + 86400 * 9, false) AS is_valid
    FROM (SELECT *, subject || ':' || year || ':' || (CAST(month AS int) % 2) AS selection_id
          FROM manifest) m GROUP BY selection_id""",
)
def _(spark, sf):
    odd = (F.col("month").cast("int") % 2).cast("string")
    chosen = B.manifest(spark, sf).select(*KEYS)
    chosen = chosen.withColumn("selection_id", F.concat_ws(":", "subject", "year", odd))
    stored = chosen.select("selection_id").distinct()
    stored = stored.withColumn("layout_at", F.lit(1700000000 + 86400 * 9))
    return reuse.layout_cache_valid(chosen, B.manifest(spark, sf), stored)


@query(
    "topics_cache_valid",
    """SELECT 'topics-' || year AS key, n_all = n_landed AS is_valid FROM
    (SELECT year, sum(n_rows) AS n_all,
       sum(CASE WHEN downloaded OR year = '2023' THEN n_rows ELSE 0 END) AS n_landed
     FROM manifest GROUP BY year) y""",
)
def _(spark, sf):
    """A result stored for each year, taken before some of 2024's papers had landed."""
    papers = B.keyed(spark, sf)
    flags = B.manifest(spark, sf).select(*KEYS, "downloaded")
    early = papers.join(flags, list(KEYS)).where("downloaded OR year = '2023'")

    def prints(rows):
        keyed = F.concat(F.lit("topics-"), F.col("year")).alias("key")
        return reuse.dataset_fingerprint(rows, keyed)

    return reuse.topics_cache_valid(prints(papers), prints(early))

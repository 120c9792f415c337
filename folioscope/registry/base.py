"""Input tables of the queries and the list of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.vectors import dominant_topic
from folioscope.operators import catalog
from folioscope.operators.prepare import prepare
from folioscope.session import new_path, ship_package
from folioscope.sources.corpus import with_year_month, write_partitioned

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-06"  # the present month of the queries

# Papers made from the documents table; runs unchanged in both engines.
_PAPERS = """
SELECT
  '2401.' || lpad(cast(doc_id AS string), cast(greatest(5, length(cast(doc_id AS string))) AS int), '0') AS arxiv_id,
  CASE WHEN doc_id % 53 = 7 THEN NULL ELSE substring(text, 1, cast(20 + doc_id * 7 % 160 AS int)) END AS title,
  split(substring('Ann A;Bob B;Cyd C;Dee D;Eve E', 1, cast(5 + 6 * (doc_id % 5) AS int)), ';') AS authors,
  CASE WHEN doc_id % 37 = 5 THEN NULL
       WHEN doc_id % 41 = 5 THEN 'Jan 2024'
       WHEN doc_id % 43 = 5 THEN '5 Foo 2024'
       WHEN doc_id % 47 = 5 THEN 'Submitted 7 Mar 2023 (v2)'
       ELSE cast(day(d) AS string) || ' ' ||
            split_part('Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec', ',', cast(month(d) AS int)) ||
            ' ' || cast(year(d) AS string) END AS submission_date,
  subj AS primary_subject,
  CASE WHEN doc_id % 29 = 3 THEN NULL
       WHEN doc_id % 3 = 0 THEN subj || '; Machine Learning (stat.ML); Optics (physics.optics)'
       ELSE subj END AS subjects,
  text AS abstract{vector}
FROM (SELECT doc_id, text, date '2023-01-01' + cast(doc_id * 13 % 720 AS int) AS d,
             CASE cast(substring(source, 4) AS int) % 8
               WHEN 0 THEN 'Artificial Intelligence (cs.AI)'
               WHEN 1 THEN 'Machine Learning (cs.LG)'
               WHEN 2 THEN 'Computation and Language (cs.CL)'
               WHEN 3 THEN 'Optics (physics.optics)'
               WHEN 4 THEN 'General Relativity and Quantum Cosmology (gr-qc)'
               WHEN 5 THEN 'Physics (General) (physics.gen-ph)'
               WHEN 6 THEN 'Earth and Planetary Astrophysics (astro-ph.EP)'
               ELSE 'Unclassified' END AS subj
      FROM documents) s
{join}"""

_JOIN = "LEFT JOIN embeddings e ON e.vec_id = s.doc_id"
_MONTHS = "',Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec'"
_MONTH_NUMBER = f"lpad(cast((instr({_MONTHS}, ',' || mon) + 3) // 4 AS varchar), 2, '0')"

# The derived tables in SQL, for the twins.
_CTES = f"""WITH papers AS ({_PAPERS.format(vector=", embedding", join=_JOIN)}),
dated AS (
  SELECT p.*,
    nullif(regexp_extract(primary_subject, '[(]([^)]+)[)]', 1), '') AS subject,
    nullif(regexp_extract(submission_date, '[0-9]{{1,2}}[ ]+([A-Za-z0-9_]{{3}})[ ]+([0-9]{{4}})', 1), '') AS mon,
    regexp_extract(submission_date, '[0-9]{{1,2}}[ ]+([A-Za-z0-9_]{{3}})[ ]+([0-9]{{4}})', 2) AS yr
  FROM papers p),
all_keyed AS (
  SELECT d.* EXCLUDE (mon, yr),
    CASE WHEN instr({_MONTHS}, ',' || mon) > 0 THEN nullif(yr, '') END AS year,
    CASE WHEN instr({_MONTHS}, ',' || mon) > 0 THEN {_MONTH_NUMBER} END AS month
  FROM dated d),
keyed AS (
  SELECT * FROM all_keyed WHERE subject IS NOT NULL AND year IS NOT NULL AND month IS NOT NULL),
crosslisted AS (
  SELECT * FROM keyed UNION ALL
  SELECT * REPLACE ('stat.ML' AS subject) FROM keyed WHERE subjects LIKE '%(stat.ML)%'),
manifest AS (
  SELECT subject, year, month, n_rows,
         n_rows * 600 + 17 * cast(month AS int) AS size_bytes,
         (cast(month AS int) + length(subject)) % 3 <> 0 AS downloaded,
         (cast(month AS int) + length(subject)) % 3 <> 0 AND cast(month AS int) % 2 = 0 AS embedded,
         cast(1700000000 + 86400 * cast(month AS int) AS bigint) AS embedded_at
  FROM (SELECT subject, year, month, count(*) AS n_rows FROM keyed GROUP BY subject, year, month) g),
known_months AS (
  SELECT year, month, row_number() OVER (ORDER BY year, month) - 1 AS pos
  FROM (SELECT DISTINCT year, month FROM manifest) m),
grid AS (
  SELECT s.subject, m.year, m.month, cast(m.pos AS int) AS pos
  FROM (SELECT DISTINCT subject FROM manifest) s CROSS JOIN known_months m),
status AS (
  SELECT g.*, x.subject IS NOT NULL AS present, coalesce(x.n_rows, 0) AS n_rows,
         coalesce(x.size_bytes, 0) AS size_bytes, coalesce(x.downloaded, false) AS downloaded,
         coalesce(x.embedded, false) AS embedded
  FROM grid g LEFT JOIN manifest x
    ON x.subject = g.subject AND x.year = g.year AND x.month = g.month),
estimated AS (
  SELECT s.*, CASE WHEN downloaded THEN n_rows ELSE size_bytes // 600 END AS paper_count,
         downloaded AS is_exact, year || '-' || month AS year_month
  FROM status s),
plan AS (
  SELECT s.*, CASE WHEN embedded AND year || '-' || month <> '{NOW}' THEN 'skip'
                   WHEN downloaded THEN 'embed' ELSE 'fetch+embed' END AS action
  FROM status s),
strict AS (
  SELECT p.*, cast(substring(arxiv_id, 6) AS bigint) AS n,
    nullif(regexp_extract(submission_date, '^[ ]*[^ ]+[ ]+([^ ]{{3}})[ ]+([^ ]+)[ ]*$', 1), '') AS mon,
    regexp_extract(submission_date, '^[ ]*[^ ]+[ ]+([^ ]{{3}})[ ]+([^ ]+)[ ]*$', 2) AS yr
  FROM papers p),
current_ AS (
  SELECT arxiv_id, title, authors, submission_date, primary_subject, abstract, embedding,
    CASE WHEN instr({_MONTHS}, ',' || mon) > 0 THEN yr || '-' || {_MONTH_NUMBER} END AS year_month,
    cast(n * 37 % 1000 AS double) / 1000 AS x,
    cast(n * 61 % 1000 AS double) / 1000 AS y,
    cast(n % 5 AS int) AS dominant_topic
  FROM strict),
query_vector AS (SELECT embedding::double[] AS q FROM embeddings WHERE vec_id = 0),
scored AS (
  SELECT c.*, list_cosine_similarity(c.embedding::double[], q.q) AS similarity
  FROM current_ c CROSS JOIN query_vector q WHERE c.embedding IS NOT NULL),
weighed AS (
  SELECT c.* EXCLUDE (dominant_topic), c.embedding[1:5]::double[] AS topic_weights,
    cast(list_position(c.embedding[1:5], list_max(c.embedding[1:5])) - 1 AS int) AS dominant_topic
  FROM current_ c WHERE c.embedding IS NOT NULL)
"""


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its twin may use the derived tables above."""

    def register(fn: Query) -> Query:
        QUERIES[key] = lambda spark, sf_dir: fn(ship_package(spark), sf_dir)
        if sql is not None:
            ORACLES[key] = _CTES + sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Raw papers; the join with the vectors is made only where they are used."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    if not vectors:
        return spark.sql(_PAPERS.format(vector="", join=""))
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    return spark.sql(_PAPERS.format(vector=", embedding", join=_JOIN))


def keyed(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    return prepare(papers(spark, sf_dir, vectors))


def crosslisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed papers, landed once more under the subject they are cross-listed in."""
    own = keyed(spark, sf_dir)
    other = own.where(F.col("subjects").contains("(stat.ML)")).withColumn("subject", F.lit("stat.ML"))
    return own.unionByName(other)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition counts of the keyed papers with stand-in sizes and flags."""
    counts = catalog.partition_counts(keyed(spark, sf_dir))
    month = F.col("month").cast("int")
    landed = F.pmod(month + F.length("subject"), F.lit(3)) != 0
    return counts.select(
        "subject",
        "year",
        "month",
        "n_rows",
        (F.col("n_rows") * 600 + 17 * month).alias("size_bytes"),
        landed.alias("downloaded"),
        (landed & (month % 2 == 0)).alias("embedded"),
        (F.lit(1700000000) + 86400 * month).cast("long").alias("embedded_at"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject in every month that occurs."""
    known = manifest(spark, sf_dir)
    return catalog.request_grid(known, catalog.known_months(known))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.grid_status(grid(spark, sf_dir), manifest(spark, sf_dir))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.embedding_work_plan(status(spark, sf_dir), NOW)


def current(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """The current dataset: papers with year-month and stand-in coordinates and topic."""
    dated = with_year_month(papers(spark, sf_dir, vectors))
    n = F.substring("arxiv_id", 6, 20).cast("long")
    return dated.drop("subjects").withColumns(
        {
            "x": (n * 37 % 1000).cast("double") / 1000,
            "y": (n * 61 % 1000).cast("double") / 1000,
            "dominant_topic": (n % 5).cast("int"),
        }
    )


def weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current papers with the head of their vector as stand-in topic weights."""
    rows = current(spark, sf_dir).where(F.col("embedding").isNotNull())
    weights = F.slice("embedding", 1, 5).cast("array<double>")
    return rows.withColumn("topic_weights", weights).withColumn(
        "dominant_topic", dominant_topic("topic_weights")
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector that stands for the search text: the first of the embeddings table."""
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row["embedding"])


_landed: dict[tuple[str, str], str] = {}


def landed_path(spark: SparkSession, sf_dir: str) -> str:
    """The keyed papers as a partitioned table, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landed:
        path = new_path(spark, "landed")
        write_partitioned(keyed(spark, sf_dir), path)
        _landed[key] = path
    return _landed[key]

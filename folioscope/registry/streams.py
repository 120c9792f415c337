"""Streaming queries: papers arrive in a staging folder, the result is read back as a table."""

from pyspark.sql import functions as F

from folioscope.operators.embedding import HashedWords
from folioscope.plans.incremental import read_embeddings
from folioscope.registry import base as B
from folioscope.registry.base import query
from folioscope.schemas import KEYS, RAW_PAPER
from folioscope.session import new_path
from folioscope.sources.corpus import read_corpus
from folioscope.sources.snapshots import read_published
from folioscope.streaming import jobs


def _staging(spark, sf, twice=False):
    path = new_path(spark, "staging")
    raw = B.papers(spark, sf)
    raw.write.parquet(path)
    if twice:
        raw.write.mode("append").parquet(path)
    return path


@query("stream_land", "SELECT arxiv_id, title, subject, year, month FROM keyed")
def _(spark, sf):
    staged = jobs.read_staging(spark, _staging(spark, sf))
    path = new_path(spark, "landed")
    jobs.stream_land(staged, path, new_path(spark, "checkpoint")).awaitTermination()
    return read_corpus(spark, path).select("arxiv_id", "title", *KEYS)


@query(
    "stream_embed",
    """SELECT subject, year, month, count(*) AS n_rows, count(title || abstract) AS n_vectors
    FROM keyed GROUP BY subject, year, month""",
)
def _(spark, sf):
    staged = jobs.read_staging(spark, _staging(spark, sf))
    path = new_path(spark, "embedded")
    landed, checkpoint = B.landed_path(spark, sf), new_path(spark, "checkpoint")
    jobs.stream_embed(staged, landed, path, checkpoint, HashedWords()).awaitTermination()
    rows = read_embeddings(spark, path)
    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("n_rows"), F.count("embedding").alias("n_vectors")
    )


@query("stream_dedupe", "SELECT arxiv_id, title, primary_subject FROM papers")
def _(spark, sf):
    staged = jobs.read_staging(spark, _staging(spark, sf, twice=True))
    path = new_path(spark, "deduped")
    jobs.stream_dedupe(staged, path, new_path(spark, "checkpoint")).awaitTermination()
    rows = spark.read.schema(RAW_PAPER).parquet(path)
    return rows.select("arxiv_id", "title", "primary_subject")


@query("stream_land_new", "SELECT arxiv_id, title, primary_subject FROM papers")
def _(spark, sf):
    """Every paper arrives twice, some of them in a later run."""
    staging, path = _staging(spark, sf, twice=True), new_path(spark, "deduped")
    ids, checkpoint = new_path(spark, "ids"), new_path(spark, "checkpoint")
    for _ in range(2):
        jobs.stream_land_new(jobs.read_staging(spark, staging, 3), path, ids, checkpoint).awaitTermination()
        B.papers(spark, sf).where("length(title) > 90").write.mode("append").parquet(staging)
    return spark.read.schema(RAW_PAPER).parquet(path).select("arxiv_id", "title", "primary_subject")


@query(
    "stream_stats",
    "SELECT primary_subject, count(*) AS n_papers FROM papers GROUP BY primary_subject",
)
def _(spark, sf):
    staged = jobs.read_staging(spark, _staging(spark, sf))
    root = new_path(spark, "stats")
    jobs.stream_stats(staged, root, new_path(spark, "checkpoint")).awaitTermination()
    return read_published(spark, root)


@query(
    "stream_month_stats",
    "SELECT year_month, count(*) AS n_papers FROM current_ GROUP BY year_month",
)
def _(spark, sf):
    staged = jobs.read_staging(spark, _staging(spark, sf))
    root = new_path(spark, "stats")
    query = jobs.stream_stats(staged, root, new_path(spark, "checkpoint"), "year_month")
    query.awaitTermination()
    return read_published(spark, root)

"""Embed what is new, assemble a selection, lay it out and publish it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import catalog
from folioscope.operators.embedding import Embedder, embed_papers, model_name
from folioscope.operators.layout import layout
from folioscope.operators.prepare import dedupe
from folioscope.operators.reuse import layout_cache_valid, options_key, selection_hash
from folioscope.schemas import EMBEDDED_PAPER, KEYED_PAPER, KEYS
from folioscope.session import cut, scratch
from folioscope.sources.corpus import (
    read_corpus,
    scan_partitions,
    scan_selection,
    with_year_month,
    write_partitioned,
)
from folioscope.sources.manifest import catalog_manifest, partition_manifest
from folioscope.sources.snapshots import latest, publish, read_published

DEFAULT_CATEGORIES = ("cs.AI", "cs.LG", "cs.CL")  # fixed value


def write_embeddings(embedded: DataFrame, path: str) -> None:
    """Replace the partitions that occur in ``embedded``, leave all others."""
    names = [f.name for f in EMBEDDED_PAPER.fields]
    write_partitioned(embedded.select(*names), path, dynamic=True)


def models_path(path: str) -> str:
    """Where the model of each partition of an embedded table is kept; not inside the table."""
    return f"{path.rstrip('/')}-models"


def stored_models(spark: SparkSession, path: str) -> DataFrame:
    """(subject, year, month, model) of the embedded partitions; none for tables of earlier versions."""
    rows = read_published(spark, models_path(path))
    kinds = ", ".join(f"{k} string" for k in (*KEYS, "model"))
    return spark.createDataFrame([], kinds) if rows is None else rows


def record_models(done: DataFrame, path: str, model: str) -> None:
    """Note ``model`` for the partitions in ``done``; a row for each partition of the table."""
    spark = done.sparkSession
    new = done.select(*KEYS).distinct().withColumn("model", F.lit(model))
    kept = stored_models(spark, path).join(new, list(KEYS), "left_anti")
    publish(kept.unionByName(new).coalesce(1), models_path(path))


def refuse_mixed_models(
    spark: SparkSession, path: str, categories: Sequence[str], year_months: Sequence[tuple[str, str]]
) -> None:
    """Raise if the chosen partitions hold vectors of different models."""
    chosen = selection_of(spark, categories, year_months).select(*KEYS)
    names = stored_models(spark, path).join(chosen, list(KEYS), "left_semi").select("model").distinct().limit(3).collect()
    if len(names) > 1:
        raise ValueError(f"vectors of different models: {sorted(r['model'] for r in names)}; embed again with one")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return read_corpus(spark, path, EMBEDDED_PAPER)


def current_manifest(
    spark: SparkSession, landed_path: str, embedded_path: str, with_counts: bool = True
) -> DataFrame:
    """Manifest of the landed and the embedded table as they are now.

    Without counts it takes a listing of files only.
    """
    landed = partition_manifest(spark, landed_path, KEYED_PAPER, with_counts)
    embedded = partition_manifest(spark, embedded_path, EMBEDDED_PAPER, with_counts=False)
    return catalog_manifest(landed, landed, embedded)


def embed_missing(
    spark: SparkSession,
    landed_path: str,
    embedded_path: str,
    embedder: Embedder,
    categories: Sequence[str],
    year_months: Sequence[tuple[str, str]],
    now: str,
    force: bool = False,
    partitions: int | None = None,
    chars: int | None = None,
) -> DataFrame:
    """Embed the chosen landed partitions that need it, all in one job; returns the work plan.

    Needed are partitions without embeddings, those of another model or of the current month, or all
    when forced. A partition that is not landed has no data and is left alone.
    """
    chosen = spark.createDataFrame([(c,) for c in categories], "subject string")
    grid = catalog.request_grid(chosen, year_months)
    manifest = current_manifest(spark, landed_path, embedded_path, with_counts=False)
    model = model_name(embedder)
    others = stored_models(spark, embedded_path).where(F.col("model") != model).select(*KEYS, F.lit(True).alias("other"))
    same = F.col("embedded") & F.col("other").isNull()
    manifest = manifest.join(others, list(KEYS), "left").withColumn("embedded", same).drop("other")
    plan = catalog.embedding_work_plan(catalog.grid_status(grid, manifest), now, force)
    plan = cut(plan, "work-plan")  # the embedded table changes below
    todo = catalog.todo_partitions(plan).where("downloaded")
    if not todo.isEmpty():
        papers = scan_partitions(read_corpus(spark, landed_path), todo)
        write_embeddings(embed_papers(papers, embedder, partitions, chars), embedded_path)
        record_models(todo, embedded_path, model)
    return plan


def assemble(
    embedded: DataFrame, categories: Sequence[str], year_months: Sequence[tuple[str, str]]
) -> DataFrame:
    """Chosen partitions that exist, one row per paper, with its year-month."""
    return with_year_month(dedupe(scan_selection(embedded, categories, year_months)))


def add_layout(papers: DataFrame, method: str = "umap", **options: int) -> DataFrame:
    """Add x and y; a paper without a vector has neither."""
    at = layout(papers, method, **options)
    return papers.join(at, "arxiv_id", "left")


def selection_of(
    spark: SparkSession, categories: Sequence[str], year_months: Sequence[tuple[str, str]]
) -> DataFrame:
    """The (selection_id, subject, year, month) rows of one request."""
    chosen = spark.createDataFrame([(c,) for c in categories], "subject string")
    cells = catalog.request_grid(chosen, year_months).drop("pos")
    return cells.withColumn("selection_id", F.lit("request"))


def combine_and_layout(
    spark: SparkSession,
    embedded_path: str,
    layouts_path: str,
    categories: Sequence[str],
    year_months: Sequence[tuple[str, str]],
    use_cache: bool = True,
    method: str = "umap",
    **options: int,
) -> DataFrame:
    """The chosen papers with coordinates, from the stored layout when it is still valid.

    A layout is stored under the key of its selection, of the method and of all its options, and
    is valid while no partition of the selection is missing or newer. A new layout is a new version;
    readers of an earlier one keep its files.
    """
    selection = selection_of(spark, categories, year_months)
    key = selection_hash(selection).first()["key"]
    target = f"{layouts_path}/key={key}/options={options_key(method=method, **options)}"
    if use_cache and _stored_layout_valid(spark, selection, embedded_path, latest(spark, target)):
        return with_year_month(read_published(spark, target))
    refuse_mixed_models(spark, embedded_path, categories, year_months)
    papers = assemble(read_embeddings(spark, embedded_path), categories, year_months)
    if papers.isEmpty():
        raise ValueError("the selection holds no embedded partition")
    papers = cut(papers, "assembled")
    result = add_layout(papers, method, **options)
    if not use_cache:
        return result
    publish(result, target)
    return read_published(spark, target)


def _stored_layout_valid(
    spark: SparkSession, selection: DataFrame, embedded_path: str, target: str | None
) -> bool:
    if target is None:
        return False
    embedded = partition_manifest(spark, embedded_path, EMBEDDED_PAPER, with_counts=False)
    manifest = embedded.select(
        *KEYS,
        F.lit(True).alias("embedded"),
        F.unix_millis("modified_at").alias("embedded_at"),
    )
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    status = marker.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(marker)
    stored = spark.createDataFrame(
        [("request", status.getModificationTime())], "selection_id string, layout_at long"
    )
    return layout_cache_valid(selection, manifest, stored).first()["is_valid"]


def run(
    spark: SparkSession,
    landed_path: str,
    embedded_path: str,
    layouts_path: str,
    published_path: str,
    embedder: Embedder,
    now: str,
    categories: Sequence[str] = DEFAULT_CATEGORIES,
    year_months: Sequence[tuple[str, str]] | None = None,
    **options: int,
) -> DataFrame:
    """Embed what is missing, assemble, lay out, publish; by default for the current month.

    Returns the totals of the run.
    """
    year_months = year_months or [tuple(now.split("-"))]
    with scratch(spark):
        plan = embed_missing(
            spark, landed_path, embedded_path, embedder, categories, year_months, now
        )
        dataset = combine_and_layout(
            spark, embedded_path, layouts_path, categories, year_months, **options
        )
        publish(dataset, published_path, cluster_by=("year_month", "arxiv_id"))
        chosen = scan_selection(read_embeddings(spark, embedded_path), categories, year_months)
        totals = catalog.run_totals(plan, catalog.partition_counts(chosen))
        # One row; the plan goes with the folder.
        return spark.createDataFrame(totals.collect(), totals.schema)

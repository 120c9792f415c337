"""The partitioned corpus: one table with Hive partitions subject / year / month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text as X
from folioscope.operators.prepare import dedupe
from folioscope.schemas import KEYED_PAPER, KEYS, RAW_PAPER
from folioscope.session import cut


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table with an explicit schema; empty when nothing was written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_raw_corpus(spark: SparkSession, path: str, schema: T.StructType = RAW_PAPER) -> DataFrame:
    """Raw metadata before it is keyed."""
    return read_table(spark, path, schema)


def read_corpus(
    spark: SparkSession, path: str, schema: T.StructType = KEYED_PAPER
) -> DataFrame:
    """The whole keyed corpus. Key columns stay strings, so ``'01'`` is ``'01'``."""
    return read_table(spark, path, schema)


def scan_subject_month(corpus: DataFrame, subject: str, year: str, month: str) -> DataFrame:
    return corpus.where(
        (F.col("subject") == subject) & (F.col("year") == year) & (F.col("month") == month)
    )


def scan_subjects_month(
    corpus: DataFrame, subjects: Sequence[str], year: str, month: str
) -> DataFrame:
    return corpus.where(
        F.col("subject").isin(list(subjects)) & (F.col("year") == year) & (F.col("month") == month)
    )


def scan_subject_year(
    corpus: DataFrame, subject: str, year: str, months: Sequence[str]
) -> DataFrame:
    return corpus.where(
        (F.col("subject") == subject) & (F.col("year") == year) & F.col("month").isin(list(months))
    )


def scan_selection(
    corpus: DataFrame, categories: Sequence[str], year_months: Sequence[tuple[str, str]]
) -> DataFrame:
    """Every category in every chosen month.

    The predicate is on partition columns only, so files of other partitions are never opened.
    One ``IN`` list per year keeps it short for long ranges.
    """
    by_year: dict[str, list[str]] = {}
    for year, month in year_months:
        by_year.setdefault(year, []).append(month)
    chosen = F.lit(False)
    for year, months in sorted(by_year.items()):
        chosen = chosen | ((F.col("year") == year) & F.col("month").isin(sorted(set(months))))
    return corpus.where(F.col("subject").isin(list(categories)) & chosen)


def scan_partitions(corpus: DataFrame, partitions: DataFrame) -> DataFrame:
    """Rows of the partitions listed in a (subject, year, month) table.

    The list is at most categories x months long; the semi join on partition columns becomes
    dynamic partition pruning.
    """
    return corpus.join(partitions.select(*KEYS).distinct(), list(KEYS), "left_semi")


def write_partitioned(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    dynamic: bool = False,
    max_records_per_file: int = 2_000_000,
) -> None:
    """Write with one directory per (subject, year, month); the keys are not in the files.

    The rebalance hint gathers a partition into few files and lets Spark split one that is far
    larger than the rest, so a hot month is not written by a single task.
    """
    (
        df.hint("rebalance", *[F.col(k) for k in KEYS])
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*KEYS)
        .parquet(path)
    )


def land_partitions(
    staged: DataFrame, path: str, landed: DataFrame, force: bool = False
) -> DataFrame:
    """Write staged partitions that are not landed yet, or all of them when ``force``.

    Returns the (subject, year, month) rows that were written.
    """
    todo = staged.select(*KEYS).distinct()
    if not force:
        todo = todo.join(landed.select(*KEYS).distinct(), list(KEYS), "left_anti")
    todo = cut(todo, "landing")  # the landed table changes below
    write_partitioned(scan_partitions(staged, todo), path, dynamic=True)
    return todo


def load_month_all_subjects(
    corpus: DataFrame, year: str, month: str, key: str = "arxiv_id"
) -> DataFrame:
    """All subjects of a month, one row per paper."""
    chosen = corpus.where((F.col("year") == year) & (F.col("month") == month))
    return dedupe(chosen, key)


def materialise_month(
    corpus: DataFrame, path: str, year: str, month: str, now: str, force: bool = False
) -> DataFrame:
    """The deduplicated month as a stored table.

    It is built when absent or half-written, when forced and for the current month; else it is read.
    """
    spark = corpus.sparkSession
    target = f"{path}/year={year}/month={month}"
    current = now == f"{year}-{month}"
    if force or current or not path_exists(spark, f"{target}/_SUCCESS"):
        month_rows = load_month_all_subjects(corpus, year, month).drop("year", "month")
        month_rows.write.mode("overwrite").parquet(target)
    schema = T.StructType([f for f in corpus.schema.fields if f.name not in ("year", "month")])
    stored = spark.read.schema(schema).parquet(target)
    return stored.withColumns({"year": F.lit(year), "month": F.lit(month)})


def union_partitions(*frames: DataFrame) -> DataFrame:
    """Vertical concatenation by column name; columns a generation lacks become null."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def with_year_month(df: DataFrame) -> DataFrame:
    """Add ``year_month`` unless it is there; null when there is no date to parse."""
    if "year_month" in df.columns:
        return df
    if "submission_date" not in df.columns:
        return df.withColumn("year_month", F.lit(None).cast("string"))
    return df.withColumn("year_month", X.year_month("submission_date"))


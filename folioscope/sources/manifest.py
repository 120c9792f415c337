"""What exists: one row per (subject, year, month) partition, read from the file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.schemas import KEYS
from folioscope.sources.corpus import path_exists, read_table

FILE_MANIFEST = T.StructType(
    [
        *[T.StructField(k, T.StringType()) for k in KEYS],
        T.StructField("n_rows", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("n_files", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
    ]
)


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Data files below ``path`` with their partition keys; no file content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    listed = files.select("path", "length", "modificationTime")
    for key in KEYS:
        value = F.regexp_extract("path", f"/{key}=([^/]+)/", 1)
        listed = listed.withColumn(key, F.url_decode(value))
    return listed


def partition_manifest(
    spark: SparkSession, path: str, schema: T.StructType, with_counts: bool = True
) -> DataFrame:
    """Size over all files, newest change and, if wanted, row count of each partition.

    Counting scans with an empty column list, so only row group headers are read.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], FILE_MANIFEST)
    if not with_counts:
        return (
            file_listing(spark, path)
            .groupBy(*KEYS)
            .agg(
                F.lit(None).cast("long").alias("n_rows"),
                F.sum("length").alias("size_bytes"),
                F.count("*").alias("n_files"),
                F.max("modificationTime").alias("modified_at"),
            )
        )
    rows = read_table(spark, path, schema).select(
        *KEYS,
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    per_file = rows.groupBy(*KEYS, "file").agg(
        F.count("*").alias("n"), F.max("size").alias("size"), F.max("modified").alias("modified")
    )
    return per_file.groupBy(*KEYS).agg(
        F.sum("n").alias("n_rows"),
        F.sum("size").alias("size_bytes"),
        F.count("*").alias("n_files"),
        F.max("modified").alias("modified_at"),
    )


def catalog_manifest(upstream: DataFrame, landed: DataFrame, embedded: DataFrame) -> DataFrame:
    """Partitions of three tables side by side, in the manifest schema.

    ``n_rows`` is the landed count (0 where it was not taken), ``size_bytes`` the upstream size
    (landed when unknown there).
    """
    up = upstream.select(*KEYS, F.col("size_bytes").alias("up_size"))
    land = landed.select(
        *KEYS,
        F.col("n_rows").alias("land_rows"),
        F.col("size_bytes").alias("land_size"),
        F.lit(True).alias("landed"),
    )
    emb = embedded.select(*KEYS, F.unix_timestamp("modified_at").alias("embedded_at"))
    joined = up.join(land, list(KEYS), "full_outer").join(emb, list(KEYS), "full_outer")
    return joined.select(
        *KEYS,
        F.coalesce("land_rows", F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce("up_size", "land_size", F.lit(0)).cast("long").alias("size_bytes"),
        F.coalesce("landed", F.lit(False)).alias("downloaded"),
        F.col("embedded_at").isNotNull().alias("embedded"),
        F.col("embedded_at").cast("long").alias("embedded_at"),
    )

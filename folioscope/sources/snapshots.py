"""Published tables: every publication is a new folder, readers take the latest complete one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from folioscope.sources.corpus import path_exists


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions; a version is complete once its marker file is there."""
    if not path_exists(spark, root):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v") and path_exists(spark, f"{root}/{name}/_SUCCESS"):
            found.append(int(name[1:]))
    return sorted(found)


def publish(
    df: DataFrame, root: str, version: int | None = None, cluster_by: Sequence[str] = ()
) -> str:
    """Write the next (or the given) version. Readers of the previous one are not disturbed.

    ``cluster_by`` sorts the rows over the files, so that a filter on these columns skips most of
    them; a unique last column lets a hot value spread over many files.
    """
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    if version is None:
        version = max(_versions(df.sparkSession, root), default=0) + 1
    target = f"{root}/v{version:08d}"
    df.write.mode("overwrite").parquet(target)
    return target


def latest(spark: SparkSession, root: str) -> str | None:
    """Path of the latest version, or None when nothing is published."""
    versions = _versions(spark, root)
    return f"{root}/v{versions[-1]:08d}" if versions else None


def read_published(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest version, or None when nothing is published."""
    path = latest(spark, root)
    return spark.read.parquet(path) if path else None

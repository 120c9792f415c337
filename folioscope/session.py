"""Session settings and the shared folder for written tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
FALLBACK_CONF = "spark.folioscope.sharedDir"
SHIPPED_CONF = "spark.folioscope.shippedTo"


def build_session(
    app: str = "folioscope",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings the operators are designed for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # '01' must come back as '01', not as the number 1.
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Hand this package to the Python workers of the application, once."""
    if spark.conf.get(SHIPPED_CONF, None) != spark.sparkContext.applicationId:
        here = Path(__file__).parent
        base = Path(tempfile.mkdtemp(prefix="folioscope-package-")) / here.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", here.parent, here.name))
        spark.conf.set(SHIPPED_CONF, spark.sparkContext.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets its own temporary folder.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.conf.get(FALLBACK_CONF, None)
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="folioscope-")
    spark.conf.set(FALLBACK_CONF, path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; inside ``scratch``, in its folder."""
    folder = _scratch[-1] if _scratch else f"{shared_dir(spark)}/folioscope"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """One folder for all that ``cut`` writes inside; it is removed when the last user leaves.

    Results that are still to be read from it must be written elsewhere before. A scope inside
    another one uses that one's folder, so what it returns can be read there. The folder goes through
    the Hadoop file system, also when the work inside fails.
    """
    folder = _scratch[-1] if _scratch else f"{shared_dir(spark)}/folioscope/run-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.pop()
        if not _scratch:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage.

    A lost executor can then never trigger the recomputation of what came before.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

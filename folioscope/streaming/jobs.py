"""Structured Streaming jobs over a staging folder of raw papers.

Each job takes what is there, stops, and goes on from its checkpoint the next time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.embedding import Embedder, embed_papers, model_name
from folioscope.operators.prepare import prepare
from folioscope.plans.incremental import record_models, write_embeddings
from folioscope.schemas import KEYS, RAW_PAPER
from folioscope.sources.corpus import path_exists, read_corpus, scan_partitions, with_year_month
from folioscope.sources.snapshots import publish

MERGED = 8  # folders of ids that become one
IDS_IN_FILE = 1_000_000


def read_staging(spark: SparkSession, staging: str, max_files: int = 1000) -> DataFrame:
    """Raw papers as a stream; ``max_files`` bounds what one micro-batch reads."""
    reader = spark.readStream.schema(RAW_PAPER).option("maxFilesPerTrigger", max_files)
    return reader.parquet(staging)


def stream_land(staged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Key the papers and append them to the partitioned corpus, each file exactly once."""
    return (
        prepare(staged)
        .hint("rebalance", *KEYS)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*KEYS)
        .trigger(availableNow=True)
        .start()
    )


def stream_embed(
    staged: DataFrame, landed_path: str, embedded_path: str, checkpoint: str, embedder: Embedder
) -> StreamingQuery:
    """Embed every partition a micro-batch touches and replace it in the embedded table.

    The papers must be landed already. A touched partition is read in full from the landed table,
    so a repeated batch gives the same result.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        touched = prepare(batch).select(*KEYS).distinct()
        papers = scan_partitions(read_corpus(spark, landed_path), touched)
        write_embeddings(embed_papers(papers, embedder), embedded_path)
        record_models(touched, embedded_path, model_name(embedder))

    return (
        staged.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_in_batch(key: str) -> Column:
    """True for the first row of each key within an Arrow batch; only the key goes to Python."""

    @arrow_udf("boolean")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            codes = part.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.zeros(len(codes), dtype=bool)
            first[np.unique(codes, return_index=True)[1]] = True
            yield pa.array(first)

    # Depends on the batch, so no other filter may be moved across it.
    return run.asNondeterministic()(key)


def first_arrivals(
    staged: DataFrame, key: str = "arxiv_id", event_time: str | None = None, delay: str = "7 days"
) -> DataFrame:
    """The first row of each key.

    Without an event time all keys ever seen stay in state; with one, only those of the last
    ``delay``. Repetitions are first dropped within each Arrow batch, so that a hot key sends few
    rows to the task that holds its state.
    """
    thinned = staged.where(first_in_batch(key))
    if event_time is None:
        return thinned.dropDuplicates([key])
    return thinned.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def stream_dedupe(
    staged: DataFrame, path: str, checkpoint: str, event_time: str | None = None
) -> StreamingQuery:
    """Append papers whose id was not seen before."""
    return (
        first_arrivals(staged, event_time=event_time)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_stats(
    staged: DataFrame, path: str, checkpoint: str, by: str = "primary_subject"
) -> StreamingQuery:
    """Keep a published table of paper counts per subject or per year-month up to date.

    The complete result is as small as the list of subjects or months. Each micro-batch writes
    the next free version, also after a start with a new checkpoint; a repeated one writes the same
    counts again.
    """
    papers = with_year_month(staged)
    counts = papers.groupBy(by).count().withColumnRenamed("count", "n_papers")

    def write(batch: DataFrame, number: int) -> None:
        publish(batch, path)

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _ids_folder(ids_path: str, first: int, level: int) -> str:
    """Where the ids of ``MERGED ** level`` batches from ``first`` on are kept."""
    return f"{ids_path}/" + (f"merged={level}-{first}" if level else f"batch={first}")


def _ids_folders(spark: SparkSession, ids_path: str, number: int) -> list[str]:
    """Folders that hold the ids of the batches before ``number``, each once: the largest ones there are."""
    found, first = [], 0
    while first < number:
        level = 0
        while first % MERGED ** (level + 1) == 0 and first + MERGED ** (level + 1) <= number:
            level += 1
        while level and not path_exists(spark, f"{_ids_folder(ids_path, first, level)}/_SUCCESS"):
            level -= 1
        folder = _ids_folder(ids_path, first, level)
        if level or path_exists(spark, folder):
            found.append(folder)
        first += MERGED**level
    return found


def _read_ids(spark: SparkSession, folders: list[str], key: str, kind: str) -> DataFrame:
    """The (key, bucket) rows of some folders, of which those of earlier versions have a folder a bucket."""
    parts = [spark.read.schema(f"{key} {kind}, bucket int").parquet(f).select(key, "bucket") for f in folders]
    return reduce(DataFrame.unionByName, parts)


def _write_ids(ids: DataFrame, folder: str) -> None:
    """Few files in the order of buckets, so that readers pass over those they do not need."""
    files = max(1, math.ceil(ids.count() / IDS_IN_FILE))
    ids.repartition(files, "bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(folder)


def stream_land_new(
    staged: DataFrame, path: str, ids_path: str, checkpoint: str, key: str = "arxiv_id", buckets: int = 64
) -> StreamingQuery:
    """Append papers whose id was not seen before, without any state in the stream.

    The ids seen so far are a table of their own, in ``buckets`` by hash; each batch reads the
    buckets that its ids fall into, and meets them with an anti join. What a batch writes goes to a
    folder of its number, so a batch that is repeated writes the same rows again and no more. The ids
    of every ``MERGED`` batches are written once more into one folder, those of as many such folders
    into a larger one, and so on; the folders that a batch reads grow with the logarithm of its
    number. Null ids count as one id.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, kind = batch.sparkSession, batch.schema[key].dataType.simpleString()
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
        rows = batch.dropDuplicates([key]).select("*", bucket)
        if folders := _ids_folders(spark, ids_path, number):
            touched = [r["bucket"] for r in batch.select(bucket).distinct().collect()]
            seen = _read_ids(spark, folders, key, kind).where(F.col("bucket").isin(touched)).select(
                F.col(key).alias("seen_id"), F.col("bucket").alias("seen_bucket")
            )
            same = (F.col("bucket") == F.col("seen_bucket")) & F.col(key).eqNullSafe(F.col("seen_id"))
            rows = rows.join(seen, same, "left_anti")
        new = rows.persist()
        new.drop("bucket").write.mode("overwrite").parquet(f"{path}/batch={number}")
        _write_ids(new.select(key, "bucket"), _ids_folder(ids_path, number, 0))
        new.unpersist()
        level, end = 1, number + 1
        while end % MERGED**level == 0:
            firsts = range(end - MERGED**level, end, MERGED ** (level - 1))
            parts = [_ids_folder(ids_path, first, level - 1) for first in firsts]
            if not all(path_exists(spark, f"{part}/_SUCCESS") for part in parts):
                break
            _write_ids(_read_ids(spark, parts, key, kind), _ids_folder(ids_path, firsts[0], level))
            level += 1

    return (
        staged.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

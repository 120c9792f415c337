from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from folioscope.operators import prepare
from folioscope.operators.embedding import HashedWords, embed_papers
from folioscope.plans import incremental
from folioscope.registry import base as B
from folioscope.schemas import EMBEDDED_PAPER, KEYED_PAPER, KEYS
from folioscope.session import new_path, shared_dir
from folioscope.sources import corpus, manifest, snapshots
from folioscope.streaming import jobs

MONTHS = [("2023", "03"), ("2023", "04")]


@pytest.fixture(scope="module")
def landed(spark, small):
    path = new_path(spark, "landed")
    corpus.write_partitioned(B.keyed(spark, small), path)
    return path


def test_missing_table_is_empty_with_schema(spark):
    empty = corpus.read_corpus(spark, new_path(spark, "nothing"))
    assert empty.schema == KEYED_PAPER and empty.count() == 0
    assert manifest.partition_manifest(spark, new_path(spark, "nothing"), KEYED_PAPER).count() == 0


def test_shared_folder_is_the_one_the_session_names():
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs:/shared/"})
    assert shared_dir(named) == "hdfs:/shared"
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_months_stay_strings(spark, landed):
    months = {r[0] for r in corpus.read_corpus(spark, landed).select("month").distinct().collect()}
    assert "03" in months


def test_dynamic_write_keeps_other_partitions(spark, small):
    path = new_path(spark, "dynamic")
    rows = B.keyed(spark, small)
    corpus.write_partitioned(rows, path)
    before = corpus.read_corpus(spark, path).count()
    one = rows.where("subject = 'cs.AI' AND year = '2023' AND month = '03'")
    corpus.write_partitioned(one, path, dynamic=True)
    assert corpus.read_corpus(spark, path).count() == before


def test_listing_and_counting_manifests_agree(spark, landed):
    counted = manifest.partition_manifest(spark, landed, KEYED_PAPER).drop("n_rows")
    listed = manifest.partition_manifest(spark, landed, KEYED_PAPER, with_counts=False).drop("n_rows")
    assert sorted(counted.collect()) == sorted(listed.collect())


def test_landing_skips_what_is_landed(spark, landed):
    path = new_path(spark, "landing")
    staged = corpus.read_corpus(spark, landed)
    none = manifest.partition_manifest(spark, path, KEYED_PAPER)
    first = corpus.land_partitions(staged, path, none)
    assert first.count() == staged.select(*KEYS).distinct().count()
    now = manifest.partition_manifest(spark, path, KEYED_PAPER)
    assert corpus.land_partitions(staged, path, now).count() == 0
    assert corpus.land_partitions(staged, path, now, force=True).count() == first.count()
    assert corpus.read_corpus(spark, path).count() == staged.count()


def test_month_is_rebuilt_only_when_current_or_forced(spark, small):
    path = new_path(spark, "month")
    rows = B.keyed(spark, small)

    def build(frame, **options):
        return corpus.materialise_month(frame, path, "2023", "03", options.pop("now", "2024-06"), **options).count()

    n = build(rows)
    assert n > 0
    assert build(rows.limit(0)) == n
    assert build(rows.limit(0), now="2023-03") == 0
    assert build(rows, force=True) == n


@pytest.mark.parametrize("n", [0, 1, 37, 199, 200, 500])
def test_sample_is_exact_and_repeatable(spark, small, n):
    rows = B.papers(spark, small)
    ids = sorted(r[0] for r in prepare.sample_rows(rows, n).select("arxiv_id").collect())
    assert len(ids) == (min(n, 200) if n else 200)
    again = prepare.sample_rows(rows.repartition(5), n).select("arxiv_id").collect()
    assert ids == sorted(r[0] for r in again)


def test_dedupe_keeps_the_first(spark):
    rows = [("a", "z", "2023", "01"), ("a", "b", "2024", "01"), ("a", "b", "2023", "02"), ("c", None, "2023", "01")]
    df = spark.createDataFrame(rows, "arxiv_id string, subject string, year string, month string")
    kept = sorted(tuple(r) for r in prepare.dedupe(df).collect())
    assert kept == [("a", "b", "2023", "02"), ("c", None, "2023", "01")]


def test_subject_codes_without_a_subjects_column(spark, small):
    rows = B.keyed(spark, small).drop("subjects")
    coded = prepare.paper_projection(rows)
    assert coded.where(F.col("subject_codes") != F.array("subject")).count() == 0


def test_year_month_without_a_date(spark):
    df = corpus.with_year_month(spark.range(1))
    assert df.first()["year_month"] is None


def test_published_versions(spark):
    root = new_path(spark, "published")
    assert snapshots.read_published(spark, root) is None
    snapshots.publish(spark.range(3), root)
    old = snapshots.read_published(spark, root)
    snapshots.publish(spark.range(5), root)
    assert old.count() == 3
    assert snapshots.read_published(spark, root).count() == 5


def test_published_rows_are_clustered(spark, small):
    root = new_path(spark, "clustered")
    snapshots.publish(B.current(spark, small, vectors=False), root, cluster_by=("year_month", "arxiv_id"))
    rows = snapshots.read_published(spark, root)
    files = rows.where("year_month = '2023-05'").select(F.input_file_name()).distinct().count()
    assert rows.count() == 200 and 1 <= files <= 2


def test_hashed_words():
    import pandas as pd

    model = HashedWords(16)
    vectors = model(pd.Series(["Alpha beta", "beta ALPHA", "", "alpha"]))
    assert vectors.shape == (4, 16)
    assert (vectors[0] == vectors[1]).all()
    assert (vectors[2] == 0).all()
    assert abs((vectors[3] ** 2).sum() - 1) < 1e-12


def test_embedding_twice_does_nothing_more(spark, landed):
    path, model = new_path(spark, "embedded"), HashedWords()
    arguments = (spark, landed, path, model, ["cs.AI", "gr-qc"], MONTHS)
    first = incremental.embed_missing(*arguments, "2024-06")
    assert first.where("action = 'embed'").count() > 0
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    before = sorted(r[0] for r in files.select("path").collect())
    second = incremental.embed_missing(*arguments, "2024-06")
    assert second.where("action = 'embed'").count() == 0
    after = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    assert sorted(r[0] for r in after.select("path").collect()) == before
    current = incremental.embed_missing(*arguments, "2023-03")
    assert current.where("action = 'embed' AND month = '03'").count() > 0


def test_layout_is_reused_until_a_partition_is_newer(spark, landed):
    embedded, layouts, model = new_path(spark, "embedded"), new_path(spark, "layouts"), HashedWords()
    categories = [
        r["subject"]
        for r in corpus.read_corpus(spark, landed).where("year = '2023' AND month = '03'").select("subject").distinct().collect()
    ]
    months = [("2023", "03")]
    incremental.embed_missing(spark, landed, embedded, model, categories, months, "2024-06")

    def lay(seed, method="pca"):
        rows = incremental.combine_and_layout(spark, embedded, layouts, categories, months, method=method, seed=seed)
        return rows.count(), rows.inputFiles()

    first = lay(1)
    assert lay(1) == first
    other = lay(2)
    assert other[0] == first[0] and not set(other[1]) & set(first[1])
    assert not set(lay(1, "umap")[1]) & set(first[1])
    incremental.embed_missing(spark, landed, embedded, model, categories, months, "2024-06", force=True)
    third = lay(1)
    assert third[0] == first[0] and third[1] != first[1]
    with pytest.raises(ValueError, match="no embedded partition"):
        incremental.combine_and_layout(spark, embedded, layouts, ["no-such"], months)


def test_stream_and_batch_give_the_same_table(spark, small):
    raw, half = B.papers(spark, small), F.length("abstract") % 2 == 0
    staging, out, checkpoint = (new_path(spark, n) for n in ("staging", "out", "checkpoint"))
    raw.where(half).write.parquet(staging)
    jobs.stream_land(jobs.read_staging(spark, staging), out, checkpoint).awaitTermination()
    raw.where(~half).write.mode("append").parquet(staging)
    for _ in range(2):  # the second start finds nothing new
        jobs.stream_land(jobs.read_staging(spark, staging), out, checkpoint).awaitTermination()
    batch = prepare.prepare(raw).select("arxiv_id", *KEYS)
    stream = corpus.read_corpus(spark, out).select("arxiv_id", *KEYS)
    assert sorted(stream.collect()) == sorted(batch.collect())


def test_stream_embed_equals_batch(spark, small, landed):
    staging, out, checkpoint = (new_path(spark, n) for n in ("staging", "out", "checkpoint"))
    B.papers(spark, small).write.parquet(staging)
    model = HashedWords()
    jobs.stream_embed(jobs.read_staging(spark, staging), landed, out, checkpoint, model).awaitTermination()
    stream = incremental.read_embeddings(spark, out)
    batch = embed_papers(corpus.read_corpus(spark, landed), model).select(*EMBEDDED_PAPER.names)
    assert stream.count() == batch.count()
    assert stream.exceptAll(batch).count() == 0


def test_watermarked_dedupe(spark):
    stream = spark.readStream.format("rate").load().withColumn("arxiv_id", F.col("value").cast("string"))
    plan = jobs.first_arrivals(stream, event_time="timestamp")._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark" in plan


def test_repetitions_are_dropped_before_the_state(spark):
    rows = spark.range(0, 3000, 1, 1).withColumn("arxiv_id", F.when(F.col("id") % 3 > 0, "hot"))
    kept = rows.where("id >= 5").where(jobs.first_in_batch("arxiv_id"))
    assert sorted(r["id"] for r in kept.collect()) == [5, 6]

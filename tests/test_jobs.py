"""Models built once a worker, models that do not mix, streams without state, folders that go."""

import os
import tempfile
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.operators import embedding, layout
from folioscope.operators.embedding import HashedWords, LoadedModel, embed, model_name
from folioscope.plans import incremental
from folioscope.registry import base as B
from folioscope.schemas import RAW_PAPER
from folioscope.session import cut, new_path, scratch, shared_dir
from folioscope.streaming import jobs

MONTHS = [("2023", f"{m:02d}") for m in range(1, 13)]


def test_a_model_is_built_once_in_a_worker(spark):
    seen = tempfile.mkdtemp(prefix="built-")

    def factory():
        tempfile.mkstemp(prefix=f"{os.getpid()}-", dir=seen)
        return HashedWords(4)

    texts = spark.range(4000).select(F.concat(F.lit("word "), "id").alias("text")).repartition(24)
    model = LoadedModel("counted", factory)
    for _ in range(2):
        assert embed(texts, model).where("embedding is null").count() == 0
    workers = [p.name.split("-")[0] for p in Path(seen).iterdir()]
    assert workers and len(workers) == len(set(workers))
    want = HashedWords(4)(pd.Series(["word 7"]))[0].tolist()
    got = embed(texts.where("text = 'word 7'"), model).first()["embedding"]
    assert got == pytest.approx(want, abs=1e-6)


def test_names_of_models():
    assert model_name(LoadedModel("small v2", HashedWords)) == "small v2"
    assert model_name(HashedWords(8)) == "HashedWords dim=8" != model_name(HashedWords(16))


def test_another_model_embeds_again_and_models_do_not_mix(spark, small):
    landed, path = B.landed_path(spark, small), new_path(spark, "embedded")

    def run(model, categories):
        plan = incremental.embed_missing(spark, landed, path, model, categories, MONTHS, B.NOW)
        return plan.where("action <> 'skip' and downloaded")

    assert run(HashedWords(8), ["cs.AI", "cs.LG"]).count()
    assert run(HashedWords(8), ["cs.AI", "cs.LG"]).count() == 0
    again = run(HashedWords(16), ["cs.AI"])
    assert {r["subject"] for r in again.collect()} == {"cs.AI"}
    sizes = incremental.read_embeddings(spark, path).where("embedding is not null")
    sizes = sizes.select("subject", F.size("embedding").alias("n")).distinct()
    assert sorted(map(tuple, sizes.collect())) == [("cs.AI", 16), ("cs.LG", 8)]
    with pytest.raises(ValueError, match="different models"):
        incremental.combine_and_layout(spark, path, new_path(spark, "layouts"), ["cs.AI", "cs.LG"], MONTHS)


def test_ids_of_earlier_batches_need_no_state(spark):
    staging, path, ids, checkpoint = (new_path(spark, p) for p in ("staging", "papers", "ids", "checkpoint"))
    rng = np.random.default_rng(1)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in RAW_PAPER.fields}
    arrived, states = set(), []
    for _ in range(10):
        keys = [f"p{k}" for k in rng.integers(0, 60, 40)] + ["hot"] * 40
        arrived |= set(keys)
        rows = spark.createDataFrame([(k,) for k in keys], "k string").select(
            *[(F.col("k") if c == "arxiv_id" else v).alias(c) for c, v in blank.items()]
        )
        rows.write.mode("append").parquet(staging)
        query = jobs.stream_land_new(jobs.read_staging(spark, staging), path, ids, checkpoint)
        query.awaitTermination()
        states.append(sum(len(p.stateOperators) for p in query.recentProgress))
        landed = [r[0] for r in spark.read.schema(RAW_PAPER).parquet(path).select("arxiv_id").collect()]
        assert sorted(landed) == sorted(arrived)
    assert states == [0] * 10


def test_a_repeated_batch_writes_nothing_twice(spark, small):
    staging, path, ids = (new_path(spark, p) for p in ("staging", "papers", "ids"))
    B.papers(spark, small).write.parquet(staging)
    for _ in range(2):  # the second checkpoint knows nothing, so batch 0 comes again
        jobs.stream_land_new(jobs.read_staging(spark, staging), path, ids, new_path(spark, "checkpoint")).awaitTermination()
    landed = spark.read.schema(RAW_PAPER).parquet(path)
    assert landed.count() == landed.select("arxiv_id").distinct().count() == B.papers(spark, small).count()


def test_ids_of_many_batches_are_few_files(spark, monkeypatch):
    monkeypatch.setattr(jobs, "MERGED", 2)
    staging, path, ids, checkpoint = (new_path(spark, p) for p in ("staging", "papers", "ids", "checkpoint"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_PAPER.fields if f.name != "arxiv_id"]
    for k in range(11):
        key = F.when(F.col("id") != 5, F.concat(F.lit("p"), F.col("id") + 40 * (k % 6))).alias("arxiv_id")
        spark.range(0, 60, 1, 1).select(key, *blank).write.mode("append").parquet(staging)
    jobs.stream_land_new(jobs.read_staging(spark, staging, 1), path, ids, checkpoint).awaitTermination()
    landed = [r[0] for r in spark.read.schema(RAW_PAPER).parquet(path).select("arxiv_id").collect()]
    want = {f"p{i + 40 * (k % 6)}" for k in range(11) for i in range(60) if i != 5} | {None}
    assert len(landed) == len(want) and set(landed) == want
    names = [f.removeprefix(f"{ids}/") for f in jobs._ids_folders(spark, ids, 11)]
    assert names == ["merged=3-0", "merged=1-8", "batch=10"]
    files = list(Path(ids.removeprefix("file:")).rglob("*.parquet"))
    assert len(files) <= 11 + 5 + 2 + 1
    # Ids that an earlier version kept by bucket are read as well.
    jobs._read_ids(spark, [f"{ids}/batch=0"], "arxiv_id", "string").write.partitionBy("bucket").parquet(f"{ids}/old")
    both = jobs._read_ids(spark, [f"{ids}/old", f"{ids}/merged=1-8"], "arxiv_id", "string")
    assert both.select("arxiv_id").union(spark.read.parquet(f"{ids}/batch=10").select("arxiv_id")).count() >= 60
    assert both.where("bucket IS NULL").isEmpty()


def folders(spark, pattern):
    return set(Path(shared_dir(spark).removeprefix("file:")).glob(f"folioscope/{pattern}"))


def test_scratch_folders_go_with_the_last_user(spark, small):
    rows = B.current(spark, small).select("arxiv_id", "embedding")
    out, before = new_path(spark, "kept"), folders(spark, "run-*")
    with scratch(spark) as folder:
        with scratch(spark) as inner:
            assert inner == folder
            inside = cut(spark.range(5).toDF("id"), "inside")
        assert inside.count() == 5 and folders(spark, "run-*") != before
        layout.layout(rows).write.parquet(out)
    assert folders(spark, "run-*") == before
    assert spark.read.parquet(out).count() == rows.where("embedding is not null").count()
    with pytest.raises(RuntimeError), scratch(spark):
        cut(spark.range(5).toDF("id"), "lost")
        raise RuntimeError
    assert folders(spark, "run-*") == before


def test_a_whole_run_leaves_only_its_results(spark, small):
    landed = B.landed_path(spark, small)
    paths = [new_path(spark, p) for p in ("embedded", "layouts", "published")]
    before = folders(spark, "*")
    totals = incremental.run(spark, landed, *paths, HashedWords(8), B.NOW, year_months=MONTHS)
    assert totals.first()["papers_total"] > 0
    names = {Path(p).name for p in paths} | {Path(paths[0]).name + "-models"}
    assert {p.name for p in folders(spark, "*") - before} == names


def test_the_model_gets_texts_in_bounded_slices(spark, monkeypatch):
    monkeypatch.setattr(embedding, "SLICE_BYTES", 1000)

    def sizes(texts):
        return np.full((len(texts), 1), float(texts.str.len().sum()))

    part = pa.array([None, "x" * 5000, None] + ["é" * 150] * 20 + [None], pa.string())
    slices = list(embedding._slices(part))
    assert pa.concat_arrays(slices).equals(part)
    assert max(sum(len((t or "").encode()) for t in s.to_pylist()) for s in slices if len(s) > 1) <= 1000 < 5000
    texts = spark.createDataFrame([(i, None if i == 7 else "x" * 400_000) for i in range(40)], "id long, text string")
    rows = {r["id"]: r["embedding"] for r in embed(texts.coalesce(1), sizes).collect()}
    assert rows.pop(7) is None and 0 < max(v[0] for v in rows.values()) <= 4 << 20


def test_words_of_one_text_at_a_time_are_held():
    texts = pd.Series([" ".join(f"w{(i * j) % 997}" for j in range(1000)) for i in range(600)] + ["", "- a"])
    model = HashedWords(16)
    model(texts)  # fills the cache of words
    tracemalloc.start()
    vectors = model(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20 < texts.str.len().sum()
    assert not vectors[-2:].any() and np.linalg.norm(vectors[:-2], axis=1) == pytest.approx(1)


def test_words_of_latin_texts_are_those_of_any_text(monkeypatch):
    text = " ".join(f"a{chr(i)}{chr(i)}b{chr(j)}" for i in range(256) for j in range(0, 256, 5))
    assert embedding._words(text) == embedding._WORD.findall(text.lower())
    assert embedding._words(text + " ǅungla Привет") == embedding._WORD.findall((text + " ǅungla Привет").lower())
    monkeypatch.setattr(embedding, "WORDS_KEPT", 10)
    monkeypatch.setattr(embedding, "_slots", embedding._Slots())
    texts = pd.Series([" ".join(f"w{i % 37}" for i in range(500))])
    few = HashedWords(16)(texts)
    assert len(embedding._slots) <= 10
    monkeypatch.undo()
    assert (HashedWords(16)(texts) == few).all()

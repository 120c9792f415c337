"""The pipeline's stages one by one, on the smallest tables."""

import corpus_pipeline
from folioscope.llm import quality
from folioscope.llm.common import documents, labels


def test_stages(spark, small):
    docs = documents(spark, small)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, small).cache()
        seen[name] = docs.count()
        if name != "packing":
            assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0
    whole = documents(spark, small)
    kept = quality.score(whole, quality.fit(whole, labels(spark, small))).where("score >= 0.3").count()
    assert seen["quality classifier"] == kept > seen["n-gram Jaccard join"] == seen["personal data"]
    pieces = docs.groupBy("doc_id").sum("length").count()
    assert pieces == seen["personal data"]


def test_run_gives_the_packed_pieces(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert rows.columns[:2] == ["doc_id", "start"] and rows.count() > 0


def test_run_leaves_nothing_behind_in_a_scratch_folder(spark, small):
    from pathlib import Path

    from folioscope.session import new_path, scratch, shared_dir

    out = new_path(spark, "packed")
    before = set(Path(shared_dir(spark)).glob("folioscope/*"))
    with scratch(spark):
        corpus_pipeline.run(spark, small).write.parquet(out)
    assert {p.name for p in set(Path(shared_dir(spark)).glob("folioscope/*")) - before} == {Path(out).name}
    assert spark.read.parquet(out).count() > 0

"""The pipeline's stages, each held against brute force on its own input."""

import hashlib

import corpus_pipeline
import pytest

from resolvent.llm import langid, quality

from . import brute


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, docs):
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r.doc_id, 1, 0) for r in docs.select("doc_id").collect()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf_dir, texts):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "quality classifier", "SimHash near-dedup", "substring dedup", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = stage["language ID"](spark, docs, sf_dir)
    had = {r.doc_id: r.text for r in first.collect()}
    judged = {r.doc_id: r for r in langid.predict_languages(docs).collect()}
    assert had == {d: t for d, t in texts if judged[d].lang_pred != "und" and judged[d].excess <= langid.STRANGE}
    second = {r.doc_id for r in stage["quality classifier"](spark, first, sf_dir).collect()}
    scores = quality.score_quality(first, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert second == {r.doc_id for r in scores.collect() if r.predicted}
    third = stage["SimHash near-dedup"](spark, first, sf_dir)
    kept = {r.doc_id: r.text for r in third.collect()}
    assert sorted(kept) == sorted({c for _, c in brute.near_duplicates(list(had.items())).values()})
    fourth = {r.doc_id: r.text for r in stage["substring dedup"](spark, third, sf_dir).collect()}
    for d, _, n, h in brute.repeated_windows(list(kept.items())):
        assert fourth[d] == kept[d] if not n else hashlib.sha256(fourth[d].encode()).hexdigest() == h
    assert first.columns == third.columns == docs.columns


def test_run_is_its_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    out = corpus_pipeline.run(spark, sf_dir)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert out.columns == [*columns, "sequence_id", "offset"]
    assert sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0

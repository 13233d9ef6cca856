"""The pipeline's stages against brute-force decisions."""

import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
from lexiloom.llm import near_dups, toxicity
from lexiloom.session import BATCH_BYTES, bounded_batches
from tests.llm.test_operators import squeeze

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.written_table(stage(spark, docs, SF_DIR), f"test-{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after and set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "toxicity":
            assert len(gone & toxic) >= 0.5 * len(gone)
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(squeeze(before[i]), i)
            assert set(after) == set(first.values())
        if name == "decontaminate":
            plain = lambda t: " ".join(t.lower().split())
            assert {i for i, t in before.items() if any(plain(x) in plain(t) for x in items)} <= gone
        if name == "mix":
            assert docs.columns == [*columns, "mix_weight", "mix_probability"]
        else:
            assert docs.columns == columns


def test_run_applies_the_stages(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


def test_batches_for_workers_are_bounded(spark, monkeypatch):
    conf, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    spark.conf.unset(conf)  # a stage run alone leaves its bound
    for module in (corpus_pipeline, near_dups, toxicity):
        write = module.written_table
        monkeypatch.setattr(module, "written_table", lambda df, *a, write=write: seen.append(spark.conf.get(conf, None)) or write(df, *a))
    corpus_pipeline.run(spark, SF_DIR)
    assert len(seen) > 10 and {int(x or 64 << 20) for x in seen} == {BATCH_BYTES}
    seen.clear()
    near_dups.near_duplicates(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    assert seen and {int(x or 64 << 20) for x in seen} == {BATCH_BYTES}
    assert spark.conf.get(conf, None) is None
    spark.conf.set(conf, "1000000")
    try:
        with bounded_batches(spark):
            assert spark.conf.get(conf) == "1000000"  # the session's own limit stays
        assert spark.conf.get(conf) == "1000000"
    finally:
        spark.conf.unset(conf)


def test_scorer_holds_few_texts_at_once():
    texts = [f"word{i} you idiot " * 400 for i in range(2000)]
    model = toxicity.Model({"idiot": 3.0}, toxicity.boost(np.eye(len(toxicity.FEATURES)), np.arange(len(toxicity.FEATURES)) % 2), np.array([-1.0, 1.0]), np.array([0.1, 0.9]))
    batch = pa.array(texts)
    expected, score = model.score(texts), toxicity.toxicity_scorer(model)
    size = sum(map(len, texts))
    del texts
    tracemalloc.start()
    found = score(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == expected.tolist()
    assert peak < size / 3

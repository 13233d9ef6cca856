"""Rows of positions: cut by generated code, scored against plain Python."""

import math
import statistics

import numpy as np
import pytest
from lexiloom.operators import softlabels as S
from pyspark.sql import functions as F


@pytest.fixture
def soft(spark):
    rows = [(1, [1, 2, 3, 0, 5, 17], [0.5, 0.25, 0.25, 0.1, 0.2, 0.4], [-1.0, -2.0]), (2, [], [], []), (3, [4, 4, 4], [0.0, 0.0, 0.0], [-3.0])]
    return spark.createDataFrame(rows, "doc_id int, teacher_ids array<int>, teacher_probs array<float>, hard array<double>")


def test_positions_are_cut_without_lambdas(soft):
    out = S.per_position(soft, k=3, single=("hard",))
    got = [(r.doc_id, r.pos, r.ids, [round(p, 6) for p in r.probs], r.hard) for r in out.collect()]
    assert sorted(got) == [(1, 0, [1, 2, 3], [0.5, 0.25, 0.25], -1.0), (1, 1, [0, 5, 17], [0.1, 0.2, 0.4], -2.0), (3, 0, [4, 4, 4], [0.0] * 3, -3.0)]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_masses_of_many_rows(spark):
    rng = np.random.default_rng(4)
    rows = [[float(np.float32(x)) for x in rng.random(n) / 16] for n in rng.integers(0, 20, 301)]
    df = spark.createDataFrame([(r,) for r in rows] + [(None,)], "probs array<float>")
    out = S.top_k_mass(df)
    got = {r.cut: r for r in out.collect()}
    for cut, k in (("top8", 8), ("top16", 16)):
        masses = [sum(r[:k], 0.0) for r in rows]
        assert got[cut].n == 302  # a row without probabilities counts, but has no mass
        assert got[cut].median_mass == pytest.approx(statistics.median(round(m, 6) for m in masses), abs=1e-9)
        assert got[cut].mean_mass == pytest.approx(statistics.fmean(masses), rel=1e-12)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_divergence_of_positions(spark, soft):
    logp = np.log(np.arange(1, 20) / 200)
    per = S.per_position(soft, k=3, single=("hard",)).withColumnRenamed("hard", "hard_logp")
    rows = per.select("hard_logp", S.guarded_labels(F.col("ids"), F.col("probs"), 16).alias("labels"), (F.col("hard_logp") > -3).alias("loss_mask"))
    out = S.soft_label_divergence(rows, lambda ids: logp[ids])
    kd = []
    for ids, probs in (([1, 2, 3], [0.5, 0.25, 0.25]), ([1, 5, 1], [0.0, 0.2, 0.0])):
        m = sum(probs)
        q = [p / (m + 1e-8) for p in probs]
        kd.append(m * sum(x * (math.log(min(max(x, 1e-8), 1)) - logp[i]) for x, i in zip(q, ids)))
    r = out.first()
    assert (r.n_kl, r.n_ce) == (2, 2)
    assert r.kl == pytest.approx(sum(kd) / 2, rel=1e-6) and r.ce == pytest.approx(1.5)
    assert r.total == pytest.approx(0.2 * r.kl + 0.8 * r.ce)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    # the rows given to the worker hold what was cut, not what it was cut from
    assert "Project [slice(" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["aligned_soft_labels", "project_topk"])
def test_no_spans_are_written(spark, monkeypatch, name):
    """Of a text's tokens only the ids are written; words and spans are several times the size of the text."""
    from lexiloom.plans import QUERIES
    from lexiloom.plans import softlabels as P

    written, real = [], P.written_table

    def kept(df, *args):
        table = real(df, *args)
        written.append(df.schema)
        return table

    monkeypatch.setattr(P, "written_table", kept)
    QUERIES[name](spark, "/root/testdata/sf0.001").count()
    arrays = {f.name: f.dataType.simpleString() for schema in written for f in schema if f.dataType.typeName() == "array"}
    assert arrays == {"ids": "array<int>"}


def test_texts_are_split_once_to_be_counted(spark):
    """A plain explosion has a filter on the array's size, which makes Spark split each text three times."""
    from lexiloom.operators import bpe as B
    from lexiloom.operators import tokens as K

    docs = spark.createDataFrame([("a b, a",), ("",), ("b",)], "text string")
    counted = docs.withColumn("w", K.pieces(F.col("text"), r"\w+"))
    vocab = K.word_vocab(counted)
    assert [tuple(r) for r in vocab.collect()] == [("a", 5), ("b", 6)]
    words = {r.symbols.replace(B.OPEN, "").replace(B.CLOSE, ""): r.freq for r in B.word_table(docs).collect()}
    assert words == {"▁a": 2, "▁b": 2, "▁,": 1}
    for table, call, times in ((vocab, "regexp_extract_all(", 1), (B.word_table(docs), "regexp_replace(", 2)):
        assert table._jdf.queryExecution().optimizedPlan().toString().count(call) == times


def test_rank_table_has_positions_and_subwords(spark, tmp_path):
    """It used to leave out the positions and the decoding of the ids."""
    from lexiloom.plans import QUERIES

    docs = [(1, "a b a"), (2, "a"), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.rank, r.token): r for r in QUERIES["softlabel_rank_table"](spark, str(tmp_path)).collect()}
    names = {r.token: r.subword for r in got.values()}
    assert names[1] == "<PAD>" and set(names.values()) == {"<PAD>", "a", "b", " "}
    top = {names[token]: (r.n, r.first_pos, r.last_pos, r.pos_sum) for (rank, token), r in got.items() if rank == 1}
    # after "a" a gap (positions 0), after a gap "a" or "b" (the lesser id first), after "b" a gap
    assert top[" "] == (2, 0, 2, 2) and sum(v[0] for v in top.values()) == 4
    assert sum(r.pos_sum for r in got.values()) == 16 * (0 + 1 + 2 + 3)

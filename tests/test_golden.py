"""Golden rows: exact expected values of the text rules and statistics."""

import math

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import arrays as AR
from lexiloom.functions import fixed_values as V
from lexiloom.functions import text as T
from lexiloom.operators import evals as E
from lexiloom.operators import gates as G
from lexiloom.operators import ordering as O
from lexiloom.operators import pairs as P
from lexiloom.operators import profile as R
from lexiloom.operators import softlabels as S
from lexiloom.operators import tokens as K


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


TEXT_CASES = [
    (T.strip_html, "<b>a</b>&nbsp;b", "ab"),
    (T.normalize_quotes, "「好」", '"好"'),
    (T.strip_markdown, "a **b** c", "a b c"),
    (T.strip_markdown, "x\n---\ny", "x\n\ny"),
    (T.strip_reasoning, "<think>z\nz</think>\nanswer", "answer"),
    (P.strip_trailing_punct, "什么是R？？！ ", "什么是R"),
    (T.strip_list_marks, "见(10)和[ 12 ]", "见和"),
    (lambda c: T.remove(c, V.ITEM_NUMBERS), "1) 甲", "甲"),
    (lambda c: T.remove(c, V.SECTION_PREFIX), "16.5\n本章小结\n正文", "正文"),
    (T.strip_news_tail, "2024-01-02 10:20 发布", "发布"),
    (T.strip_news_tail, "原标题：甲", "甲"),
    (lambda c: T.squeeze_newlines(c, 3, 2), "a\n\n\n\nb", "a\n\nb"),
    (T.isolate_punct, "好，a.b", "好 ， a . b"),
    (T.detokenize, "中 文 ， a b .", "中文， a b."),
    (T.link_title, "/wiki/A%20b#c", "A b"),
    (T.strip_lead_punct, "。， 你好", "你好"),
    (T.strip_fences, '```json\n[{"name":"a"}]\n```', '[{"name":"a"}]'),
    (lambda c: T.convert_script(c, "數據", "数据"), "數據", "数据"),
    (T.tidy_pretrain, "•  **好** 的\n\n文  章", "好 的 文 章"),
]


@pytest.mark.parametrize("case", range(len(TEXT_CASES)))
def test_text_rule(spark, case):
    fn, given, expected = TEXT_CASES[case]
    assert one(spark, given, fn) == expected


@pytest.mark.parametrize("fn", [T.strip_html, T.normalize_quotes, T.strip_reasoning, T.collapse_whitespace, T.isolate_punct])
def test_idempotent(spark, fn):
    rows = ["a <b>x</b> 「好」，ok.  y", "<think>q</think>\n\nz", "  a \n b　c "]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    once = df.select(fn(F.col("t")).alias("t"))
    assert [r.t for r in once.select(fn(F.col("t")).alias("t")).collect()] == [r.t for r in once.collect()]


@pytest.mark.parametrize(
    "value, bad", [("好" * 29, True), ("好" * 30, False), ("好" * 14 + "a" * 16, True), (None, True)]
)
def test_quality_gate(spark, value, bad):
    df = spark.createDataFrame([(value,)], "text string")
    assert (G.quality_gate(df).first().drop_reason is not None) == bad


def test_two_stage_gate_keeps_every_row(spark):
    rows = [("好" * 40,), ("好" * 10 + "<b>" + "x" * 5 + "</b>" * 9,), (None,), ("好" * 20 + "<" + "好" * 20 + ">",)]
    out = G.two_stage_gate(spark.createDataFrame(rows, "text string"))
    reasons = [r.drop_reason for r in out.collect()]
    assert reasons == [None, V.GATE_INIT_REASON, V.GATE_INIT_REASON, V.GATE_POST_REASON]
    report = G.retention_report(out).first()
    assert report.n_read == report.n_kept + report.n_dropped == 4


def test_filters(spark):
    df = spark.createDataFrame([("see WWW.x.com",), ("没有",)], "text string")
    assert [r.text for r in G.without_url(df).collect()] == ["没有"]
    dense = spark.createDataFrame([("a" * 170 + "," * 30,), ("a" * 171 + "," * 29,)], "text string")
    reasons = [r.drop_reason for r in G.funnel_first_hit(dense).collect()]
    assert reasons == ["punct_density", None]
    names = spark.createDataFrame([("文森特·威廉",), ("纯净文本",)], "text string")
    assert [r.is_dirty for r in G.multi_rule_filter(names).collect()] == [True, False]
    topics = spark.createDataFrame([("File:X",), ("List_of_y",), ("Journal",), ("",), ("Data",)], "topic string")
    assert [r.topic for r in G.topic_filter(topics).collect()] == ["Data"]
    pairs = spark.createDataFrame([("问", "答" * 31 + "，"), ("问", "答" * 31 + "。")], "instruction string, output string")
    assert [r.output[-1] for r in G.pair_rules(pairs).collect()] == ["。"]


@pytest.mark.parametrize("words, dirty", [(90, False), (80, True)])
def test_entity_density(spark, words, dirty):
    df = spark.createDataFrame([([f"n{i}" for i in range(9)], ["w"] * words)], "e array<string>, w array<string>")
    assert G.entity_density(df, "e", "w").first().is_dirty == dirty


def test_masked_sample(spark):
    df = spark.createDataFrame([([11, 12], [21, 22])], "prompt_ids array<int>, response_ids array<int>")
    row = K.masked_sample(df).first()
    assert row.x[:6] == [3, 11, 12, 21, 22, 1] and row.y[:6] == [11, 12, 21, 22, 4, 1]
    assert row.loss_mask[:6] == [False, False, True, True, True, False]
    assert len(row.x) == len(row.y) == len(row.loss_mask) == 512


def test_pmi(spark):
    counts = spark.createDataFrame([(1, 2, 1), (3, 4, 6)], "x int, y int, nxy bigint")
    assert K.pmi(counts).filter("x = 1").first().pmi == pytest.approx(3.0)


def test_span_lookup_is_half_open(spark):
    df = spark.createDataFrame([([0, 3, 5, 6], [0, 3], [3, 6])], "s array<int>, a array<int>, z array<int>")
    row = df.select(S.locate_signal(F.col("s"), F.col("a"), F.col("z")).alias("p")).first().p
    assert row.j == [-1, 0, 0, -1] and row.off == [0, 0, 2, 0]


def test_projection():
    import numpy as np

    table = np.full((10, 1), 2, dtype=np.int32)
    table[6, 0], table[7, 0], table[8, 0] = 5, 5, 1
    tids, probs = np.array([6, 7, 8]), np.array([0.4, 0.3, 0.2])
    ids, p = S.project_positions(tids[None], probs[None], np.array([0]), table, 4, frozenset(V.JUNK_STUDENT_IDS), False)
    assert ids[0].tolist() == [5, 1, 1, 1] and p[0].tolist() == pytest.approx([0.7, 0, 0, 0])
    _, p = S.project_positions(tids[None], probs[None], np.array([0]), table, 4, frozenset(V.JUNK_STUDENT_IDS), True)
    assert p[0].tolist() == pytest.approx([1.0, 0, 0, 0])


def test_id_guard(spark):
    df = spark.createDataFrame([([0, 5, 99], [0.1, 0.2, 0.3])], "i array<int>, p array<double>")
    ids, probs = S.guard_ids(F.col("i"), F.col("p"), 10)
    assert tuple(df.select(ids, probs).first()) == ([1, 5, 1], [0.0, 0.2, 0.0])


def test_answers(spark):
    df = spark.createDataFrame([("3",), ("C",)], "a string")
    assert [r[0] for r in df.select(E.truth_index(F.col("a"))).collect()] == [3, 2]
    results = spark.createDataFrame([("m", i < 384) for i in range(1300)], "model string, is_correct boolean")
    assert E.accuracy_overall(results).first().accuracy == "29.54%"
    items = spark.createDataFrame([("x", "c", "p", ["A. u", "B. v"], "B. v")], "id string, category string, prompt string, options array<string>, answer string")
    assert E.adapt_generated_items(items).first().answer == 1


def test_semantic_entropy(spark):
    answers = [("p", "a b")] * 5 + [("p", "c.")] * 3 + [("p", "d")] * 2
    row = E.semantic_entropy(spark.createDataFrame(answers, "p string, r string"), "p", "r").first()
    assert row.entropy == pytest.approx(1.0297, abs=1e-4) and row.band == "hesitant"


def test_best_of_n_rejects(spark):
    df = spark.createDataFrame([("p", 1, -4.1), ("p", 2, -5.0), ("q", 1, -1.0)], "p string, c int, score double")
    out = {r.p: r.verdict for r in E.best_of_n(df, ["p"], "c").collect()}
    assert out == {"p": "rejected", "q": "accepted"}


def test_top_p_set(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.15, 0.05],)], "p array<double>")
    assert E.top_p_set_size(df, "p").first().set_size == 3


def test_watermark_statistic(spark):
    df = spark.createDataFrame([(92, 110)], "h int, n int").select(E.watermark_z(F.col("h"), F.col("n")).alias("z"))
    row = df.select("z", E.upper_tail(F.col("z")).alias("p")).first()
    assert row.z == pytest.approx(7.0556, abs=1e-4) and row.p == pytest.approx(8.59e-13, rel=0.02)


@pytest.mark.parametrize(
    "shares, status, low", [((195, 274, 344, 186), "OK", 0), ((600, 200, 100, 100), "COLLAPSE", 2)]
)
def test_routing_health(spark, shares, status, low):
    load = spark.createDataFrame([(0, e, n) for e, n in enumerate(shares)], "layer int, expert int, n bigint")
    rows = E.routing_health(load, 4).collect()
    assert {r.status for r in rows} == {status} and sum(r.is_low for r in rows) == low


def test_quota(spark):
    quota = spark.createDataFrame(list(V.QUOTA_PLAN) + [("x", "x", 120)], "category string, code string, count bigint")
    plan = O.quota_batches(quota, V.QUOTA_BATCH)
    assert [r.n_items for r in plan.filter("code = 'pat'").orderBy("batch").collect()] == [50, 50, 50]
    assert [r.n_items for r in plan.filter("code = 'x'").orderBy("batch").collect()] == [50, 50, 20]
    assert plan.filter("code != 'x'").agg(F.sum("n_items")).first()[0] == 1500


def test_loss_tail(spark):
    log = spark.createDataFrame([(1, i, float(i)) for i in range(1, 21)], "epoch int, step int, loss double")
    assert R.loss_tail_mean(log, ["epoch", "step"]).first().tail_mean == 12.5


def test_softmax(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],)], "v array<double>")
    row = df.select(AR.softmax(F.col("v")).alias("p"), AR.logsumexp(F.col("v")).alias("l")).first()
    assert row.p == [0.5, 0.5] and row.l == pytest.approx(1000 + math.log(2))

"""Blocklists, phrase maps, numbered lines, resumable chunks and frame streams."""

import time

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as V
from lexiloom.functions import text as T
from lexiloom.operators import gates as G
from lexiloom.operators import graph as GR
from lexiloom.session import scratch_path
from lexiloom.sources import arrow_files as A
from lexiloom.sources import jsonl as J
from lexiloom.sources import manifest as M
from lexiloom.streaming import frames as FR
from lexiloom.streaming import ingest as ST

PAIR_CASES = [
    (V.CHAT_INSTRUCTION_BLOCK, V.CHAT_OUTPUT_BLOCK, "介绍春天", "春天很美", True),
    (V.CHAT_INSTRUCTION_BLOCK, V.CHAT_OUTPUT_BLOCK, "介绍R", "春天很美", False),
    (V.CHAT_INSTRUCTION_BLOCK, V.CHAT_OUTPUT_BLOCK, "讲个故事", "春天很美", False),
    (V.CHAT_INSTRUCTION_BLOCK, V.CHAT_OUTPUT_BLOCK, "介绍春天", "第1点", False),
    (V.CHAT_LATE_INSTRUCTION_BLOCK, V.CHAT_LATE_OUTPUT_BLOCK, "介绍春天", "春天很美", True),
    (V.CHAT_LATE_INSTRUCTION_BLOCK, V.CHAT_LATE_OUTPUT_BLOCK, "机器人是谁", "春天很美", False),
    (V.CHAT_LATE_INSTRUCTION_BLOCK, V.CHAT_LATE_OUTPUT_BLOCK, "介绍春天", "抱歉", False),
    (V.TRIPLE_INSTRUCTION_BLOCK, V.TRIPLE_OUTPUT_BLOCK, "介绍春天", "春天很美", True),
    (V.TRIPLE_INSTRUCTION_BLOCK, V.TRIPLE_OUTPUT_BLOCK, "抱歉", "春天很美", False),
    (V.TRIPLE_INSTRUCTION_BLOCK, V.TRIPLE_OUTPUT_BLOCK, "介绍春天", "好主意", False),
]


@pytest.mark.parametrize("case", range(len(PAIR_CASES)))
def test_pair_blocklists(spark, case):
    left, right, instruction, output, kept = PAIR_CASES[case]
    df = spark.createDataFrame([(instruction, output)], "instruction string, output string")
    assert bool(G.drop_matching_pairs(df, left, right).count()) == kept


RULE_CASES = [
    (V.WRAPPER_PATTERNS[0], "请写一篇关于春天的文章。好的，以下是为您准备的文章：春天", "春天"),
    (V.WRAPPER_PATTERNS[1], "好的，我会为您写一篇短文：春天", "短文：春天"),
    (V.WRAPPER_PATTERNS[2], "春天请从上述文章中提取关键词", "春天"),
    (V.WRAPPER_PATTERNS[3], "春天提取出这篇文章的关键词", "春天"),
    (V.WRAPPER_PATTERNS[4], "春天写一篇短文", "春天"),
    (V.DEAD_PLACEHOLDERS[0], "甲请访问 。乙", "甲乙"),
    (V.DEAD_PLACEHOLDERS[1], "甲（ ，乙", "甲乙"),
    (V.DEAD_PLACEHOLDERS[2], "甲（ and ethics ）乙", "甲乙"),
    (V.LEADING_MARKS, "：? ①甲", "甲"),
    (V.LEADING_DOT, " . 甲", "甲"),
    (V.ESCAPED_QUOTE, '甲\\"乙"丙', "甲乙丙"),
    (V.TIMESTAMP, "2024-01-02  10:20甲", "甲"),
    (V.NEWS_TAIL, "甲返回搜狐，查看更多\n乙", "甲"),
    (V.NEWS_TAIL, "甲声明：本文由入驻搜狐号的作者", "甲"),
]


@pytest.mark.parametrize("case", range(len(RULE_CASES)))
def test_removed_by_pattern(spark, case):
    pattern, given, expected = RULE_CASES[case]
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(T.remove(F.col("t"), pattern)).first()[0] == expected


FUNNEL_CASES = [
    ("traditional_script", "數據"), ("service_chat", "现在几点了"), ("front_matter", "作业 3"), ("question_lead", "如何才能更有效"),
    ("stock_answer", "以下是一些方法"), ("request_lead", "我想开发"), ("step_phrases", "综上所述"),
    ("topic_phrases", "在开发解决方案时"), ("prompt_leak", "题目：春天"),
]


@pytest.mark.parametrize("name,text", FUNNEL_CASES)
def test_funnel_rule(spark, name, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert G.funnel_first_hit(df, min_chars=0).first()["drop_reason"] == name


def test_phrases_longest_first_and_not_read_again(spark):
    df = spark.createDataFrame([("头发发现",), ("",), (None,)], "t string")
    phrases = {"发": "發", "头发": "頭髮", "發現": "x"}
    assert [r[0] for r in df.select(T.convert_phrases(F.col("t"), phrases)).collect()] == ["頭髮發现", "", None]
    assert df.select(T.convert_phrases(F.col("t"), {})).first()[0] == "头发发现"


def test_numbered_lines_over_splits(spark):
    path = scratch_path(spark, "split-lines")
    lines = [(i, f"line {i} " + "x" * (i % 50)) for i in range(20000)]
    spark.createDataFrame(lines, "i int, line string").repartitionByRange(3, "i").sortWithinPartitions("i").select("line").write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        numbered = {r.line_no: r.line for r in J.numbered_lines(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert numbered == {i + 1: line for i, line in lines}


def test_resume_after_gap_and_other_settings(spark):
    path = scratch_path(spark, "resume")
    row = spark.createDataFrame([(1,)], "x int")
    assert M.resume_point(spark, path, "fp", {"k": 1}) == 0
    for k in (0, 1, 3):
        M.write_chunk(row, path, k, "fp", {"k": 1})
    assert M.resume_point(spark, path, "fp", {"k": 1}) == 2
    with pytest.raises(ValueError):
        M.resume_point(spark, path, "other", {"k": 1})
    with pytest.raises(ValueError):
        M.resume_point(spark, path, "fp", {"k": 2})
    row.write.parquet(M.chunk_path(path, 2))
    assert sorted(r.chunk for r in M.read_chunks(spark, path).collect()) == [0, 1, 3]


class _Cluster:
    """What ``shared_path`` asks of a session, with a master and a default file system of choice."""

    def __init__(self, default):
        self.sparkContext = self._jsc = self
        self.master, self.default = "spark://host:7077", default

    def hadoopConfiguration(self):
        return {"fs.defaultFS": self.default}

    def getCheckpointDir(self):
        return "file:/shared/checkpoints"


def test_shared_path():
    assert A.shared_path(_Cluster("hdfs://name:8020"), "/data/x") == "hdfs://name:8020/data/x"
    assert A.shared_path(_Cluster("hdfs://name:8020"), "s3://bucket/x") == "s3://bucket/x"
    assert A.shared_path(_Cluster("file:///"), "/shared/checkpoints/x") == "/shared/checkpoints/x"
    for path in ("/data/x", "file:/data/x", "/shared/checkpoints-of-others/x"):
        with pytest.raises(ValueError):
            A.shared_path(_Cluster("file:///"), path)


def test_relations_fall_back(spark):
    path = scratch_path(spark, "flat-relations")
    spark.createDataFrame([("a", "b")], "src string, dst string").write.parquet(path)
    empty = scratch_path(spark, "no-relations")
    spark.createDataFrame([], "src string, dst string").write.parquet(empty)
    assert [tuple(r) for r in M.load_relations(spark, [f"{path}-absent", empty, path]).collect()] == [("a", "b")]
    with pytest.raises(FileNotFoundError):
        M.load_relations(spark, [f"{path}-absent"])


def test_lost_marker_times_out(spark):
    """Without a done marker the answer comes after the timeout; a replayed frame counts once."""
    path, out = scratch_path(spark, "lost"), scratch_path(spark, "lost-out")
    rows = [("a", 0, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 0, "z"), ("b", 1, FR.DONE)]
    J.write_jsonl(spark.createDataFrame(rows, "request_id string, seq int, frame string"), path)
    arriving = ST.stream_jsonl(spark, path, "request_id STRING, seq INT, frame STRING")
    query = (
        FR.assemble_stream(arriving, timeout_ms=1000).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, "lost-state")).trigger(processingTime="500 milliseconds").start()
    )
    try:
        schema, got, until = "request_id string, answer string, n_frames int, is_done boolean", [], time.time() + 90
        while len(got) < 2 and time.time() < until:
            time.sleep(1)
            got = spark.read.schema(schema).parquet(out).collect() if query.lastProgress else []
    finally:
        query.stop()
    assert sorted(tuple(r) for r in got) == [("a", "xy", 2, False), ("b", "z", 1, True)]


def test_links_of_a_page_in_several_rows(spark):
    html = '<a href="/wiki/A%20b#x"></a><a href="/wiki/A%20b"></a><a href="/wiki/File:c"></a><a href="/wiki/D"></a>'
    pages = spark.createDataFrame([(1, html), (1, html), (2, ""), (3, None)], "page int, html string")
    once = GR.extract_links(pages.limit(1), "page", "html")
    assert sorted(tuple(r) for r in once.collect()) == [(1, "A b"), (1, "D")]
    both = GR.extract_links(pages, "page", "html", unique_pages=False)
    assert sorted(tuple(r) for r in both.collect()) == [(1, "A b"), (1, "D")]

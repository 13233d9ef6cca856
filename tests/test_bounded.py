"""Steps whose memory, files or rounds must not grow with the input."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lexiloom.operators import graph as GR
from lexiloom.operators import vectors as VE
from lexiloom.plans import QUERIES
from lexiloom.plans.registry import Tables
from lexiloom.session import written_table
from lexiloom.sources import jsonl as J


def block(first, n, width=8):
    rows = np.random.default_rng(first).normal(size=(n, width))
    return pd.DataFrame({"id": np.arange(first, first + n), "unit": list(rows / np.linalg.norm(rows, axis=1, keepdims=True))})


def test_products_of_two_blocks_are_held_in_part():
    left, right = block(0, 600), block(10_000, 16_384)
    tracemalloc.start()
    found = VE.top_k_block(left, right, 3, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sims = np.stack(left["unit"]) @ np.stack(right["unit"]).T
    best = np.argsort(-sims, axis=1, kind="stable")[:, :3] + 10_000
    assert found["src"].tolist() == np.repeat(left["id"], 3).tolist() and found["dst"].tolist() == best.ravel().tolist()
    assert peak < 6 * 8 * VE.SIMS


def test_arriving_files_grow_with_the_table(spark, monkeypatch):
    """Four files, and four tasks, used to hold any table."""
    seen, write = [], J.write_jsonl
    monkeypatch.setattr(J, "write_jsonl", lambda df, *args: seen.append(df.rdd.getNumPartitions()) or write(df, *args))
    monkeypatch.setattr(Tables, "__getattr__", lambda t, name: t.spark.read.parquet(f"{t.sf_dir}/{name}.parquet").limit(40).repartition(37))
    for name in ("stream_clean", "stream_gate_totals", "stream_frames"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 3 and all(n >= 37 for n in seen)


def test_pooled_vectors_are_not_shuffled(spark, monkeypatch):
    """Every (document, token) pair used to take its whole vector through a shuffle."""
    rows = [(d, t) for d in range(30) for t in range(d % 7)] + [(1, 99), (40, 99), (2, None)]
    tokens = spark.createDataFrame(rows, "doc int, tok int")
    table = spark.createDataFrame([(t, [float(t), 1.0]) for t in range(6)] + [(3, [5.0, 0.0])], "tok int, v array<float>")
    blocks = VE.vector_blocks
    monkeypatch.setattr(VE, "vector_blocks", lambda *a: blocks(*a, values=4))  # several blocks
    want = {}
    for doc, tok in rows:
        found = [v for t, v in [(r["tok"], r["v"]) for r in table.collect()] if t == tok]
        want.setdefault(doc, []).extend(found)
    want = {doc: (len(v), [sum(x) / len(v) for x in zip(*v)]) for doc, v in want.items() if v}
    lists = tokens.groupBy("doc").agg(F.collect_list("tok").alias("tok"))
    for given in (tokens, lists):
        out = VE.mean_pool(given, table, "doc", "tok", "v", chained=2)
        got = {r["doc"]: (r["n_tokens"], r["v"]) for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(got[d][0] == want[d][0] and np.allclose(got[d][1], want[d][1]) for d in want)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_links_stay_in_place_between_steps(spark, monkeypatch):
    """Every step used to shuffle all links by their source; the table of links leaves the catalog."""
    plans, cut = [], GR.cut_lineage
    monkeypatch.setattr(GR, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.range(4000).select((F.col("id") % 90).alias("src"), (F.col("id") * 7 % 101).alias("dst"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranks = GR.pagerank(edges, iterations=3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert abs(ranks.agg(F.sum("rank")).first()[0] - 1) < 1e-9
    steps = [p for p in plans if "share" in p and "Join" in p]
    assert len(steps) == 3 and not any("Exchange hashpartitioning(src#" in line and "share" in line for p in steps for line in p.split("\n"))
    assert all("Bucketed: true" in p for p in steps)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lexiloom_links")]


def test_row_groups_can_be_small(spark):
    """A reader decodes up to 4096 rows of a row group at once, which whole documents as arrays make heavy."""
    rows = spark.range(3000, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(700)), lambda i: F.xxhash64("id", i)).alias("x"))
    files = written_table(rows, "groups", 1).inputFiles()
    assert pq.ParquetFile(files[0].removeprefix("file://")).metadata.row_group(0).num_rows < 1000

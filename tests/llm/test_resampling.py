"""Importance resampling against a plain recount, with odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import resampling as R

TEXTS = [None, "", " .,;", "Hello, World é☃ x", "a" * 70_000 + " b c", "A-B " * 30, "A-B " * 30, "lead the trail " * 9, " ".join(f"w{i}" for i in range(3000))]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def grams(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, longest, buckets, share, of, least):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in rows for g in grams(t, longest))
    t = Counter(bucket(g) for x in target for g in grams(x, longest))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    out = {}
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in grams(x, longest))
        out[i] = [len(grams(x, longest)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((-out[i][2], i) for i, x in rows if len(words(x)) >= least)
    for place, (_, i) in enumerate(able[: share * len(able) // of], 1):
        out[i][3] = place
    return {i: tuple(v) for i, v in out.items()}


@pytest.mark.parametrize("longest,chunk,ranges", [(1, 1 << 18, 100_000), (3, 7, 3)])
def test_equals_a_plain_recount(spark, monkeypatch, longest, chunk, ranges):
    monkeypatch.setattr(R, "CHUNK", chunk)
    monkeypatch.setattr(R, "RANGE_ROWS", ranges)
    rows = list(enumerate(TEXTS)) + [(100 + i, f"the rain {i} in spain " * 8) for i in range(30)]
    target = ["the rain in spain", None, "", "w1 w2 w3"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("weight", "score", "rank", "bucket", "id", "range")})
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    got = R.resample(docs, goal, longest=longest, buckets=97, share=50).collect()
    assert {r.id: (r.n_features, r.weight, r.score, r.rank) for r in got} == plain(rows, target, longest, 97, 50, 100, 20)


def test_repeated_null_and_missing_rows(spark):
    rows = [(1, "a b " * 20), (1, "a b " * 20), (None, "a b " * 20), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = R.resample(docs, docs.limit(0), share=100).collect()
    assert len(got) == 4 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert R.resample(docs.limit(0), docs).count() == 0


def test_running_states_are_crc32():
    data = np.random.default_rng(1).integers(0, 256, 70_000).astype(np.uint8)
    at = np.array([0, 1, 255, 256, 257, 511, 512, 513, 65_536, 69_999, 70_000])
    assert [int(s) for s in R.running_states(data, at)] == [zlib.crc32(bytes(data[:p]), 0xFFFFFFFF) ^ 0xFFFFFFFF for p in at]
    assert len(R.feature_buckets(pa.array([], pa.string()), 2, 10)[0]) == 0

"""The prefix trie against a plain dictionary of prefixes, over many small ranges and with odd input."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import prefix_trie as P


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    convs = {c: [t[2] for t in sorted(v, key=lambda t: t[:2])] for c, v in convs.items()}
    members = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        turns = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append((c, len(turns) == d))
    words = lambda p: len(re.findall("[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * words(p)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c, at_end in m if at_end)))
        parent = min(members[p[:-1]])[0] if p else None
        out.append((min(m)[0], len(p), parent, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def crowd(seed):
    """A first turn and a whole conversation that many share, long ones, single turns, gaps in the ids."""
    rng = random.Random(seed)
    rows = []
    for c in range(0, 260, 1 + seed % 2):
        if c % 20 == 0 and c % 60 == 0 and c:
            continue
        kind = rng.random()
        turns = [("user", "the same first turn")] if kind < 0.6 else []
        if kind < 0.25:
            turns += [("assistant", "the same answer"), ("user", "thanks")]
        else:
            turns += [(rng.choice(["user", "assistant"]), f"word {rng.randrange(4)}") for _ in range(rng.choice([0, 1, 2, 3, 30]))]
        rows += [(c, i if i or c % 7 else None, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(1000, 0, None, None), (1001, 0, "", ""), (1001, 1, "user", "x " * 5000), (None, 1, "user", "lost")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,turns", [(0, 40), (1, 300), (2, 50_000)])
def test_equals_a_dictionary_of_prefixes(spark, monkeypatch, seed, turns):
    monkeypatch.setattr(P, "RANGE_TURNS", turns)
    rows = crowd(seed)
    extra = {c: F.lit("x") for c in ("key", "words", "depth", "edge", "closed", "own", "id", "base")}
    got = P.prefix_trie(spark.createDataFrame(rows, SCHEMA).withColumns(extra)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_one_conversation_in_many_copies_and_none(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_TURNS", 30)
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(60) for t in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in P.prefix_trie(df).collect()), key=str) == plain(rows)
    assert P.prefix_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 4, 5, 16, 17, 48, 49, 256])
def test_layouts_grow(n):
    tree = P.RadixTree()
    keys = [bytes([b]) * 3 for b in random.Random(n).sample(range(256), n)]
    for k in keys:
        tree.insert(k, k)
    held = tree.root.children
    if n > 1:
        assert held.layout == next(x for x in (4, 16, 48, 256) if n <= x) and len(held) == n
        assert [held.get(k[0]).end for k in sorted(keys)] == sorted(keys)
        assert [b for b, _ in held.items()] == sorted(k[0] for k in keys) and (n == 256 or held.get((set(range(256)) - {k[0] for k in keys}).pop()) is None)

"""The Jaccard join against all pairs, for every boundary, with lists cut into blocks and odd input."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import jaccard_join as J


def shingles(text, size=4):
    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    part = {i: i for i in sets}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                part[v] = u
    return {i: (len(sets[i]), find(i)) for i in sets}


def crowd(seed):
    """Chains and stars of near copies, exact copies, a passage that all share, short and empty texts."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = [None, "", " \n", "one two", "ONE two", "one", "a b c d e f g", "a b c d e f g h", "a b c d e f g h i"]
    for family in range(6):
        size = rng.choice([8, 12, 40, 90, 200])
        words = [f"f{family}w{rng.randrange(300)}" for _ in range(size)]
        for _ in range(rng.choice([2, 12])):
            for _ in range(rng.randrange(0, 1 + size // 60 + 1)):
                words = list(words) if rng.random() < 0.5 else words
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(words + (passage if rng.random() < 0.5 else [])))
    for _ in range(30):
        rows.append(" ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))] + passage))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,light", [(0, None), (1, 0), (3, 60), (4, 10**6)])
def test_equals_all_pairs(spark, monkeypatch, seed, light):
    if seed % 2:
        for name, value in (("HOT", 5), ("BLOCK", 3), ("CROSS", 0)):
            monkeypatch.setattr(J, name, value)
    rows = crowd(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "key", "part", "s1", "doc", "id", "component_id")})
    got = {r.id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, light=light).collect()}
    assert got == plain(rows)


def test_repeated_null_and_missing_rows(spark):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (3, "x y z"), (5, "x y z"), (None, "x y z"), (None, "alone here"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (3, 1, 3), (5, 1, 3), (None, 1, 3), (None, 1, None), (7, 0, 7)], key=str)
    assert J.jaccard_components(docs.limit(0)).count() == 0


def test_one_id_with_two_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, one), (1, two), (1, two), (2, one + " x"), (3, two + " x"), (4, "alone")]
    got = {(r.id, r.component_id) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


@pytest.mark.parametrize("light", [0, 10**6])
def test_crossing_proposes_each_linked_pair_once(spark, light):
    """Copies around one text without a common pivot: their many common lists propose a pair only once."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(24):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "id long, text string")
    often = spark.sparkContext.broadcast(J.shingle_counts(docs, 4))
    sets = docs.mapInArrow(J._describer(4, 85, often), J._DESCRIBED).withColumnRenamed("id", "doc").withColumn("mixed", F.lit(False))
    prefixes = J.shared_prefixes(sets)
    posted = prefixes.select("doc", "n", "kept", "single").mapInArrow(J._poster(light, 85), "key long, doc long, n int, side byte, at long")
    members = J.salted_join(posted, J.distinct_lists(posted).select("key"), ["key"], "doc", J.rows_by(posted, "key"))
    alone = spark.createDataFrame([], "doc long, part long")
    rest = J._open_members(members, alone)
    pairs = [(min(r.a, r.b), max(r.a, r.b)) for r in J._crossing(rest, sets, prefixes, 85).collect()]
    assert len(pairs) == len(set(pairs))
    texts = dict(rows)
    linked = {(a, b) for a in texts for b in texts if a < b and 100 * len(shingles(texts[a]) & shingles(texts[b])) >= 85 * len(shingles(texts[a]) | shingles(texts[b]))}
    different = {(a, b) for a, b in linked if shingles(texts[a]) != shingles(texts[b])}
    assert different and different <= set(pairs)


def test_boundary_is_the_cheapest():
    boundary = J.light_boundary([(0, 0.0, 5.0), (20, 10.0, 40.0), (40, 500.0, 90.0)])
    assert np.floor(np.log(boundary) / J.LOG_STEP) == 20 < np.floor(np.log(boundary + 1) / J.LOG_STEP)
    assert J.light_boundary([(10, 9.0, 1.0)]) == 0 and J.light_boundary([]) == 0


@pytest.mark.parametrize("seed,parted", [(0, 0), (1, 0), (2, 60), (3, 100)])
def test_parts_equal_all_pairs(spark, monkeypatch, seed, parted):
    """All sets meet in parts, or smaller ones in lists and larger ones in parts with links across the boundary."""
    if seed % 2:
        for name, value in (("HOT", 5), ("BLOCK", 3), ("CROSS", 0)):
            monkeypatch.setattr(J, name, value)
    rows = crowd(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = 0 if seed == 1 else 1_000_000  # nothing is broadcast, and copies are posted too
    got = {r.id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, parted=parted, small=small).collect()}
    assert got == plain(rows)


def test_parts_with_repeated_ids_and_copies(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, one), (1, two), (1, two), (2, one + " x"), (3, two + " x"), (4, "alone"), (None, one), (9, one), (None, None)]
    for small in (0, 1_000_000):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {(r.id, r.component_id) for r in J.jaccard_components(docs, parted=0, small=small).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 1), (9, 1), (None, None)}


@pytest.mark.parametrize("percent", [50, 85, 99, 100])
def test_linked_sets_share_a_part(percent):
    """Pairs at the very threshold, also of neighbouring classes and with more empty parts than are spared."""
    rng = np.random.default_rng(percent)
    classes = J.part_classes(4000, percent)
    tops, parts, empty = classes
    assert all(100 * low // percent <= high for low, high in zip(tops, tops[1:]))
    for n in [1, 2, 5, 6, 7, 8, 9, 12, 13, 20] * 40 + [33, 60, 100, 333, 1000] * 8 + [3000] * 2:
        small = int(rng.integers(J.need(n, percent), n + 1))
        pool = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        # the smallest overlap that links: 100 * both >= percent * (n + small - both)
        both = -(-percent * (n + small) // (100 + percent))
        if both > small:
            continue
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + small - both]]))
        if np.array_equal(a, b):
            continue  # equal sets are one
        assert np.intersect1d(J.part_keys(a, classes, 0), J.part_keys(b, classes, 0)).size, (n, small, both)
        assert np.intersect1d(J.part_keys(a, classes, n - 1), J.part_keys(b, classes, n - 1)).size, (n, small, both)
    # Sets whose shingles all lie in one part have the others empty; they still meet.
    crowded = np.sort(rng.integers(0, 2**40, 41, dtype=np.uint64))
    if percent == 85:
        assert np.intersect1d(J.part_keys(crowded[:40], classes, 0), J.part_keys(crowded[1:], classes, 0)).size


def test_lists_of_unrelated_texts_stay_short(spark, monkeypatch):
    """Texts of few words share single shingles and pairs of them, more so in a larger table, but hardly any part."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(8)}" for _ in range(90))) for i in range(900)]
    kept = {}
    write = J.written_table

    def counted(df, name, *more):
        table = write(df, name, *more)
        kept[name] = kept.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(J, "written_table", counted)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.filter("id != component_id").count() == 0
    assert kept.get("members", 0) + kept.get("rest", 0) + kept.get("partlists", 0) < len(rows)

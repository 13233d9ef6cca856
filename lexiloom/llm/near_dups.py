"""MinHash near duplicates by an inverted join over signature coordinates.

Every distinct shingle set is posted under its (coordinate, value) pairs. Two sets whose Jaccard
similarity is 0.75 agree on 48 of 64 coordinates on average, and on fewer than ``MATCHES`` = 32 with
a probability of about 1e-6. Coordinate values are ordered by how many sets hold them, rarest
first. Sets that agree on 32 values share one among the first 33 of each, so only this prefix is
posted and the frequent values behind it, such as those of a passage that many texts share, are
skipped. Candidate pairs keep at least ``MATCHES`` collisions, and links are confirmed on the full
shingle sets.

No list is expanded into all of its pairs. Each list first links its members to one pivot; lists
whose members then lie in one component are done. In the others only pairs across components are
left: short lists emit them, long lists are cut into blocks of similar set size, and each pair of
blocks is compared inside a task that returns spanning links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches, written_table
from .base import query, small_or_shuffled, table, text_or_empty

SHINGLE = 5
COORDINATES, MATCHES = 64, 32
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Longer lists are compared in blocks.
SHORT_LIST, BLOCK = 24, 300
SEGMENT = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240501))
_MULTIPLY = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_BYTE_BASE = _U(0x9E3779B97F4A7C15)
_WORD_BASE = _U(0xC2B2AE3D27D4EB4F)


def _power(j: int) -> np.uint64:
    return _U(pow(int(_WORD_BASE), j, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of ``data`` (UTF-8 bytes); no word runs over a text's beginning.

    A-Z count as a-z. Works on segments of about ``SEGMENT`` bytes cut between words.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(len(data), bool)
    first[begins[begins < len(data)]] = True
    starts_all, hashes_all, at = [], [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data):
            cut = np.flatnonzero(space[end : end + SEGMENT] | first[end : end + SEGMENT])
            if len(cut):
                end += int(cut[0])
                break
            end = min(end + SEGMENT, len(data))
        part, blank = data[at:end], space[at:end]
        head = first[at:end].copy()
        head[0] = True
        starts = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | head))
        if len(starts):
            part, blank = part[starts[0] :], blank[starts[0] :]
            lengths = np.diff(np.append(starts, len(part) + starts[0]))
            inside = np.arange(len(part)) - np.repeat(starts - starts[0], lengths)
            longest = int(lengths.max())
            powers = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(longest - 1, _BYTE_BASE)]))
            upper = (part >= 65) & (part <= 90)
            value = (part + upper * np.uint8(32)).astype(np.uint64) + _U(1)
            value[blank] = 0
            hashes_all.append(_mix(np.add.reduceat(value * powers[inside], starts - starts[0])))
            starts_all.append(starts + at)
        at = end
    if not starts_all:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts_all), np.concatenate(hashes_all)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words than a shingle is one."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + 4 * SEGMENT, side="right")) - 1)
        begin, end = offsets[low], offsets[high]
        starts, words = _word_hashes(data[begin:end], offsets[low:high] - begin)
        bounds = np.searchsorted(starts, offsets[low : high + 1] - begin)
        rolled = words.copy()
        for j in range(1, min(SHINGLE, len(words))):
            rolled[:-j] += words[j:] * _power(j)
        rolled = _mix(rolled + _U(SHINGLE))
        for a, b in zip(bounds[:-1], bounds[1:]):
            n = int(b - a)
            if n >= SHINGLE:
                yield np.unique(rolled[a : b - SHINGLE + 1])
            elif n:
                whole = sum((words[a + j : a + j + 1] * _power(j) for j in range(n)), np.zeros(1, np.uint64))
                yield _mix(whole + _U(n))
            else:
                yield np.zeros(0, np.uint64)
        low = high


def _signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        best = np.minimum(best, (shingles[i : i + 2048, None] * _MULTIPLY + _ADD).min(0))
    return (best >> _U(32)).astype(np.uint32).view(np.int32)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, 128-bit set hash and signature of each text."""
    for batch in batches:
        n, one, two, signatures = [], [], [], []
        for s in shingle_sets(batch["text"]):
            n.append(len(s))
            one.append(_sum(s))
            two.append(_sum(_mix(s * _BYTE_BASE)))
            signatures.append(_signature(s))
        flat = np.concatenate(signatures) if signatures else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * COORDINATES, pa.int32()), pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [batch["id"], pa.array(n, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists],
            ["id", "n", "s1", "s2", "signature"],
        )


def _sum(shingles: np.ndarray) -> int:
    return int(shingles.sum(dtype=np.uint64).astype(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the texts whose set hash is the one asked for (``of``)."""
    for batch in batches:
        asked = zip(batch["id"].to_pylist(), batch["of"].to_pylist(), shingle_sets(batch["text"]))
        kept = [(doc, of, s.tobytes()) for doc, of, s in asked if _sum(s) == of]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*kept) if kept else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))],
            ["doc", "s1", "shingles"],
        )


def _linked(one: pa.Array, two: pa.Array) -> pa.Array:
    answers = []
    for a, b in zip(one, two):
        a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        answers.append(100 * both >= PERCENT * (len(a) + len(b) - both))
    return pa.array(answers, pa.bool_())


def spanning_links(keys: np.ndarray, parts: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members of different parts that join what is not joined yet.

    Intersections are counted on the incidence matrix of shingles held by two members at least.
    """
    sizes = np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, 8192):
        here = (column >= low) & (column < low + 8192)
        held = np.zeros((len(sets), 8192), np.float32)
        held[owner[here], column[here] - low] = 1
        both += held @ held.T
    union = sizes[:, None] + sizes[None, :] - both
    root = {p: p for p in parts.tolist()}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    links = []
    for i, j in zip(*np.nonzero(np.triu(100 * both >= PERCENT * union, 1))):
        a, b = find(parts[i]), find(parts[j])
        if a != b:
            root[a] = b
            links.append((int(keys[i]), int(keys[j])))
    return links


def _compare_block(group: pd.DataFrame) -> pd.DataFrame:
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    links = spanning_links(group["doc"].to_numpy(), group["part"].to_numpy(), sets) if group["part"].nunique() > 1 else []
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """(doc, part) of every end of ``links`` (a, b): the smallest id it is connected to.

    Each round takes the smallest label around a node and then follows the labels once; rounds are
    written tables, and the driver sees a count per round.
    """
    both = written_table(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("a"), F.min("b")).alias("part"))
    label = written_table(label, "labels")
    while True:
        near = both.join(label.select(F.col("doc").alias("b"), F.col("part").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = label.join(near, F.col("doc") == F.col("a")).select("doc", F.least("part", "near").alias("low"), F.col("part").alias("old"))
        jump = label.select(F.col("doc").alias("low"), F.col("part").alias("next"))
        moved = lower.join(jump, "low").select("doc", F.least("low", "next").alias("part"), "old")
        moved = written_table(moved, "labels")
        label = moved.drop("old")
        if not moved.filter("part != old").head(1):
            return label


def _postings(sets: DataFrame) -> DataFrame:
    """(token, doc, n) of each set's prefix: rarest coordinate values first, values of one set alone left out."""
    held = sets.select("doc", "n", F.posexplode("signature").alias("k", "v"))
    held = held.select("doc", "n", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long")).alias("token"))
    often = held.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    tokens = F.array_sort(F.collect_list(F.struct("df", "token")))
    ranked = held.join(often, "token").groupBy("doc", "n").agg(tokens.alias("tokens"))
    ranked = ranked.filter(F.size("tokens") >= MATCHES)
    prefix = F.expr(f"slice(tokens, 1, size(tokens) - {MATCHES} + 1)")
    return ranked.select("doc", "n", F.explode(prefix).alias("t")).select("t.token", "doc", "n")


def _comparable(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _confirmed(pairs: DataFrame, signatures: DataFrame, shingles: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) with enough signature collisions whose full sets are similar enough."""
    left = signatures.select(F.col("doc").alias("a"), F.col("signature").alias("sa"))
    right = signatures.select(F.col("doc").alias("b"), F.col("signature").alias("sb"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    likely = pairs.join(left, "a").join(right, "b").filter(same >= MATCHES).select("a", "b")
    one = shingles.select(F.col("doc").alias("a"), F.col("shingles").alias("one"))
    two = shingles.select(F.col("doc").alias("b"), F.col("shingles").alias("two"))
    return likely.join(one, "a").join(two, "b").filter(F.arrow_udf(_linked, "boolean")("one", "two")).select("a", "b")


def _in_blocks(members: DataFrame, shingles: DataFrame) -> DataFrame:
    """Links across components of long lists; ``members`` has token, doc, n, part.

    Linked sets differ in size by a quarter at most, so they lie in one size class or in neighbouring
    ones. A class of a list is dealt into blocks of about ``BLOCK`` members.
    """
    sized = members.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT)) + 1e-9))
    blocks = sized.groupBy("token", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    above = blocks.select("token", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    below = blocks.select("token", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    dealt = sized.join(blocks, ["token", "class"]).join(above, ["token", "class"], "left").join(below, ["token", "class"], "left")
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    # Within a block members meet wherever the block meets another one; a block alone is compared by itself.
    places = """concat(
        transform(filter(sequence(0, blocks - 1), x -> x != s), x -> named_struct('c', class, 'i', least(s, x), 'd', class, 'j', greatest(s, x))),
        if(above IS NULL, array(), transform(sequence(0, above - 1), x -> named_struct('c', class, 'i', s, 'd', class + 1, 'j', x))),
        if(below IS NULL, array(), transform(sequence(0, below - 1), x -> named_struct('c', class - 1, 'i', x, 'd', class, 'j', s))),
        if(blocks = 1 AND above IS NULL AND below IS NULL, array(named_struct('c', class, 'i', s, 'd', class, 'j', s)), array()))"""
    placed = dealt.select("token", "doc", "part", F.explode(F.expr(places)).alias("p"))
    met = placed.join(shingles.select("doc", "shingles"), "doc")
    return met.groupBy("token", "p").applyInPandas(lambda g: _compare_block(g), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    A null or wordless text has an empty set, links with nothing and is its own component. Equal sets
    are one set with the smallest id. Rows that repeat an id are answered by
    their own text each; sets of which the same id is the smallest count as one document. A row with
    a null id has a component_id only if a text with an id has its set, and is kept.
    Columns other than id (an integer) and text are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    with bounded_batches(docs.sparkSession):  # all Python work is done inside
        described = written_table(rows.mapInArrow(_describe, "id long, n int, s1 long, s2 long, signature array<int>"), "described")
        sets = described.filter("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2")
        sets = sets.agg(F.min("id").alias("doc"), F.first("signature").alias("signature"))
        sets = written_table(sets, "sets")
        parts = _link_sets(rows, sets, small)
    return _answer(described, sets, parts)


def _answer(described: DataFrame, sets: DataFrame, parts: DataFrame) -> DataFrame:
    found = sets.select("n", "s1", "s2", "doc").join(parts, "doc", "left")
    found = found.select("n", "s1", "s2", F.coalesce("part", "doc").alias("component_id"))
    both = described.select("id", "n", "s1", "s2").join(found, ["n", "s1", "s2"], "left")
    component = F.coalesce("component_id", "id")
    return both.select(
        "id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _link_sets(rows: DataFrame, sets: DataFrame, small: int) -> DataFrame:
    """(doc, part) of every set that is linked with another one."""
    lists = written_table(_postings(sets), "postings")
    pivots = lists.groupBy("token").agg(F.min(F.struct("n", "doc")).alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    pivots = written_table(pivots.select("token", "pivot.doc", "size").withColumnRenamed("doc", "pivot"), "pivots")
    stars = lists.join(pivots, "token").filter("doc != pivot")
    posted = lists.join(pivots, "token", "left_semi").select("doc").distinct()
    wanted = written_table(sets.join(posted, "doc", "left_semi").select(F.col("doc").alias("want"), F.col("s1").alias("of")), "wanted")
    texts = rows.join(small_or_shuffled(wanted, small), F.col("id") == F.col("want")).select("id", "of", "text")
    shingles = texts.mapInArrow(_sets, "doc long, s1 long, shingles binary").dropDuplicates(["doc", "s1"])
    shingles = written_table(shingles, "shingles")
    pairs = stars.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()
    links = written_table(_confirmed(pairs, sets, shingles), "links")
    parts = components(links)

    placed = lists.join(pivots.select("token", "size"), "token").join(parts, "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    open_lists = placed.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x != y").select("token")
    left = written_table(placed.join(open_lists, "token", "left_semi"), "open")
    short, long = left.filter(F.col("size") <= SHORT_LIST), left.filter(F.col("size") > SHORT_LIST)
    other = short.select("token", *[F.col(c).alias(f"{c}_b") for c in ("doc", "n", "part")])
    crossing = short.join(other, "token").filter("doc < doc_b AND part != part_b").filter(_comparable(F.col("n"), F.col("n_b")))
    crossing = crossing.select(F.col("doc").alias("a"), F.col("doc_b").alias("b")).distinct()
    more = _confirmed(crossing, sets, shingles)
    if long.head(1):
        more = more.unionByName(_in_blocks(long, shingles))
    more = written_table(more, "links")
    return components(links.unionByName(more)) if more.head(1) else parts


@query("op9_near_dups")
def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

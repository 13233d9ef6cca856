"""Exact n-gram Jaccard join by size-aware lists: subsets for light sets, inverted lists for heavy ones.

Lists of shingles are short only while the sketch below tells rare shingles from others. Sets of sizes
for which it makes the lists longer than that post other subsets: the hash cuts all shingles into more
parts than two linked sets can differ in, so linked sets hold the same shingles in one part, which is
a key of about six shingles at any size of the table. ``parted_boundary`` draws the line by cost.

Shingles have one global order, rare ones first by a counting sketch. Linked sets share at least
``need(n)`` = ceil(t * n) of their n shingles each, so their first c common shingles lie among the
first n - need(n) + c of both. Light sets post every pair (c = 2) of that prefix: light sets that link
meet under a common pair. Heavy sets post single shingles (c = 1) and scan each other's lists and
those of the light sets that are large enough to link with them. The boundary between light and heavy
is the size at which the pairs to post and the lists to scan cost least in sum.

Lists are not expanded into their pairs. Their members are first compared with pivots; what is still
in several components is compared across components, where the parity of 512 shingle buckets bounds
the symmetric difference from below, and a pair is proposed only by the list of its first common
shingles. Links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written_table
from .base import holds_at_most, query, small_or_shuffled, table, text_or_empty
from .near_dups import SEGMENT, _mix, _power, _sum, _word_hashes

SHINGLE, PERCENT = 4, 85
#: Counters of the sketch that orders shingles; sets whose scan pays are found at any number.
BUCKETS = 1 << 20
#: Longs of the parity bitmap, rows of a join key that are dealt to one task, members compared at once.
LANES, HOT, BLOCK = 8, 10_000, 4000
#: Counters a shuffled row holds, and the logarithm of the step of the sizes whose costs are summed.
WIDE, LOG_STEP = 64, float(np.log(1.1))
#: Comparisons a list member may cost before another round of pivots is tried.
CROSS = 200

_U = np.uint64
_SECOND = _U(0x9E3779B97F4A7C15)


def need(n, percent: int):
    """Shingles that a set of ``n`` shares with any set it links with, at the least."""
    return (percent * n + 99) // 100


def gram_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of all runs of ``size`` words of each text; a shorter text is one run."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + 4 * SEGMENT, side="right")) - 1)
        starts, words = _word_hashes(data[offsets[low] : offsets[high]], offsets[low:high] - offsets[low])
        bounds = np.searchsorted(starts, offsets[low : high + 1] - offsets[low])
        runs = words.copy()
        for j in range(1, min(size, len(words))):
            runs[:-j] += words[j:] * _power(j)
        runs = _mix(runs + _U(size))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                short = sum((words[a + j : a + j + 1] * _power(j) for j in range(b - a)), np.zeros(1, _U))
                yield _mix(short + _U(b - a))
            else:
                yield np.zeros(0, _U)
        low = high


def _bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> _U(44)).astype(np.int64)


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many texts hold a shingle of each bucket; the driver gets ``BUCKETS`` numbers at any input size.

    A task sends its counters in rows of ``WIDE`` columns, so that few rows are shuffled.
    """
    columns = [f"c{k}" for k in range(WIDE)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for s in gram_sets(batch["text"], size):
                np.add.at(total, _bucket_of(s), 1)
        blocks = total.reshape(-1, WIDE)
        held = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *[pa.array(blocks[held, k]) for k in range(WIDE)]], ["block", *columns])

    counted = texts.select("text").mapInArrow(count, "block int, " + ", ".join(f"{c} long" for c in columns))
    found = counted.groupBy("block").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    counts = np.zeros((BUCKETS // WIDE, WIDE), np.int64)
    counts[found["block"].to_numpy()] = np.stack([found[c].to_numpy() for c in columns], 1)
    return counts.ravel()


_LANES = [f"p{k}" for k in range(LANES)]
_DESCRIBED = "id long, n int, s1 long, s2 long, kept binary, single int, met long, " + ", ".join(f"{p} long" for p in _LANES)


def _describer(size: int, percent: int, often):
    """Of each text: set size, 128-bit set hash, the prefix without shingles whose counter proves that no other set
    holds them, how many of them lie in the shorter prefix, what their lists hold at the most by the counters, and the
    parities of ``LANES`` * 64 buckets."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ones, twos, kept, single, met = [], [], [], [], [], []
            lanes = np.zeros((batch.num_rows, LANES), np.int64)
            for i, s in enumerate(gram_sets(batch["text"], size)):
                n = len(s)
                counts = often.value[_bucket_of(s)]
                order = np.lexsort((s, counts))[: n - need(n, percent) + 2]
                shared = counts[order] > 1  # a counter of one proves that no other text holds the shingle
                low = n - need(n, percent) + 1
                sizes.append(n)
                ones.append(_sum(s))
                twos.append(_sum(_mix(s * _SECOND)))
                kept.append(s[order][shared].tobytes())
                single.append(int(shared[:low].sum()))
                met.append(int(counts[order[:low]][shared[:low]].sum()))
                bits = np.bincount((s & _U(64 * LANES - 1)).astype(np.int64), minlength=64 * LANES) & 1
                lanes[i] = np.packbits(bits.astype(np.uint8)).view(np.int64)
            columns = [pa.array(c, t) for c, t in zip((sizes, ones, twos, kept, single, met), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()))]
            columns = [batch["id"], *columns, *[pa.array(lanes[:, k].copy()) for k in range(LANES)]]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _DESCRIBED.split(", ")])

    return describe


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, at) of every shingle kept of a set's prefix."""
    for batch in batches:
        kept = batch["kept"].cast(pa.large_binary())
        sizes = np.array([len(k) // 8 for k in kept.to_pylist()], np.int64)
        keys = np.frombuffer(b"".join(kept.to_pylist()), np.int64)
        at = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        docs = np.repeat(batch["doc"].to_numpy(zero_copy_only=False), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs, pa.int64()), pa.array(at.astype(np.int32))], ["key", "doc", "at"])


def shared_prefixes(sets: DataFrame) -> DataFrame:
    """(doc, n, kept, single, scan): the prefixes without shingles that no other prefix holds.

    Two sets that link share their first common shingles within both prefixes, so nothing else can
    be met there. ``scan`` is what the lists of the shorter prefix hold. Sets without such shingles are left out.
    """
    posted = sets.select("doc", "kept").mapInArrow(_prefix_rows, "key long, doc long, at int")
    shared = written_table(rows_by(posted, "key").filter("rows > 1"), "shared")
    met = salted_join(posted, shared, ["key"], "doc", shared)
    held = met.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "key", "rows"))).alias("held"))
    found = held.join(sets.select("doc", "n", "single"), "doc")
    short = "filter(held, x -> x.at < single)"
    return found.select(
        "doc", "n", F.col("held.key").alias("kept"), F.expr(f"size({short})").alias("single"),
        F.expr(f"aggregate({short}, 0D, (a, x) -> a + x.rows)").alias("scan"),
    )


def distinct_lists(posted: DataFrame) -> DataFrame:
    """(key, rows, pivot, pivot_n) of the lists in which pairs can meet; of lists with the same members one stands for all.

    The shingles that a family of near copies shares have equal lists, and comparing them again finds nothing new.
    The pivot is the smallest member of the list's stronger side; equal lists have the same one. Its prefix
    tells which of their keys comes first in the order of shingles; that one stands for the others.
    """
    marks = [F.bit_xor(F.xxhash64("doc", "side", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    first = F.min(F.struct("side", "n", "doc", "at")).alias("first")
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), first, *marks)
    # Light sets meet under pairs, so a list of single shingles needs a heavy member.
    lists = lists.filter("rows > 1 AND first.side < 2")
    lists = lists.groupBy("rows", "x1", "x2").agg(F.min_by("key", "first").alias("key"), F.min("first").alias("first"))
    return lists.select("key", "rows", F.col("first.doc").alias("pivot"), F.col("first.n").alias("pivot_n"))


def _poster(light: int, percent: int):
    """Postings (key, doc, n, side, at): side 0 under pairs, 1 heavy and 2 light under single shingles.

    ``at`` holds the places of the key's shingles in the prefix, the first one in its upper half.
    """
    least = percent * (light + 1)  # 100 times the smallest size that links with a heavy set

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, sizes, sides, places, held = [], [], [], [], [], 0

            def add(key, doc, n, side, at):
                keys.append(key)
                places.append(at)
                docs.append(np.full(len(key), doc, np.int64))
                sizes.append(np.full(len(key), n, np.int32))
                sides.append(np.full(len(key), side, np.int8))
                return len(key)

            def packed():
                flat = [np.concatenate(c) if c else np.zeros(0, t) for c, t in ((keys, _U), (docs, np.int64), (sizes, np.int32), (sides, np.int8), (places, np.int64))]
                return pa.RecordBatch.from_arrays([pa.array(flat[0].view(np.int64)), *map(pa.array, flat[1:])], ["key", "doc", "n", "side", "at"])

            for doc, n, s, single in zip(batch["doc"].to_pylist(), batch["n"].to_pylist(), batch["kept"], batch["single"].to_pylist()):
                shared = s.values.to_numpy().view(_U)
                alone = np.arange(single, dtype=np.int64) << 32
                if n > light:
                    held += add(shared[:single], doc, n, 1, alone)
                else:
                    i, j = np.triu_indices(len(shared), 1)
                    held += add(_mix(shared[i] * _SECOND + _mix(shared[j])), doc, n, 0, (i << 32) + j)
                    if 100 * n >= least:
                        held += add(shared[:single], doc, n, 2, alone)
                if held > 1 << 17:
                    yield packed()
                    keys, docs, sizes, sides, places, held = [], [], [], [], [], 0
            yield packed()

    return post


def part_classes(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each class of sizes its largest size, its number of parts and how many of them a set may have empty.

    Sets that link lie in the same class or in two that follow each other. Two linked sets of the class
    and the one below differ in at most D shingles, so of D + 1 + E parts they share E + 1: one that is
    not empty, or both have more than E empty parts. No parts: sets of the class link only if equal.
    """
    tops = [1]
    while len(tops) < 3 or tops[-2] < largest:  # a set posts the parts of the class above its own too
        tops.append(max(tops[-1] + 1, 100 * tops[-1] // percent))
    parts, empty = [], []
    for c, top in enumerate(tops):
        differ = 2 * top * (100 - percent) // (100 + percent)
        least = tops[c - 2] + 1 if c > 1 else 1
        mean = (differ + 1) * np.exp(-least / (differ + 1))
        empty.append(int(np.ceil(mean + 2 * mean**0.5)))
        parts.append(differ + 1 + empty[-1] if differ else 0)
    return np.array(tops), np.array(parts), np.array(empty)


def part_keys(s: np.ndarray, classes: tuple[np.ndarray, np.ndarray, np.ndarray], parted: int) -> np.ndarray:
    """The keys of a sorted set's parts, of its own class (if it may be above ``parted``) and the one above."""
    tops, parts, empty = classes
    own = int(np.searchsorted(tops, len(s)))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(s)])
    keys = []
    for c in (own, own + 1):
        if parts[c] and tops[c] > parted:
            # A part is a range of hashes, so it is a run of the sorted set.
            part = (s >> _U(32)) * _U(parts[c]) >> _U(32)
            bounds = np.searchsorted(part, np.arange(parts[c] + 1).astype(_U))
            held = bounds[1:] > bounds[:-1]
            posted = np.arange(parts[c]) if parts[c] - held.sum() > empty[c] else np.flatnonzero(held)
            inside = sums[bounds[posted + 1]] - sums[bounds[posted]]
            keys.append(_mix(inside + _mix((_U(c + 1) << _U(40)) + posted.astype(_U))))
    return np.concatenate(keys) if keys else np.zeros(0, _U)


def _part_poster(size: int, percent: int, parted: int, largest: int):
    """Postings (key, s1): the parts of each text's set, which its hash stands for."""
    least = percent * (parted + 1)  # 100 times the smallest size that links with a parted set

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = part_classes(largest, percent)
        for batch in batches:
            keys, ones, held = [], [], 0

            def packed():
                columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (keys, ones)]
                return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["key", "s1"])

            for s in gram_sets(batch["text"], size):
                if 100 * len(s) >= least and 0 < len(s) <= largest:
                    keys.append(part_keys(s, classes, parted))
                    ones.append(np.full(len(keys[-1]), _sum(s), np.int64))
                    held += len(keys[-1])
                if held > 1 << 17:
                    yield packed()
                    keys, ones, held = [], [], 0
            yield packed()

    return post


def part_lists(posted: DataFrame) -> DataFrame:
    """(key, rows, pivot, s1): every other member of the lists of several sets; lists with the same members are one.

    Postings are shuffled once. Copies of a text that were posted apart have one set hash and count once.
    """
    ordered, whole = Window.partitionBy("key").orderBy("s1"), Window.partitionBy("key")
    near = posted.withColumns({"before": F.lag("s1").over(ordered), "after": F.lead("s1").over(ordered)})
    near = near.filter("(before IS NOT NULL OR after IS NOT NULL) AND NOT s1 <=> before")
    lists = near.withColumns({"rows": F.count(F.lit(1)).over(whole), "pivot": F.min("s1").over(whole), "mark": F.bit_xor(F.xxhash64("s1")).over(whole)})
    lists = lists.filter("rows > 1 AND s1 != pivot")
    return lists.select(F.xxhash64("mark", "rows", "pivot").alias("key"), "rows", "pivot", "s1").distinct()


def _setter(size: int):
    """The shingle sets of the texts whose set hash is the one asked for (``of``)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = zip(batch["id"].to_pylist(), batch["of"].to_pylist(), gram_sets(batch["text"], size))
            kept = [(doc, of, s.tobytes()) for doc, of, s in asked if _sum(s) == of]
            columns = zip(zip(*kept) if kept else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["doc", "s1", "shingles"])

    return sets


def _confirmer(percent: int):
    def linked(one: pa.Array, two: pa.Array) -> pa.Array:
        answers = []
        for a, b in zip(one, two):
            a, b = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
            both = len(np.intersect1d(a, b, assume_unique=True))
            answers.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(answers, pa.bool_())

    return F.arrow_udf(linked, "boolean")


def salted_join(
    many: DataFrame, one: DataFrame, keys: list[str], by: str, counts: DataFrame, how: str = "inner", small: int = 0
) -> DataFrame:
    """``many`` joined with ``one`` (a row per key); keys with more than ``HOT`` rows are dealt over several tasks.

    ``counts`` holds the keys and their ``rows`` in ``many``; the rows of a hot key are dealt by the column ``by``.
    ``one`` is broadcast instead when a count proves that it has at most ``small`` rows.
    """
    if small and holds_at_most(one, small):
        return many.join(F.broadcast(one), keys, how)
    hot = written_table(counts.filter(F.col("rows") > HOT).select(*keys, F.ceil(F.col("rows") / HOT).cast("int").alias("__deals")), "hot")
    if not hot.head(1):
        return many.join(one, keys, how)
    hot = small_or_shuffled(hot, 100_000)
    deals = F.coalesce("__deals", F.lit(1))
    dealt = many.join(hot, keys, "left").withColumn("__deal", F.pmod(F.xxhash64(by), deals).cast("int")).drop("__deals")
    copied = one.join(hot, keys, "left").withColumn("__deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("__deals")
    return dealt.join(copied, [*keys, "__deal"], how).drop("__deal")


def rows_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def components(links: DataFrame) -> DataFrame:
    """(doc, part): the smallest id that each end of ``links`` (a, b) is connected to; hubs are dealt over tasks."""
    both = written_table(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    degrees = written_table(rows_by(both, "b"), "degrees")
    label = written_table(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("a"), F.min("b")).alias("part")), "labels")
    while True:
        near = salted_join(both, label.select(F.col("doc").alias("b"), F.col("part").alias("near")), ["b"], "a", degrees)
        near = near.groupBy(F.col("a").alias("doc")).agg(F.min("near").alias("near"))
        lower = label.join(near, "doc").select("doc", F.least("part", "near").alias("low"), F.col("part").alias("old"))
        lower = written_table(lower, "lower")
        jump = label.select(F.col("doc").alias("low"), F.col("part").alias("next"))
        moved = salted_join(lower, jump, ["low"], "doc", rows_by(lower, "low")).select("doc", F.least("low", "next").alias("part"), "old")
        moved = written_table(moved, "labels")
        label = moved.drop("old")
        if not moved.filter("part != old").head(1):
            return label


def light_boundary(costs: list[tuple[int, float, float]]) -> int:
    """The largest size that is light: classes up to it post pairs, those above scan lists, at the least sum."""
    costs = sorted(costs)
    best, at = sum(c[2] for c in costs), -1
    total = best
    for k, pairs, scans in costs:
        total += pairs - scans
        if total < best:
            best, at = total, k
    return int(np.exp(LOG_STEP * (at + 1)) - 1e-9) if at >= 0 else 0


def _fits(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def parted_boundary(sets: DataFrame, percent: int) -> int:
    """The largest size whose sets meet in lists of shingles; larger ones meet in parts, at the least sum of rows.

    What a list holds is bounded by the sketch, so with full counters all sets meet in parts.
    """
    classed = sets.filter("n > 0").groupBy(F.floor(F.log(F.col("n").cast("double")) / LOG_STEP).alias("class"))
    posts = 4 * (100 - percent) / (100 + percent) / (percent / 100)  # of a shingle, in two classes
    costs = classed.agg(F.sum("met").cast("double").alias("lists"), (F.sum("n") * F.lit(posts)).alias("parts"))
    return light_boundary([tuple(r) for r in costs.collect()])  # a row per tenth of size


def jaccard_links(
    sets: DataFrame, rows: DataFrame, size: int, percent: int, light: int | None, small: int, parted: int | None = None
) -> DataFrame | None:
    """(doc, part) of every linked set of ``sets`` (distinct described sets with their ``doc``), or None."""
    largest = sets.agg(F.max("n")).first()[0] or 0
    if parted is None:
        parted = parted_boundary(sets, percent) if light is None else largest
    found = []
    if parted > 0:
        found.append(_linked_in_lists(sets.filter(F.col("n") <= parted), rows, size, percent, light, small))
    if parted < largest:
        near = sets.filter(100 * F.col("n") >= percent * (parted + 1))
        found.append(_linked_in_parts(near, rows, size, percent, parted, largest, small))
    if len(found) < 2:
        return found[0][1] if found else None
    return components(found[0][0].unionByName(found[1][0]))


def _linked_in_lists(sets: DataFrame, rows: DataFrame, size: int, percent: int, light: int | None, small: int) -> tuple[DataFrame, DataFrame]:
    """Links and (doc, part) of sets that meet under pairs of prefix shingles or under single ones."""
    prefixes = written_table(shared_prefixes(sets.filter("n > 0")), "prefixes")
    if light is None:
        kept = F.size("kept")
        classed = prefixes.groupBy(F.floor(F.log(F.col("n").cast("double")) / LOG_STEP).alias("class"))
        costs = classed.agg(F.sum(kept * (kept - 1) / 2).alias("pairs"), F.sum("scan").alias("scans"))
        light = light_boundary([tuple(r) for r in costs.collect()])  # a row per tenth of size
    posted = prefixes.select("doc", "n", "kept", "single").mapInArrow(_poster(light, percent), "key long, doc long, n int, side byte, at long")
    posted = written_table(posted, "postings")
    lists = written_table(distinct_lists(posted), "lists")
    members = written_table(salted_join(posted, lists.drop("rows"), ["key"], "doc", lists, small=small), "members")
    stars = members.filter("doc != pivot").filter(_fits(F.col("n"), F.col("pivot_n"), percent))
    stars = stars.select(F.col("doc").alias("a"), F.col("pivot").alias("b"))
    return _settled(members.drop("pivot", "pivot_n"), stars, sets, prefixes, rows, size, percent, small)


def _linked_in_parts(
    sets: DataFrame, rows: DataFrame, size: int, percent: int, parted: int, largest: int, small: int
) -> tuple[DataFrame, DataFrame]:
    """Links and (doc, part) of sets that hold the same shingles in a part; a larger one of a pair is above ``parted``."""
    firsts = sets.select(F.col("doc").alias("id"))
    # Copies are told apart by their set's hash; where their ids can be broadcast they aren't posted.
    single = rows.join(F.broadcast(firsts), "id", "left_semi") if holds_at_most(firsts, small) else rows
    posted = single.select("text").mapInArrow(_part_poster(size, percent, parted, largest), "key long, s1 long")
    lists = written_table(part_lists(posted), "partlists")
    named = small_or_shuffled(sets.select("s1", "doc", "n"), small)
    hub = sets.select(F.col("s1").alias("pivot"), F.col("doc").alias("b"), F.col("n").alias("m"))
    # A list of two sets is settled by its star, so only longer ones are kept.
    stars = lists.select("pivot", "s1").distinct().join(named, "s1")
    stars = salted_join(stars, hub, ["pivot"], "s1", rows_by(stars, "pivot"), small=small).filter("doc != b")
    stars = stars.filter(_fits(F.col("n"), F.col("m"), percent)).select(F.col("doc").alias("a"), "b")
    longer = lists.filter("rows > 2")
    members = longer.select("key", "s1").unionByName(longer.select("key", F.col("pivot").alias("s1")).distinct())
    members = members.join(named, "s1").select("key", "doc", "n", F.lit(0).cast("byte").alias("side"), F.lit(0).cast("long").alias("at"))
    # Parts have no places in a prefix, so any list may propose a pair.
    loose = sets.withColumn("mixed", F.lit(True))
    prefixes = sets.select("doc", F.array().cast("array<long>").alias("kept")).distinct()
    return _settled(written_table(members, "members"), stars, loose, prefixes, rows, size, percent, small)


def _settled(
    members: DataFrame, stars: DataFrame, sets: DataFrame, prefixes: DataFrame, rows: DataFrame, size: int, percent: int, small: int
) -> tuple[DataFrame, DataFrame]:
    """Links and (doc, part) after all members of a list were compared that the stars (a, b) and pivots left apart."""

    def confirmed(pairs: DataFrame) -> DataFrame:
        return written_table(_confirmed(pairs, sets, rows, size, percent, small), "links")

    links = confirmed(stars)
    spent = None
    for turn in range(1, 100):
        parts = components(links)
        rest = _open_members(members, parts)
        if rest is None:
            return links, parts
        totals = rest.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("part") != F.col("major"), F.col("rows"))).alias("cross")).first()
        if (totals["cross"] or 0) <= CROSS * totals["rows"] or (spent is not None and totals["cross"] > 0.7 * spent):
            break
        spent = totals["cross"]
        links = written_table(links.unionByName(confirmed(_pivot_pairs(rest, turn, percent))).distinct(), "links")
    more = confirmed(_crossing(rest, sets, prefixes, percent))
    links = links.unionByName(more)
    return links, components(links) if more.head(1) else parts


def _close(one: str, two: str, percent: int) -> Column:
    """Whether two sets may link by their parities: every odd bucket counts a shingle of the symmetric difference."""
    differ = sum((F.bit_count(F.col(f"{p}{one}").bitwiseXOR(F.col(f"{p}{two}"))) for p in _LANES), F.lit(0))
    return differ * (100 + percent) <= (100 - percent) * (F.col(f"n{one}") + F.col(f"n{two}"))


def _confirmed(pairs: DataFrame, sets: DataFrame, rows: DataFrame, size: int, percent: int, small: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets link; sets are cut from their texts for pairs that may."""
    pairs = written_table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    marks = lambda end: sets.select(F.col("doc").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "s1", *_LANES)])
    likely = salted_join(pairs, marks("a"), ["a"], "b", rows_by(pairs, "a"))
    likely = salted_join(likely, marks("b"), ["b"], "a", rows_by(pairs, "b")).filter(_close("_a", "_b", percent))
    likely = written_table(likely.select("a", "s1_a", "b", "s1_b"), "likely")
    wanted = likely.select(F.col("a").alias("want"), F.col("s1_a").alias("of")).union(likely.select("b", "s1_b")).distinct()
    texts = rows.join(small_or_shuffled(written_table(wanted, "wanted"), small), F.col("id") == F.col("want")).select("id", "of", "text")
    held = texts.mapInArrow(_setter(size), "doc long, s1 long, shingles binary")
    held = written_table(held.dropDuplicates(["doc", "s1"]) if _repeats(wanted, "want") or _repeats(texts, "id") else held, "held")
    one = held.select(F.col("doc").alias("a"), F.col("s1").alias("s1_a"), F.col("shingles").alias("one"))
    two = held.select(F.col("doc").alias("b"), F.col("s1").alias("s1_b"), F.col("shingles").alias("two"))
    first = salted_join(likely, one, ["a", "s1_a"], "b", rows_by(likely, "a", "s1_a"))
    second = salted_join(first, two, ["b", "s1_b"], "a", rows_by(likely, "b", "s1_b"))
    return second.filter(_confirmer(percent)("one", "two")).select("a", "b").distinct()


def _repeats(df: DataFrame, key: str) -> bool:
    return bool(rows_by(df, key).filter("rows > 1").head(1))


def _open_members(members: DataFrame, parts: DataFrame) -> DataFrame | None:
    """Members of the lists that lie in several components, with ``part``, the list's ``rows``, its largest component
    and the ``minor`` rows outside of that."""
    placed = members.join(parts, "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    placed = written_table(placed, "placed")
    shares = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("share"))
    largest = F.max(F.struct("share", "part")).alias("largest")
    lists = shares.groupBy("key").agg(F.sum("share").alias("rows"), F.count(F.lit(1)).alias("parts"), largest)
    lists = lists.filter("parts > 1").select("key", "rows", F.col("largest.part").alias("major"), F.expr("rows - largest.share").alias("minor"))
    lists = written_table(lists, "open")
    if not lists.head(1):
        return None
    return written_table(salted_join(placed, lists, ["key"], "doc", lists), "rest")


def _pivot_pairs(rest: DataFrame, turn: int, percent: int) -> DataFrame:
    """Members outside the largest component of a list, each with one member of it drawn by a hash."""
    drawn = F.struct((F.col("side") == 2).alias("weak"), F.xxhash64("doc", F.lit(turn)).alias("h"), "doc", "n", "side")
    pivots = rest.filter("part = major").groupBy("key").agg(F.min(drawn).alias("pivot"))
    others = rest.filter("part != major")
    met = salted_join(others, pivots, ["key"], "doc", rows_by(others, "key"))
    met = met.filter(_fits(F.col("n"), F.col("pivot.n"), percent)).filter("side + pivot.side < 4")
    return met.select(F.col("doc").alias("a"), F.col("pivot.doc").alias("b"))


def _crossing(rest: DataFrame, sets: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one list and different components that may link.

    One of a pair lies outside the list's largest component. Both sides are dealt into blocks of about
    ``BLOCK`` members, and a task compares two blocks at a time. Of the lists that a pair shares, only that
    of its first common shingles proposes it: both prefixes hold them, in the same order. An id of several
    sets (``mixed``) has one prefix of them all, without that order, so each of its lists proposes it.
    """
    described = sets.select("doc", "mixed", *_LANES).join(prefixes.select("doc", "kept"), "doc")
    rest = written_table(rest.join(described, "doc"), "rest")
    first, second = (F.expr(f"get(kept, cast({place} as int))") for place in ("shiftrightunsigned(at, 32)", "at & 4294967295L"))
    marked = rest.withColumn("mark", F.when(F.col("side") == 0, F.array(first, second)).otherwise(F.array(first)))
    minor = marked.filter("part != major")
    rows, columns = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("minor", "rows"))
    deal = lambda blocks: F.pmod(F.xxhash64("doc", F.lit("block")), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    shown = ("doc", "n", "side", "part", "kept", "mixed", *_LANES)
    left = minor.select("key", deal(rows).alias("i"), every(columns).alias("j"), *[F.col(c).alias(f"{c}_a") for c in (*shown, "mark", "major")])
    right = rest.select("key", deal(columns).alias("j"), every(rows).alias("i"), *[F.col(c).alias(f"{c}_b") for c in shown])
    # Two members outside the largest component meet twice and count once; two light sets meet under pairs.
    once = (F.col("part_b") == F.col("major_a")) | (F.col("doc_a") < F.col("doc_b"))
    met = left.join(right, ["key", "i", "j"])
    leading = F.expr("slice(array_intersect(kept_a, kept_b), 1, size(mark_a)) = mark_a")
    apart = (F.col("part_a") != F.col("part_b")) & once & (F.col("side_a") + F.col("side_b") < 4)
    met = met.filter(apart & _fits(F.col("n_a"), F.col("n_b"), percent) & _close("_a", "_b", percent) & (F.col("mixed_a") | F.col("mixed_b") | leading))
    return met.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, light: int | None = None,
    small: int = 1_000_000, parted: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    A null or wordless text has an empty set, links with nothing and is its own component. Equal sets
    are one set with the smallest id. Rows that repeat an id are answered by their own text each; sets
    of which the same id is the smallest count as one document. A row with a null id has a
    component_id only if a text with an id has its set. Columns other than id (an integer) and text are
    ignored. ``light`` sets the boundary of pairs and single shingles by hand, ``parted`` the size above
    which sets meet in parts (none with ``light`` alone); results depend on neither.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    counts = shingle_counts(rows, size)
    often = docs.sparkSession.sparkContext.broadcast(counts)
    described = written_table(rows.mapInArrow(_describer(size, percent, often), _DESCRIBED), "described")
    hashes = ["n", "s1", "s2"]
    sets = described.filter("n > 0 AND id IS NOT NULL").groupBy(*hashes).agg(F.min("id").alias("doc"), F.count(F.lit(1)).alias("rows"))
    sets = written_table(sets, "sets")
    firsts = small_or_shuffled(sets.select(F.col("doc").alias("id"), *hashes), small)
    distinct = described.join(firsts, ["id", *hashes]).withColumnRenamed("id", "doc")
    # Of sets with the same smallest id one stands for the document; its links are those of the id.
    distinct = distinct.withColumn("mixed", F.lit(False))
    if _repeats(described, "id"):
        distinct = distinct.dropDuplicates(["doc", *hashes]).drop("mixed")
        distinct = distinct.join(rows_by(distinct, "doc").select("doc", F.expr("rows > 1 AS mixed")), "doc")
    distinct = written_table(distinct, "distinct")
    parts = jaccard_links(distinct, rows, size, percent, light, small, parted)
    known = sets.join(parts, "doc", "left") if parts is not None else sets.withColumn("part", F.lit(None).cast("long"))
    known = written_table(known.select(*hashes, F.coalesce("part", "doc").alias("component_id"), "rows"), "known")
    answered = salted_join(described.select("id", *hashes), known.drop("rows"), hashes, "id", known, "left")
    return answered.select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


@query("op13_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
p AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM p a JOIN p b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * c >= 85 * (na + nb - c)),
r(doc_id, part) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.part FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, any_value(len(g))::BIGINT AS n_shingles, min(part) AS component_id FROM s JOIN r USING (doc_id) GROUP BY doc_id""")
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

A text is cut into all windows of an item's length that hold enough of the item's word shingles, in
any order; a window with less can't reach the similarity asked for. Windows and items get 64-bit
SimHash fingerprints of their weighted shingles. The fingerprint is split into ``radius + 1`` blocks, so two
fingerprints within the radius agree on a block at least: joining on (item, block, value) finds all
of them. What remains is verified by the exact weighted Jaccard similarity of the shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, written_table
from .base import query, small_or_shuffled, table, text_or_empty

#: Everything but letters, marks and digits separates words.
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
SHINGLE = 5
SIMILARITY = 0.75
#: Of 64 bits; at the similarity the cosine is 0.857 at least, so sets differ in about 11 bits; 23 lie four deviations above.
RADIUS = 23


def pieces_of(text: Column) -> Column:
    """Lower-cased words; an empty piece may lead and trail."""
    return F.split(F.lower(text), NOT_WORD)


def _weighted(words: str, size: str) -> Column:
    """Distinct shingles of an array column as structs (s: text, h: hash, w: weight).

    A shingle weighs as many units as it has letters and digits, so that long words count more than
    strings of short ones.
    """
    return F.expr(
        f"""transform(array_distinct(transform(sequence(1, greatest(size({words}) - {size} + 1, 1)),
        i -> array_join(slice({words}, i, {size}), ' '))),
        s -> named_struct('s', s, 'h', xxhash64(s), 'w', cast(length(s) - {size} + 1 AS bigint)))"""
    )


def _fingerprint(shingles: str) -> Column:
    """SimHash: bit b is set when the hashes with bit b outweigh the others.

    A shingle counts with the root of its weight. Then the cosine of two sets is what they share over the
    root of the product of their weights, whatever single shingles weigh, and never below
    2 J / (1 + J) for a weighted Jaccard similarity J.
    """
    return F.expr(
        f"""aggregate(transform(sequence(0, 63), b -> if(aggregate({shingles}, 0D,
        (a, x) -> a + if(shiftrightunsigned(x.h, b) & 1L = 1L, sqrt(x.w), -sqrt(x.w))) > 0D, shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)"""
    )


def _edges(radius: int) -> list[int]:
    return [64 * i // (radius + 1) for i in range(radius + 2)]


def _block_values(fingerprint: str, radius: int) -> Column:
    """(block, value) of the ``radius + 1`` blocks that share the 64 bits evenly."""
    edges = _edges(radius)
    cuts = ", ".join(
        f"named_struct('block', {i}, 'value', shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L)"
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    )
    return F.expr(f"array({cuts})")


def _first_block(one: str, other: str, radius: int) -> Column:
    """The first block in which two fingerprints agree."""
    edges = _edges(radius)
    cuts = [f"WHEN ({one} ^ {other}) & {_signed(((1 << (b - a)) - 1) << a)}L = 0L THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return F.expr(f"CASE {' '.join(cuts)} END")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    small: int = 200_000,
) -> DataFrame:
    """(id, item, start_word, n_words, similarity, hamming): the best window of each leaked item in each text.

    An item of fewer than five words is one shingle as a whole; an item without words, or a null
    one, leaks nowhere. Windows that would pass the end of a text are moved inside it; a text
    shorter than the item is one window. Windows that line the item up with one of its shingles
    come before others, which count where none of those is similar enough; among each the most similar
    is the best, and equal similarities go to the earliest window. Rows that repeat an id give that id
    once; null ids are one id. Columns other than id and text are ignored.
    """
    known = spread(items.select(F.col(item_col).alias("item"), pieces_of(text_or_empty(item_text_col)).alias("p")))
    known = known.select("item", F.expr("filter(p, x -> x != '')").alias("i_words")).filter("size(i_words) > 0")
    known = known.withColumn("g", F.expr(f"least({SHINGLE}, size(i_words))")).withColumn("i_shingles", _weighted("i_words", "g"))
    known = known.withColumn("total", F.expr("aggregate(i_shingles, 0L, (a, x) -> a + x.w)")).withColumn("i_print", _fingerprint("i_shingles"))
    known = written_table(known.withColumn("i_names", F.col("i_shingles.s")).drop("i_shingles"), "leak-items")
    anchors = _anchors(known)
    sizes = [r.g for r in known.select("g").distinct().collect()]  # at most five numbers
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("text_key"), "text")
    rows = texts.select("id", "text_key", pieces_of(F.col("text")).alias("words"))
    hits = [_hits(rows, anchors, g, small) for g in sorted(sizes) or [SHINGLE]]
    all_hits = hits[0]
    for more in hits[1:]:
        all_hits = all_hits.unionByName(more)
    stretches = written_table(_stretches(all_hits, similarity), "leak-stretches")

    def best(starts: DataFrame) -> DataFrame:
        wanted = written_table(starts.filter("size(starts) > 0"), "leak-starts")
        found = _similar(_windows(texts, wanted, small), known, similarity, radius, small)
        return written_table(found, "leaks")

    aligned = best(_aligned_starts(stretches, similarity))
    solved = small_or_shuffled(aligned.select(F.col("id").alias("d_id"), F.col("item").alias("d_item")), small)
    met = F.col("id").eqNullSafe(F.col("d_id")) & (F.col("item") == F.col("d_item"))
    return aligned.unionByName(best(_other_starts(stretches.join(solved, met, "left_anti"), similarity)))


def _anchors(known: DataFrame) -> DataFrame:
    """(item, g, len, total, i_gram, k, w, places): every distinct shingle of an item, with its weight and its places.

    ``k`` is the first place, which tells the shingles of an item apart.
    """
    grams = "transform(sequence(0, size(i_words) - g), i -> array_join(slice(i_words, i + 1, g), ' '))"
    placed = known.select("item", "g", F.size("i_words").alias("len"), "total", F.posexplode(F.expr(grams)).alias("place", "i_gram"))
    found = placed.groupBy("item", "g", "len", "total", "i_gram").agg(F.sort_array(F.collect_set("place")).alias("places"))
    return found.select("*", F.get("places", F.lit(0)).alias("k"), F.expr("cast(length(i_gram) - g + 1 AS bigint)").alias("w"))


def _similar(found: DataFrame, known: DataFrame, similarity: float, radius: int, small: int) -> DataFrame:
    """The most similar window of each (id, item) whose fingerprint meets the item's in a block, verified exactly."""
    found = found.withColumn("w_shingles", _weighted("window", "g")).withColumn("w_print", _fingerprint("w_shingles"))
    found = found.withColumn("w_names", F.col("w_shingles.s")).drop("window", "w_shingles")
    marks = known.select("item", "i_names", "total", "i_print", F.inline(_block_values("i_print", radius)))
    probes = found.select("*", F.inline(_block_values("w_print", radius)))
    met = probes.join(small_or_shuffled(marks, small), ["item", "block", "value"])
    met = met.withColumn("hamming", F.expr("bit_count(w_print ^ i_print)")).filter(F.col("hamming") <= radius)
    met = met.filter(F.col("block") == _first_block("w_print", "i_print", radius))  # fingerprints that meet in several blocks are compared once
    weight = "aggregate({0}, 0L, (a, s) -> a + length(s) - g + 1)"
    scored = met.withColumn("shared", F.expr(weight.format("array_intersect(w_names, i_names)")))
    scored = scored.withColumn("similarity", F.expr(f"shared / (total + {weight.format('w_names')} - shared)"))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start", "len", "hamming"))
    kept = scored.filter(F.col("similarity") >= similarity).groupBy("id", "item").agg(best.alias("b"))
    return kept.select(
        "id", "item", F.col("b.start").cast("long").alias("start_word"), F.col("b.len").cast("long").alias("n_words"),
        (-F.col("b.s")).alias("similarity"), F.col("b.hamming").alias("hamming"),
    )


def _hits(rows: DataFrame, anchors: DataFrame, g: int, small: int) -> DataFrame:
    """The places (``at`` counts words) where a text holds a ``g``-word shingle of an item, with its number and weight."""
    led = F.expr("cast(get(words, 0) = '' AS int)")
    n = F.expr("size(words) - cast(get(words, 0) = '' AS int) - cast(size(words) > 1 AND element_at(words, -1) = '' AS int)")
    pieces = rows.select("id", "text_key", led.alias("led"), n.alias("n"), "words", F.posexplode("words").alias("at", "word"))
    run = ["word", *[f"word{k}" for k in range(1, g)]]
    more = [F.get("words", F.col("at") + k).alias(f"word{k}") for k in range(1, g)]
    grams = pieces.select("id", "text_key", "led", "n", "at", "word", *more).withColumn("gram", F.xxhash64(*run))
    index = anchors.filter(F.col("g") == g).withColumn("gram", F.xxhash64(*[F.get(F.split("i_gram", " "), F.lit(k)) for k in range(g)]))
    hits = grams.join(small_or_shuffled(index, small), "gram").filter(F.concat_ws(" ", *run) == F.col("i_gram"))
    return hits.select("id", "text_key", "item", "g", "len", "total", "k", "w", "places", (F.col("at") - F.col("led")).alias("at"), "led", "n")


#: The last start of a window, and what the distinct hits of a window at ``s`` weigh.
_LAST = "greatest(n - len, 0)"
_WEIGHT = "aggregate(array_distinct(transform({0}, h -> named_struct('k', h.k, 'w', h.w))), 0L, (a, x) -> a + x.w)"
_INSIDE = _WEIGHT.format("filter(hits, h -> h.at BETWEEN s AND s + len - g)")
_KEYS = ["id", "text_key", "item", "g", "len", "led"]


def _need(similarity: float) -> str:
    return f"total * {similarity!r}D * (1 - 1e-9D)"


def _stretches(hits: DataFrame, similarity: float) -> DataFrame:
    """Stretches of one item length whose windows may hold hits enough, with these hits and ``lines``, the starts
    inside the stretch that line a hit up with a place of its shingle.

    A window shares with the item what its hits weigh, and the union is no lighter than the item. So
    ``similarity`` times the item's weight is a bound that every window above the similarity meets,
    whichever diagonals its hits lie on.
    """
    spans = f"explode(sequence(greatest(at - len + g, 0) div len, least(at, {_LAST}) div len)) AS stretch"
    placed = hits.select("*", F.expr(spans))
    grouped = placed.groupBy(*_KEYS, "total", "n", "stretch").agg(F.collect_set(F.struct("at", "k", "w", "places")).alias("hits"))
    lines = f"array_distinct(flatten(transform(hits, h -> transform(h.places, p -> greatest(least(h.at - p, {_LAST}), 0)))))"
    heavy = grouped.filter(F.expr(f"{_WEIGHT.format('hits')} >= {_need(similarity)}"))
    return heavy.withColumn("lines", F.expr(f"filter({lines}, s -> s div len = stretch)"))


def _aligned_starts(stretches: DataFrame, similarity: float) -> DataFrame:
    starts = F.expr(f"filter(lines, s -> {_INSIDE} >= {_need(similarity)})")
    return stretches.select(*_KEYS, starts.alias("starts"))


def _other_starts(stretches: DataFrame, similarity: float) -> DataFrame:
    first = "cast(stretch * len AS int)"
    every = f"array_except(sequence({first}, least({first} + len - 1, {_LAST})), lines)"
    return spread(stretches).select(*_KEYS, F.expr(f"filter({every}, s -> {_INSIDE} >= {_need(similarity)})").alias("starts"))


def _windows(texts: DataFrame, starts: DataFrame, small: int) -> DataFrame:
    """The item-sized windows at the given starts; equal windows of an id count once."""
    wanted = small_or_shuffled(starts.withColumnsRenamed({"id": "s_id", "text_key": "s_key"}), small)
    met = texts.join(wanted, (F.col("text_key") == F.col("s_key")) & F.col("id").eqNullSafe(F.col("s_id")))
    placed = met.select("id", "item", "g", "len", "led", "starts", pieces_of(F.col("text")).alias("words"))
    placed = placed.select("id", "item", "g", "len", "led", "words", F.explode("starts").alias("start"))
    n = F.expr("size(words) - led - cast(size(words) > 1 AND element_at(words, -1) = '' AS int)")
    cut = placed.withColumn("window", F.slice("words", F.col("start") + F.col("led") + 1, F.least("len", n)))
    return spread(cut.select("id", "item", "g", "len", "start", "window").dropDuplicates(["id", "item", "start", "window"]))


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})

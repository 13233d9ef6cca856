"""Token sequences: vocabulary, encoding, packing, block layouts, spans and association."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as AR
from ..functions import fixed_values as V
from .ordering import running_offsets


def word_vocab(words: DataFrame, column: str = "w", size: int = V.VOCAB_SIZE) -> DataFrame:
    """(word, id) of the most frequent words; ids follow the four special ones.

    At most ``size`` rows: the ranking window runs after the limit.
    """
    # an outer explosion has no filter on the size of the array, for which Spark would split each text twice more
    listed = words.select(F.explode_outer(column).alias("word")).filter("word is not null")
    counts = listed.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.col("word")]
    rank = F.row_number().over(Window.orderBy(*order))
    return counts.orderBy(*order).limit(size - V.EOS_ID).select("word", (rank + V.EOS_ID).alias("id"))


def vocab_encoder(vocab: DataFrame):
    """Arrow UDF: array of words to array of ids, unknown words to UNK.

    The vocabulary is at most 2^14 short words (the id space), so it travels with the function;
    encoding needs no shuffle of the token rows.
    """
    rows = vocab.orderBy("id").collect()
    known = pa.array([r["word"] for r in rows], pa.string())
    ids = np.array([r["id"] for r in rows] + [V.UNK_ID], dtype=np.int32)

    def encode(words: pa.Array) -> pa.Array:
        offsets, values = AR.list_parts(words)
        at = pc.fill_null(pc.index_in(values, value_set=known), len(known))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[at.to_numpy(zero_copy_only=False)]))

    return AR.piecewise_udf(encode, "array<int>")


def document_ids(ids: Column, extra_eos: bool = True) -> Column:
    """bos + ids + eos, with the second end mark of the packed layout unless switched off."""
    tail = [F.lit(V.EOS_ID)] * (2 if extra_eos else 1)
    return F.concat(F.array(F.lit(V.BOS_ID)), ids, F.array(*tail))


def pack_blocks(
    docs: DataFrame,
    key: str,
    ids: str = "ids",
    block_len: int = V.BLOCK_LEN,
    extra_eos: bool = True,
    width: int = 1 << 16,
    n_ids: str | None = None,
) -> DataFrame:
    """(block_id, ids): all documents in order of their unique key as one sequence, cut into equal blocks.

    Offsets come from a two-level prefix sum over (key, size) and are joined back once. Documents
    travel as slices of arrays, one per touched block, so the final shuffle moves arrays and not
    token rows. Only the very last block is filled up with PAD. ``n_ids`` names a column with the
    number of ids, which spares an encoding pass where the ids are computed.
    """
    marks = 3 if extra_eos else 2
    sized = docs.select(key, ((F.size(ids) if n_ids is None else F.col(n_ids)) + marks).alias("n"))
    offsets = running_offsets(sized, key, "n", width=width)
    placed = docs.select(key, document_ids(F.col(ids), extra_eos).alias("ids")).join(offsets, key)
    first = F.floor(F.col("offset") / block_len)
    last = F.floor((F.col("offset") + F.col("n") - 1) / block_len)
    touched = placed.withColumn("block_id", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block_id") * block_len, F.col("offset"))
    stop = F.least((F.col("block_id") + 1) * block_len, F.col("offset") + F.col("n"))
    piece = F.slice("ids", (start - F.col("offset") + 1).cast("int"), (stop - start).cast("int"))
    pieces = touched.select("block_id", F.struct(start.alias("start"), piece.alias("piece")).alias("p"))
    ordered = F.array_sort(F.collect_list("p"))
    joined = pieces.groupBy("block_id").agg(F.flatten(F.transform(ordered, lambda p: p["piece"])).alias("ids"))
    return joined.select("block_id", AR.pad_to(F.col("ids"), block_len, F.lit(V.PAD_ID)).alias("ids"))


def blocks_disjoint(blocks: DataFrame) -> DataFrame:
    """Layout A: inputs and targets inside one block, one pair fewer than tokens."""
    n = F.size("ids")
    return blocks.select("block_id", F.slice("ids", 1, n - 1).alias("x"), F.slice("ids", F.lit(2), n - 1).alias("y"))


def with_next_token(blocks: DataFrame) -> DataFrame:
    """First token of the following block, by an equi-join of neighbours (null at the end)."""
    heads = blocks.select((F.col("block_id") - 1).alias("block_id"), F.get("ids", F.lit(0)).alias("next_token"))
    return blocks.join(heads, "block_id", "left")


def blocks_overlap(blocks: DataFrame) -> DataFrame:
    """Layout B: windows that share one token with the next block; the last block has none."""
    linked = with_next_token(blocks).filter("next_token is not null")
    targets = F.concat(F.slice("ids", F.lit(2), F.size("ids") - 1), F.array("next_token"))
    return linked.select("block_id", F.col("ids").alias("x"), targets.alias("y"))


def bigram_counts(blocks: DataFrame) -> DataFrame:
    """(x, y, nxy) over the whole sequence, pairs across block borders included."""
    tail = F.when(F.col("next_token").isNotNull(), F.array("next_token")).otherwise(F.array().cast("array<int>"))
    following = F.concat(F.slice("ids", F.lit(2), F.size("ids") - 1), tail)
    pairs = with_next_token(blocks).select(
        F.inline(F.arrays_zip(F.slice("ids", F.lit(1), F.size(following)).alias("x"), following.alias("y")))
    )
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("nxy"))


def pmi(counts: DataFrame) -> DataFrame:
    """log2(nxy * N / (nx * ny)) with N tokens = pairs + 1; marginals come from the pair table."""
    nx = counts.groupBy("x").agg(F.sum("nxy").alias("nx"))
    ny = counts.groupBy("y").agg(F.sum("nxy").alias("ny"))
    n = counts.agg((F.sum("nxy") + 1).cast("double").alias("n")).scalar()
    value = F.log2(F.col("nxy") * n / (F.col("nx").cast("double") * F.col("ny")))
    return counts.join(nx, "x").join(ny, "y").withColumn("pmi", value)


def pmi_entities(
    scored: DataFrame,
    vocab: DataFrame,
    count_band: tuple[float, float] = (V.PMI_MIN_COUNT, V.PMI_MAX_COUNT),
    pmi_band: tuple[float, float] = (V.PMI_MIN, V.PMI_MAX),
    top: int = V.PMI_TOP,
    shape: str = V.ENTITY_SHAPE,
    length: tuple[int, int] = V.ENTITY_LENGTH,
    punct: str = V.ENTITY_PUNCT,
    prefix: str = V.ENTITY_BAD_PREFIX,
    suffix: str = V.ENTITY_BAD_SUFFIX,
) -> DataFrame:
    """Strongly associated, rarely seen pairs, decoded and cleaned lexically."""
    nxy, score = F.col("nxy"), F.col("pmi")
    band = (nxy > count_band[0]) & (nxy < count_band[1]) & (score > pmi_band[0]) & (score < pmi_band[1])
    best = scored.filter(band).orderBy(F.desc("pmi"), "x", "y").limit(top)
    left = vocab.select(F.col("id").alias("x"), F.col("word").alias("wx"))
    right = vocab.select(F.col("id").alias("y"), F.col("word").alias("wy"))
    named = best.join(left, "x").join(right, "y").withColumn("entity", F.concat("wx", "wy"))
    entity = F.col("entity")
    return named.filter(
        entity.rlike(shape) & F.length(entity).between(*length)
        & ~entity.rlike(punct) & ~entity.rlike(prefix) & ~entity.rlike(suffix)
    )


def joint_bins(df: DataFrame, x: Column, y: Column, x_width: float, y_width: float) -> DataFrame:
    """Counts on a square grid; values are rounded first so that cell edges are stable."""
    cell = lambda v, w: F.floor(F.round(v, 9) / w)
    return df.groupBy(cell(x, x_width).alias("x_bin"), cell(y, y_width).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def pieces(text: Column, pattern: str) -> Column:
    """Split text by a pattern whose matches cover it completely."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def with_spans(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Adds character ``starts`` and ``ends`` (half-open) of each token."""
    lengths = F.transform(tokens, F.length)
    with_ends = df.withColumn("ends", AR.running_sums(lengths))
    return with_ends.withColumn(
        "starts", F.when(F.size("ends") > 0, F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.size("ends") - 1)))
        .otherwise(F.array().cast("array<int>")),
    )


def truncate_by_span(df: DataFrame, limit: int, pattern: str, text: str = "text", min_tokens: int = 2) -> DataFrame:
    """Cut the text where token ``limit + 1`` starts and tokenise what is left again."""
    found = df.withColumn("tokens", pieces(F.col(text), pattern))
    # the start of that token is the length of those before it, which needs no spans of the whole text
    start = F.aggregate(F.slice("tokens", 1, limit), F.lit(0), lambda acc, token: acc + F.length(token))
    cut = F.rtrim(F.substring(F.col(text), F.lit(1), start), F.lit(" \t\r\n"))
    kept = F.when(F.size("tokens") > limit, cut).otherwise(F.col(text))
    out = found.withColumn(text, kept).drop("tokens")
    return out.withColumn("tokens", pieces(F.col(text), pattern)).filter(F.size("tokens") >= min_tokens)


def masked_sample(
    df: DataFrame, prompt: str = "prompt_ids", response: str = "response_ids", length: int = V.BLOCK_LEN
) -> DataFrame:
    """x, y and loss mask of one instruction pair: loss on the response only, padded or cut."""
    p = F.concat(F.array(F.lit(V.BOS_ID)), F.col(prompt))
    r = F.concat(F.col(response), F.array(F.lit(V.EOS_ID)))
    full = F.concat(p, r)
    n = F.size(full)
    mask = F.concat(F.array_repeat(F.lit(False), F.size(p) - 1), F.array_repeat(F.lit(True), F.size(r)))
    return df.withColumns(
        {
            "x": AR.pad_to(F.slice(full, F.lit(1), n - 1), length, F.lit(V.PAD_ID)),
            "y": AR.pad_to(F.slice(full, F.lit(2), n - 1), length, F.lit(V.PAD_ID)),
            "loss_mask": AR.pad_to(mask, length, F.lit(False)),
        }
    )


def tokenizer_report(docs: DataFrame, ids: str = "ids", text: str = "text") -> DataFrame:
    """Tokens with bos and eos, unknown share, tokens per character."""
    unknown = F.size(F.filter(ids, lambda t: t == V.UNK_ID))
    sums = docs.agg(
        F.sum(F.size(ids) + 2).alias("total_tokens"),
        F.sum(unknown).alias("unk_tokens"),
        F.sum(F.length(text)).alias("total_chars"),
    )
    return sums.select(
        "total_tokens",
        F.try_divide("unk_tokens", "total_tokens").alias("unk_ratio"),
        F.try_divide("total_tokens", "total_chars").alias("tokens_per_char"),
    )


def samples_from_rows(rows: DataFrame, row: str = "row", length: int = V.BLOCK_LEN, **columns: str) -> DataFrame:
    """Flat training rows back to samples of ``length`` positions, arrays in row order."""
    tagged = rows.withColumn("sample_id", F.floor(F.col(row) / length))
    item = F.struct(F.col(row), *[F.col(c) for c in columns.values()])
    grouped = tagged.groupBy("sample_id").agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    return grouped.select(
        "sample_id", *[F.col("_rows").getField(c).alias(name) for name, c in columns.items()]
    )

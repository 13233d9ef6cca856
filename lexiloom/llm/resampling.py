"""Importance resampling of documents towards a target distribution of hashed word n-grams.

A text is normalised once, to lower-cased words with one separator between them, and the CRC-32
state after each word border is kept. The checksum of any run of words then follows from the states
at its two ends: shifting the earlier state by the run's length, a linear map over GF(2), and adding
it cancels everything before the run. No n-gram is ever cut out of its text.

A feature's bucket is its checksum modulo the number of buckets. A bucket gains the logarithm of its
smoothed share in the target over that in the corpus, a document weighs the sum of the gains of its
features, and adding Gumbel noise drawn from its id and taking the highest scores draws documents
without replacement in proportion to the exponentials of their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written_table
from .base import query, table, text_or_empty

LONGEST, BUCKETS = 1, 10_000
SHARE, OF, MIN_WORDS, SEED = 10, 100, 20, 2024
#: Words whose running checksums are held at a time, and rows a range of the ranking holds.
CHUNK, RANGE_ROWS = 1 << 18, 100_000

_U = np.uint32
_ALL = _U(0xFFFFFFFF)
#: Fixed value: the reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


@cache
def _byte_states() -> np.ndarray:
    """The state that each byte leaves behind when it follows state 0."""
    states = np.arange(256, dtype=_U)
    for _ in range(8):
        states = (states >> _U(1)) ^ np.where(states & _U(1), _U(_POLYNOMIAL), _U(0))
    return states


def _one_byte(states: np.ndarray) -> np.ndarray:
    return (states >> _U(8)) ^ _byte_states()[states & _U(255)]


def _one_byte_back(states: np.ndarray) -> np.ndarray:
    led = np.zeros(256, _U)
    led[_byte_states() >> _U(24)] = np.arange(256, dtype=_U)
    low = led[states >> _U(24)]
    return ((states ^ _byte_states()[low]) << _U(8)) | low


def _apply(maps: np.ndarray, which: np.ndarray | int, states: np.ndarray) -> np.ndarray:
    """Linear maps of a state, given by the images of the values of its four bytes."""
    image = maps[which, 0, states & _U(255)]
    for k in (1, 2, 3):
        image = image ^ maps[which, k, (states >> _U(8 * k)) & _U(255)]
    return image


def _powers(first: np.ndarray, step) -> np.ndarray:
    maps = [first]
    for _ in range(256):
        maps.append(step(maps[-1]))
    return np.stack(maps)


def _identity() -> np.ndarray:
    return np.stack([np.arange(256, dtype=_U) << _U(8 * k) for k in range(4)])


@cache
def _shifts(level: int) -> np.ndarray:
    """Maps that append 0 to 256 times 256^level zero bytes."""
    if level == 0:
        return _powers(_identity(), _one_byte)
    whole = _shifts(level - 1)
    return _powers(_identity(), lambda states: _apply(whole, 256, states))


@cache
def _unshifts() -> np.ndarray:
    return _powers(_identity(), _one_byte_back)


@cache
def _weights() -> np.ndarray:
    """What a byte at place j of a block of 256 adds to the state at the block's end."""
    return np.stack([_apply(_shifts(0), 255 - j, _byte_states()) for j in range(256)])


def shifted(states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The states after ``lengths`` more zero bytes each."""
    level = 0
    while lengths.any():
        states = _apply(_shifts(level), lengths & 255, states)
        lengths, level = lengths >> 8, level + 1
    return states


def running_states(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """CRC states (from 0, without final inversion) after the first ``at`` bytes of ``data``."""
    blocks = -(-len(data) // 256)
    padded = np.zeros(blocks * 256, np.uint8)
    padded[: len(data)] = data
    inside = np.bitwise_xor.accumulate(_weights()[np.arange(256), padded.reshape(blocks, 256)], axis=1)
    begin = np.concatenate([np.zeros(1, _U), inside[:, 255]])  # begin[q]: the state before block q
    width = 1
    while width < len(begin):
        begin[width:] = begin[width:] ^ shifted(begin[:-width], np.full(len(begin) - width, 256 * width))
        width *= 2
    q = np.maximum(at - 1, 0) // 256
    j = at - 256 * q
    part = _apply(_unshifts(), 256 - j, inside[q, np.maximum(j, 1) - 1])
    return _apply(_shifts(0), j, begin[q]) ^ np.where(j > 0, part, _U(0))


def _normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of all texts, one separator before each but a text's first; their starts, ends and texts.

    Digits, letters a-z and everything outside ASCII make words. Each of several separators is a
    byte of its own in UTF-8, so bytes decide.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    word = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    before = np.concatenate([[False], word[:-1]])
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    led = starts[np.concatenate([[False], owner[1:] == owner[:-1]])] if len(starts) else starts
    kept = word.copy()
    kept[led - 1] = True
    data[led - 1] = 32
    place = np.cumsum(kept) - kept
    # A word ends where the next one starts, less a separator if both are of one text.
    begins = place[starts]
    ends = np.append(begins[1:], kept.sum())
    ends[:-1] -= owner[1:] == owner[:-1]
    return data[kept], begins, ends[: len(begins)], owner


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and (text, bucket) arrays of all runs of 1 to ``longest`` words."""
    data, starts, ends, owner = _normalised(texts)

    def features():
        for low in range(0, len(starts), CHUNK):
            high = min(low + CHUNK, len(starts))
            last = min(high + longest - 1, len(starts))
            base = starts[low]
            part = data[base : ends[last - 1]]
            at_end = running_states(part, ends[low:last] - base)
            before = np.concatenate([np.zeros(1, _U), at_end[: high - low - 1]])
            spaced = starts[low + 1 : high] > ends[low : high - 1]  # a separator follows the word before
            at_start = np.where(np.concatenate([[False], spaced]), _one_byte(before ^ _U(32)), before)
            for n in range(1, longest + 1):
                k = min(high, len(starts) - n + 1) - low
                if k <= 0:
                    break
                i = np.arange(low, low + k)
                one = owner[i] == owner[i + n - 1]
                i = i[one]
                lengths = ends[i + n - 1] - starts[i]
                crc = at_end[i + n - 1 - low] ^ shifted(at_start[i - low] ^ _ALL, lengths) ^ _ALL
                yield owner[i], (crc % _U(buckets)).astype(np.int64)

    return np.bincount(owner, minlength=len(texts)), features()


def bucket_counts(df: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts of ``df``; each task sends its own totals only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in feature_buckets(batch["text"], longest, buckets)[1]:
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    texts = df.select(text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, in thousandths; both tables have at most ``buckets`` rows."""
    both = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = both.join(F.broadcast(corpus.select("bucket", F.col("n").alias("s"))), "bucket", "left")
    both = written_table(both.join(F.broadcast(target.select("bucket", F.col("n").alias("t"))), "bucket", "left").fillna(0), "buckets")
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    odds = (F.col("t") + 1).cast("double") * F.lit(float(sums["s"] + buckets))
    odds = odds / ((F.col("s") + 1).cast("double") * F.lit(float(sums["t"] + buckets)))
    rows = both.select("bucket", F.floor(1000 * F.log(odds)).alias("gain")).collect()
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in rows:
        gains[bucket] = gain
    return gains


def weighed(docs: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """(id, n_words, n_features, weight) of every row of ``docs`` (id, text)."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features = feature_buckets(batch["text"], longest, buckets)
            n, weight = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for owner, found in features:
                n += np.bincount(owner, minlength=len(words))
                np.add.at(weight, owner, gains[found])
            yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array(x, pa.int64()) for x in (words, n, weight)]], ["id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(weigh, f"id {docs.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    share: int = SHARE,
    of: int = OF,
    min_words: int = MIN_WORDS,
    seed: int | str = SEED,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, rank.

    Of the N rows with at least ``min_words`` words the floor(share * N / of) with the highest scores
    are drawn and ranked from 1; equal scores go to the smaller id, and of rows that repeat an id
    either may come first. The rank of all others is null. A null or wordless text has no
    features and weight 0. A null id draws noise as an empty one does and comes before
    other ids. Without rows, or with an empty target, nothing fails: the target's shares are
    then all alike. Columns other than id and text are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    corpus = bucket_counts(texts, "text", longest, buckets)
    gains = bucket_gains(corpus, bucket_counts(target, target_text_col, longest, buckets), buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    draw = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(draw)))
    scored = written_table(weighed(texts, gains, longest).withColumn("score", score), "scored")
    return _ranked(scored, share, of, min_words)


def _ranked(scored: DataFrame, share: int, of: int, min_words: int) -> DataFrame:
    """Ranks by ranges of (score, id); only a row per range is summed in one place."""
    columns = ["id", "n_features", "weight", "score"]
    eligible = scored.filter(F.col("n_words") >= min_words)
    n = eligible.count()
    drawn = share * n // of
    order = [F.desc("score"), F.asc("id")]
    ranged = eligible.repartitionByRange(max(1, ceil(n / RANGE_ROWS)), *order)
    placed = written_table(ranged.select(*columns, F.spark_partition_id().alias("range")), "ranges")
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("range")) - F.col("rows")
    sizes = sizes.select("range", before.alias("before"))
    held = placed.join(F.broadcast(sizes), "range")  # one row per range
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    first = held.filter(F.col("before") < drawn).withColumn("place", place)
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank")
    rest = held.filter(F.col("before") >= drawn).unionByName(scored.filter(F.col("n_words") < min_words), allowMissingColumns=True)
    return first.select(*columns, rank).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


#: CRC-32 of a blob column, bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({hex}) + 1, 2), lambda i: ('0x' || {hex}[i:i + 1])::BIGINT)),
  lambda a, b: xor((xor(a, b) >> 8), crc_table[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"""
CRC_TABLE_SQL = """(SELECT list(list_reduce(list_prepend(v, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) ORDER BY v)
  AS crc_table FROM (SELECT unnest(range(256)) AS v))"""
_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op11_resample", f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM (SELECT {_WORDS_SQL} AS w FROM benchmark)),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
f AS (SELECT word, {CRC_SQL.format(hex="x")} % 10000 AS b FROM h, {CRC_TABLE_SQL}),
s AS (SELECT b, count(*) AS s FROM dw JOIN f USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN f USING (word) GROUP BY b),
st AS (SELECT b, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM (SELECT DISTINCT b FROM f) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
su AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM st),
g AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM st, su),
n AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM dw JOIN f USING (word) JOIN g USING (b) GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN n USING (doc_id)),
sc AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, rank::BIGINT AS rank FROM sc LEFT JOIN (SELECT * FROM e WHERE rank <= 10 * n // 100) USING (doc_id)""")
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")

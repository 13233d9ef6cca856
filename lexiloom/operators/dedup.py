"""Near-duplicate removal with MinHash signatures and banded buckets.

A document B goes when any earlier document A shares a band with it and at least
``threshold`` of the signature slots agree; A counts even if it was dropped itself.

No step lists the pairs of a group, and no bucket is left out for being large:

* copies share a signature, so they collapse to their first document in an aggregation;
* a bucket with few undecided documents is checked row by row against their bounded list;
* a bucket with many is first cleared by comparison with a bounded set of early members and
  then split: two signatures that differ in at most d slots must agree on at least one of
  d + 1 slot groups, so the pairs of a bucket survive in its d + 1 smaller sub-buckets;
* what is still crowded after the splits is compared with bounded lists of its undecided
  documents, several lists per bucket, spread over salted tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage, written_table

try:  # the interpreter's own digest has less overhead on short texts
    from _md5 import md5
except ImportError:
    md5 = hashlib.md5

PRIME = 2**31 - 1


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (a, b) of ``(a * h + b) mod PRIME``, drawn from md5 so any engine can repeat them."""

    def draw(kind: str, i: int) -> int:
        return int(hashlib.md5(f"{kind}:{seed}:{i}".encode()).hexdigest()[:8], 16)

    a = np.array([1 + draw("a", i) % (PRIME - 1) for i in range(n)], dtype=np.int64)
    b = np.array([draw("b", i) % PRIME for i in range(n)], dtype=np.int64)
    return a, b


def shingle_hashes(text: bytes, starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Hashes below PRIME of the distinct word n-grams of one text; words lie from ``starts`` to ``stops``."""
    grams = {text[a:b] for a, b in zip(starts[: len(starts) - n + 1].tolist(), stops[n - 1 :].tolist())}
    head = b"".join([md5(g).digest()[:4] for g in grams])
    return np.frombuffer(head, dtype=">u4").astype(np.int64) % PRIME


def slot_minima(a: np.ndarray, b: np.ndarray, hashes: np.ndarray, step: int = 256) -> np.ndarray:
    """The least ``(a * h + b) mod PRIME`` over ``hashes`` (below PRIME) for each coefficient pair."""
    low = np.full(len(a), PRIME, np.uint32)
    a, b = a[:, None], b[:, None]
    for at in range(0, len(hashes), step):  # work arrays of this width stay in the processor cache
        x = a * hashes[None, at : at + step]
        x += b
        high = x >> 31
        x &= PRIME
        x += high
        # At most 2 * PRIME - 2 by now. Below PRIME the difference wraps around and is the larger one.
        folded = x.astype(np.uint32)
        np.minimum(folded, folded - np.uint32(PRIME), out=folded)
        np.minimum(low, folded.min(axis=1), out=low)
    return low.astype(np.int32)


def minhash(n_hashes: int, seed: int, ngram: int):
    """Arrow UDF: array of words to ``n_hashes`` minima; null under ``ngram`` words.

    Marked non-deterministic only so that a filter on its result is not pushed below it,
    which would compute every signature twice.
    """
    a, b = hash_family(n_hashes, seed)

    def signature(texts: pa.Array) -> pa.Array:
        bounds, words = texts.offsets.to_pylist(), texts.values
        joined = pa.compute.binary_join(texts, " ")
        ends = np.append(0, np.cumsum(pa.compute.binary_length(words).to_numpy(zero_copy_only=False)))
        out = []
        for text, start, stop in zip(joined, bounds, bounds[1:]):
            if stop - start < ngram:
                out.append(None)
                continue
            spaces = np.arange(stop - start)
            starts = ends[start:stop] - ends[start] + spaces
            stops = ends[start + 1 : stop + 1] - ends[start] + spaces
            out.append(slot_minima(a, b, shingle_hashes(text.as_buffer().to_pybytes(), starts, stops, ngram)))
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(signature, "array<int>").asNondeterministic()


def signatures(
    df: DataFrame, key: str, text: str = "text", ngram: int = 5, n_hashes: int = 100, seed: int = 42
) -> DataFrame:
    """(doc, sig) for every text that has a signature; short texts are never candidates."""
    long_enough = df.filter(F.length(F.trim(F.col(text))) >= 5)
    signed = long_enough.select(
        F.col(key).alias("doc"), minhash(n_hashes, seed, ngram)(T.words(F.col(text))).alias("sig")
    )
    return signed.filter(F.col("sig").isNotNull())


def band_keys(sig: Column, bands: int, rows: int) -> Column:
    """Array of one 64-bit key per band."""
    keys = [
        F.xxhash64(F.lit(b), *[F.get(sig, F.lit(b * rows + r)) for r in range(rows)]) for b in range(bands)
    ]
    return F.array(*keys)


def collapse_copies(sigs: DataFrame) -> DataFrame:
    """(doc, first_doc) per signature; equal signatures mean an estimate of 1."""
    tagged = sigs.withColumns({"k1": F.xxhash64("sig"), "k2": F.xxhash64(F.reverse("sig"))})
    firsts = tagged.groupBy("k1", "k2").agg(F.min("doc").alias("first_doc"))
    return tagged.join(firsts, ["k1", "k2"]).select("doc", "sig", "first_doc")


def collision_buckets(sigs: DataFrame, bands: int = 20, rows: int = 5) -> DataFrame:
    """(band, key, n_docs, first_doc, last_doc) of every bucket with at least two documents."""
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.struct(
            b.alias("band"),
            F.md5(F.array_join(F.transform(F.slice(F.col("sig"), b * rows + 1, F.lit(rows)), lambda v: v.cast("string")), "_")).alias("key"),
        ),
    )
    placed = sigs.select("doc", F.inline(slots))
    return placed.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")
    ).filter("n_docs > 1")


def _equal_slots(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _matches(items: DataFrame, listed: DataFrame, need: int, salt: int, listed_is_later: bool) -> DataFrame:
    """Documents dropped by comparing each item with the bounded list of its bucket.

    ``listed`` has one row per bucket; it is repeated ``salt`` times so that the rows of a hot
    bucket spread over ``salt`` tasks. Only confirmed drops leave the comparison.
    """
    left = items.withColumn("salt", F.pmod(F.hash("doc"), F.lit(salt)))
    right = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    joined = left.join(right, ["bucket", "salt"])
    if listed_is_later:
        hits = F.filter(
            "members",
            lambda m: (m["doc"] > F.col("doc")) & (_equal_slots(m["sig"], F.col("sig")) >= need),
        )
        return joined.select(F.explode(F.transform(hits, lambda m: m["doc"])).alias("doc")).distinct()
    hit = F.exists(
        "members",
        lambda m: (m["doc"] < F.col("doc")) & (_equal_slots(m["sig"], F.col("sig")) >= need),
    )
    return joined.filter(hit).select("doc").distinct()


def _sub_buckets(items: DataFrame, n_hashes: int, need: int, level: int) -> DataFrame:
    """Split buckets by slot groups; ``level`` rotates the grouping so each split is a new one."""
    groups = n_hashes - need + 1
    order = [(s * (2 * level + 1) + level) % n_hashes for s in range(n_hashes)]
    parts = [order[g::groups] for g in range(groups)]
    keys = F.array(
        *[F.xxhash64(F.col("bucket"), F.lit(g), *[F.get("sig", F.lit(s)) for s in part]) for g, part in enumerate(parts)]
    )
    exploded = items.select(F.explode(keys).alias("bucket"), "doc", "sig")
    crowded = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    return exploded.join(crowded, "bucket")


def near_duplicates(
    sigs: DataFrame,
    threshold: float = 0.8,
    bands: int = 20,
    rows: int = 5,
    bucket_limit: int = 64,
    salt: int = 16,
    max_splits: int = 1,
) -> DataFrame:
    """(doc) of all documents to drop. ``sigs`` is read several times and should be a table."""
    n_hashes = bands * rows
    need = int(np.ceil(round(threshold * n_hashes, 9)))
    grouped = collapse_copies(sigs)
    copies = grouped.filter("doc != first_doc").select("doc")
    firsts = grouped.filter("doc = first_doc").select("doc", "sig")
    placed = firsts.select(F.explode(band_keys(F.col("sig"), bands, rows)).alias("bucket"), "doc")
    crowded = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    items = written_table(
        placed.join(crowded, "bucket").join(firsts, "doc").select("bucket", "doc", "sig", "n"), "bucket-items"
    )
    small = items.filter(F.col("n") <= bucket_limit).drop("n")
    dropped = copies.unionByName(_resolve_small(small, small, need, 1))

    rest = items.filter(F.col("n") > bucket_limit).drop("n")
    level = 0
    decided = None
    while not rest.isEmpty():
        # clear whatever matches one of a few early members of its bucket
        early = rest.groupBy("bucket", F.pmod(F.hash("doc"), F.lit(bucket_limit)).alias("slot")).agg(
            F.min_by(F.struct("doc", "sig"), "doc").alias("m")
        ).groupBy("bucket").agg(F.collect_list("m").alias("members"))
        found = _matches(rest, early, need, salt, listed_is_later=False)
        decided = cut_lineage(found if decided is None else decided.unionByName(found).distinct())
        open_rows = rest.join(decided, "doc", "left_anti")
        open_counts = open_rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_open"))
        # few undecided: compare every member with them; none: the bucket is done
        easy = open_counts.filter(F.col("n_open") <= bucket_limit).select("bucket")
        dropped = dropped.unionByName(
            _resolve_small(rest.join(easy, "bucket"), open_rows.join(easy, "bucket"), need, salt)
        )
        hard = open_counts.filter(F.col("n_open") > bucket_limit)
        crowd = rest.join(hard.select("bucket"), "bucket")
        if level == max_splits:
            chunk = F.pmod(F.hash("doc"), F.ceil(F.col("n_open") / bucket_limit).cast("int"))
            lists = open_rows.join(hard, "bucket").withColumn("chunk", chunk)
            dropped = dropped.unionByName(_resolve_small(crowd, lists, need, salt, "chunk"))
            break
        rest = cut_lineage(_sub_buckets(crowd, n_hashes, need, level))
        level += 1
    if decided is not None:
        dropped = dropped.unionByName(decided)
    return dropped.distinct()


def _resolve_small(items: DataFrame, undecided: DataFrame, need: int, salt: int, *chunk: str) -> DataFrame:
    """Every item against the bounded lists of undecided documents of its bucket."""
    listed = undecided.groupBy("bucket", *chunk).agg(F.collect_list(F.struct("doc", "sig")).alias("members"))
    return _matches(items, listed.select("bucket", "members"), need, salt, listed_is_later=True)


def drop_near_duplicates(df: DataFrame, key: str, text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that survive; texts without a signature always do."""
    shape = {k: options.pop(k) for k in ("ngram", "seed") if k in options}
    n_hashes = options.get("bands", 20) * options.get("rows", 5)
    sigs = written_table(signatures(df, key, text, n_hashes=n_hashes, **shape), "signatures")
    gone = near_duplicates(sigs, **options).withColumnRenamed("doc", key)
    return df.join(gone, key, "left_anti")

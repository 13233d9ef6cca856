"""Global ranks, offsets, samples and set operations without a single-task window.

A window without partition keys moves the whole table to one task. Everything here ranks in
two levels instead: rows are ranked inside buckets whose order agrees with the global order,
and only the small table of bucket totals is summed up.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import shuffle_key, uniform_draw


def _before(order: Sequence[Column], part: Sequence[Column] = ()) -> Window:
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def bucket_offsets(totals: DataFrame, coarse: str, fine: str, size: str = "n") -> DataFrame:
    """Offset of each (coarse, fine) bucket.

    The only unpartitioned window runs over one row per ``coarse`` value, which callers keep
    small (a length, or a block of 2^16 ids); it carries integers only.
    """
    by_coarse = totals.groupBy(coarse).agg(F.sum(size).alias("_total"))
    coarse_off = by_coarse.select(
        coarse, F.coalesce(F.sum("_total").over(_before([F.col(coarse)])), F.lit(0)).alias("_coarse_off")
    )
    inside = F.coalesce(F.sum(size).over(_before([F.col(fine)], [F.col(coarse)])), F.lit(0))
    return (
        totals.withColumn("_fine_off", inside)
        .join(coarse_off, coarse)
        .select(coarse, fine, (F.col("_coarse_off") + F.col("_fine_off")).alias("bucket_offset"))
    )


def global_rank(
    df: DataFrame, coarse: Column, fine: Column, order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """0-based global rank by (coarse, fine, order).

    ``fine`` splits a hot ``coarse`` value, for example by a hash prefix, so that no bucket
    holds more than a small share of the rows.
    """
    keyed = df.withColumns({"_coarse": coarse, "_fine": fine})
    totals = keyed.groupBy("_coarse", "_fine").agg(F.count(F.lit(1)).alias("n"))
    offsets = bucket_offsets(totals, "_coarse", "_fine")
    inside = F.row_number().over(Window.partitionBy("_coarse", "_fine").orderBy(*order)) - 1
    return (
        keyed.withColumn("_inside", inside)
        .join(offsets, ["_coarse", "_fine"])
        .withColumn(name, (F.col("bucket_offset") + F.col("_inside")).cast("bigint"))
        .drop("_coarse", "_fine", "_inside", "bucket_offset")
    )


def running_offsets(
    df: DataFrame, key: str, size: str, name: str = "offset", width: int = 1 << 16
) -> DataFrame:
    """(key, size, offset): exclusive running sum of ``size`` in order of the unique integer ``key``.

    Only these two columns are read. They are cut into ranges of about ``width`` rows at quantiles of
    the key, so sparse or lumpy keys fill the ranges as evenly as dense ones do; from 4096 ranges
    on they grow instead. The table is read once before for its quantiles.
    """
    slim = df.select(key, size)
    bounds = _range_bounds(slim, key, width)
    # Two short looks, one over the coarse bounds and one inside, find the range of a key.
    kind = slim.schema[key].dataType
    at_most = lambda bounds_: F.size(F.filter(bounds_, lambda b: b <= F.col(key)))
    firsts = F.array(*[F.lit(group[0]).cast(kind) for group in bounds]) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    groups = F.array(*[F.array(*[F.lit(b).cast(kind) for b in group]) for group in bounds]) if bounds else None
    keyed = slim.withColumn("_coarse", at_most(firsts))
    fine = at_most(F.get(groups, F.col("_coarse") - 1)) if bounds else F.lit(0)
    keyed = keyed.withColumn("_fine", F.when(F.col("_coarse") > 0, fine).otherwise(F.lit(0)))
    totals = keyed.groupBy("_coarse", "_fine").agg(F.sum(size).alias("n"))
    offsets = bucket_offsets(totals, "_coarse", "_fine")
    inside = F.coalesce(F.sum(size).over(_before([F.col(key)], [F.col("_coarse"), F.col("_fine")])), F.lit(0))
    placed = keyed.withColumn("_inside", inside).join(offsets, ["_coarse", "_fine"])
    return placed.select(key, size, (F.col("bucket_offset") + F.col("_inside")).cast("bigint").alias(name))


def _range_bounds(df: DataFrame, key: str, width: int, most: int = 4096) -> list[list[int]]:
    """Distinct quantiles of ``key`` that cut ``df`` into ranges of about ``width`` rows, in groups of 64."""
    ranges = min(ceil(df.count() / width), most)
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.agg(F.percentile_approx(key, shares, 10 * most)).first()[0] or []))
    return [bounds[i : i + 64] for i in range(0, len(bounds), 64)]


def order_statistics(
    values: DataFrame, ranks: Sequence[int], n: int, limit: int = 100_000, accuracy: int = 10_000
) -> dict[int, float]:
    """The values at the 0-based ``ranks`` of the ``n`` rows of the one-column table ``values`` (double, no nulls).

    Each open rank keeps an open interval that must hold it. A pass narrows the interval between two
    values of a sketch and counts rows below, at and between them, so an answer never rests on the
    sketch. Once at most ``limit`` rows are left inside, their distinct values are fetched.
    """
    (name,) = values.columns
    v = F.col(name)
    inside = lambda low, high: (F.lit(True) if low is None else v > low) & (F.lit(True) if high is None else v < high)
    found: dict[int, float] = {}
    spans = {r: (None, None, 0, n) for r in ranks}  # low, high, rows before the interval, rows in it
    while wide := [r for r, s in spans.items() if r not in found and s[3] > limit]:
        sketch = []
        for r in wide:
            low, high, before, size = spans[r]
            shares = [min(max((r - before) / size + slack / accuracy, 0.0), 1.0) for slack in (-2, 2)]
            sketch.append(F.percentile_approx(F.when(inside(low, high), v), shares, accuracy).alias(f"s{r}"))
        ends = values.agg(*sketch).first()
        tally = []
        for r in wide:
            low, high, _, _ = spans[r]
            left, right = ends[f"s{r}"]
            within = inside(low, high)
            tally.append(F.struct(
                F.count_if(within & (v < left)).alias("under"), F.count_if(within & (v == left)).alias("left"),
                F.count_if(inside(left, right)).alias("mid"), F.count_if(within & (v == right)).alias("right"),
            ).alias(f"t{r}"))
        counts = values.agg(*tally).first()
        for r in wide:
            low, high, before, size = spans[r]
            left, right = ends[f"s{r}"]
            under, at_left, mid, at_right = counts[f"t{r}"]
            at = r - before
            if at < under:
                spans[r] = (low, left, before, under)
            elif at < under + at_left:
                found[r] = left
            elif at < under + at_left + mid:
                spans[r] = (left, right, before + under + at_left, mid)
            elif left < right and at < under + at_left + mid + at_right:
                found[r] = right
            else:
                past = under + at_left + mid + (at_right if left < right else 0)
                spans[r] = (right, high, before + past, size - past)
    left_over = [r for r in spans if r not in found]
    if left_over:
        wanted = F.lit(False)
        for r in left_over:
            wanted = wanted | inside(*spans[r][:2])
        rows = sorted((x[name], x["n"]) for x in values.filter(wanted).groupBy(name).agg(F.count(F.lit(1)).alias("n")).collect())
        for r in left_over:
            low, high, seen, _ = spans[r]
            for value, count in rows:
                if (low is None or value > low) and (high is None or value < high):
                    seen += count
                    if r < seen:
                        found[r] = value
                        break
    return found


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], limit: int = 100_000) -> list[float | None]:
    """Quantiles with linear interpolation, as ``percentile`` defines them, without its counter per value.

    Nulls and NaN do not count; without rows every quantile is null. ``df`` is read a few times
    (two for up to ``limit`` rows, two more for each factor of about 2500), so pass a written table
    where it is dear. The driver holds at most ``limit`` values per quantile end.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n = values.count()
    if n == 0:
        return [None] * len(probs)
    places = [float(p) * (n - 1) for p in probs]
    at = order_statistics(values, sorted({r for x in places for r in (floor(x), ceil(x))}), n, limit)
    between = lambda x: at[floor(x)] if at[floor(x)] == at[ceil(x)] else (ceil(x) - x) * at[floor(x)] + (x - floor(x)) * at[ceil(x)]
    return [between(x) for x in places]


def top_n(df: DataFrame, score: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(score), *ties).limit(n)


def rank_slice(df: DataFrame, score: str, first: int, last: int, *ties: str) -> DataFrame:
    """Rows ranked first..last (1-based, inclusive) by descending score."""
    return df.orderBy(F.desc(score), *ties).offset(first - 1).limit(last - first + 1)


def hash_sample(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """Bernoulli sample whose draw depends only on (seed, keys), so reruns agree."""
    return df.filter(uniform_draw(seed, *[F.col(k) for k in keys]) < fraction)


def fixed_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly n rows in hash order (top-k per task, then merge)."""
    return df.orderBy(shuffle_key(seed, *[F.col(k) for k in keys]), *keys).limit(n)


def seeded_shuffle(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Reproducible global permutation, as a ``rank`` column."""
    tagged = df.withColumn("_order", shuffle_key(seed, *[F.col(k) for k in keys]))
    ranked = global_rank(
        tagged,
        F.substring("_order", 1, 2),
        F.substring("_order", 1, 4),
        [F.col("_order"), *[F.col(k) for k in keys]],
    )
    return ranked.drop("_order")


def length_batches(df: DataFrame, length: Column, batch: int, key: str, seed: int = 0) -> DataFrame:
    """Similar lengths together: ``batch`` numbers in length order, ties in hash order."""
    tagged = df.withColumns({"_len": length, "_order": shuffle_key(seed, F.col(key))})
    ranked = global_rank(
        tagged, F.col("_len"), F.substring("_order", 1, 2), [F.col("_order"), F.col(key)]
    )
    return ranked.withColumn("batch", F.floor(F.col("rank") / batch)).withColumnRenamed("_len", "len").drop("_order")


def padded_cost(batches: DataFrame) -> DataFrame:
    """Cells after padding each batch to its longest row."""
    return batches.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("len").alias("max_len"),
        (F.count(F.lit(1)) * F.max("len")).alias("padded_cells"),
        F.sum("len").alias("used_cells"),
    )


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key value, the first in ``order``; copies collapse before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    first = F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("_row")
    return df.groupBy(F.sha2(key, 256).alias("_key")).agg(first).select("_row.*")


def not_in(df: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is absent from ``done``."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def only_wanted(df: DataFrame, wanted: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose key is in ``wanted``, a written table whose columns are the key.

    The keys are broadcast if a count proves them few, else the join is a shuffled one.
    """
    few = wanted.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(wanted) if few else wanted, wanted.columns, "left_semi")


def distinct_endpoints(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.explode(F.array(src, dst)).alias("node")).distinct()


def assign_batches(
    df: DataFrame, order: Sequence[Column], size: int, coarse: Column, top: int | None = None, group: int = 10
) -> DataFrame:
    """Rank, batch and batch group of every row, or of the ``top`` rows.

    ``coarse`` buckets the rows in the order of the ranking, so that no task ranks the whole table.
    """
    chosen = df if top is None else df.orderBy(*order).limit(top)
    ranked = global_rank(chosen, coarse, F.lit(0), order)
    return ranked.withColumn("rank", F.col("rank") + 1).withColumns(
        {
            "batch": F.floor((F.col("rank") - 1) / size) + 1,
            "batch_group": F.floor((F.col("rank") - 1) / (size * group)) + 1,
        }
    )


def quota_batches(quota: DataFrame, size: int) -> DataFrame:
    """(category, code, count) to one row per request batch; the last one may be smaller."""
    batches = F.sequence(F.lit(1), F.ceil(F.col("count") / size).cast("int"))
    return quota.filter("count > 0").select("category", "code", F.explode(batches).alias("batch"), "count").withColumn(
        "n_items", F.least(F.lit(size), F.col("count") - (F.col("batch") - 1) * size).cast("int")
    )


def quota_item_ids(returned: DataFrame, size: int) -> DataFrame:
    """Ids ``code_%04d`` at (batch - 1) * size + i; a short batch leaves a gap."""
    items = returned.filter("n_items > 0").withColumn(
        "i", F.explode(F.sequence(F.lit(1), F.col("n_items").cast("int")))
    )
    number = ((F.col("batch") - 1) * size + F.col("i")).cast("int")
    return items.withColumn("id", F.format_string("%s_%04d", "code", number))

"""Mixing sources to target weights by iterative proportional fitting.

Spark sums tokens per (source, language, topic) cell. The cell weights are raked to the target share
of each source, language and topic in turn until all marginals fit. Sampling probabilities
proportional to the weights, at most 1, are calibrated to a token budget, and a keyed hash draw
takes each document with its cell's probability.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform_draw
from ..session import cut_lineage, written_table
from .base import SPACE_RUN, holds_at_most, query, small_or_shuffled, table, text_or_empty

DIMENSIONS = ("source", "lang", "topic")
#: Default targets temper the natural token shares with this exponent.
TEMPER = 0.7
#: Share of all tokens that the sample should hold.
BUDGET = 0.5
#: Both solvers stop raking and halving by these.
TOLERANCE, ROUNDS = 1e-9, 200
BUDGET_TOLERANCE, HALVINGS = 1e-12, 100


def genre(text: Column) -> Column:
    """A coarse topic that any text has: tabular, noisy, short or prose."""
    noisy = text.contains("###") | text.contains("$$$") | text.contains("%%%") | text.contains("&&&") | text.contains("!!")
    return (
        F.when(text.contains(" | "), "tabular").when(noisy, "noisy").when(F.char_length(text) < 400, "short").otherwise("prose")
    )


def token_count(text: Column) -> Column:
    """Number of runs of other characters than white space."""
    pieces = F.split(text, SPACE_RUN)
    led = (F.get(pieces, F.lit(0)) == "").cast("int")
    trailed = ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return (F.size(pieces) - led - trailed).cast("long")


def tempered(tokens: Mapping[str, float], exponent: float = TEMPER) -> dict[str, float]:
    powers = {k: v**exponent for k, v in tokens.items() if v > 0}
    return {k: v / sum(powers.values()) for k, v in powers.items()}


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Weights of the cells whose weighted token shares have the target marginals.

    A category without a target, or whose tokens are 0, gets weight 0; targets are rescaled to what
    is there. Where marginals can't all be met, the last round stands.
    """
    weights = (cells > 0).astype(float)
    for code, target in zip(codes, targets):
        weights *= target[code] > 0
    for _ in range(ROUNDS):
        worst = 0.0
        for code, target in zip(codes, targets):
            now = np.bincount(code, weights * cells, len(target))
            want = np.where(now > 0, target, 0)
            if not want.sum():
                return weights * 0
            want = want / want.sum() * max(cells.sum(), 1)
            ratio = np.divide(want, now, out=np.zeros_like(now), where=now > 0)
            worst = max(worst, np.abs(ratio[now > 0] - 1).max())
            weights = weights * ratio[code]
        if worst < TOLERANCE:
            break
    return weights


def calibrate(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """min(1, scale * weight) with the scale at which the expected tokens meet ``budget`` of the total."""
    goal = min(budget * tokens.sum(), tokens[weights > 0].sum())
    low, high = 0.0, 1.0
    while (tokens * np.minimum(1, high * weights)).sum() < goal * (1 - BUDGET_TOLERANCE) and high < 1e18:
        high *= 2
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * np.minimum(1, mid * weights)).sum() < goal else (low, mid)
    return np.minimum(1, high * weights)


def _rake_small(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], budget: float) -> DataFrame:
    rows = sorted(cells.collect())
    tokens = np.array([r.tokens for r in rows], dtype=float)
    codes, wanted = [], []
    for d in DIMENSIONS:
        names = sorted({r[d] for r in rows})
        place = {n: i for i, n in enumerate(names)}
        codes.append(np.array([place[r[d]] for r in rows], dtype=int))
        own = targets.get(d)
        if own is None:
            own = tempered({n: float(tokens[codes[-1] == i].sum()) for n, i in place.items()})
        wanted.append(np.array([float(own.get(n, 0.0)) for n in names]))
    weights = rake(tokens, codes, wanted) if rows else tokens
    chance = calibrate(tokens, weights, budget) if rows else tokens
    made = [(*(r[d] for d in DIMENSIONS), float(w), float(p)) for r, w, p in zip(rows, weights, chance)]
    return cells.sparkSession.createDataFrame(made, "source string, lang string, topic string, weight double, probability double")


def _rake_large(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], budget: float) -> DataFrame:
    """The same by joins on the cell table, for more cells than a driver should hold; each round is checkpointed."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    rated = cells.withColumn("weight", (F.col("tokens") > 0).cast("double"))
    goals = {}
    for d in DIMENSIONS:
        if d in targets:
            own = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, goal double")
        else:
            own = cells.groupBy(d).agg(F.pow(F.sum("tokens"), F.lit(TEMPER)).alias("goal"))
        goals[d] = own.filter("goal > 0")
        rated = rated.join(goals[d].select(d), d, "left_semi")
    rated = cut_lineage(rated)
    for _ in range(ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            now = rated.groupBy(d).agg(F.sum(F.col("weight") * F.col("tokens")).alias("now")).join(goals[d], d)
            whole = now.filter("now > 0").agg(F.sum("goal")).first()[0] or 1.0
            ratio = now.select(d, F.when(F.col("now") > 0, F.col("goal") / whole * total / F.col("now")).otherwise(0.0).alias("ratio"), "now")
            ratio = cut_lineage(ratio)
            worst = max(worst, ratio.filter("now > 0").agg(F.max(F.abs(F.col("ratio") - 1))).first()[0] or 0.0)
            rated = rated.join(ratio.drop("now"), d).withColumn("weight", F.col("weight") * F.col("ratio")).drop("ratio")
        rated = cut_lineage(rated)
        if worst < TOLERANCE:
            break
    goal = min(budget * total, rated.filter("weight > 0").agg(F.sum("tokens")).first()[0] or 0)
    low, high = 0.0, 1.0
    expected = lambda s: rated.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), s * F.col("weight")))).first()[0] or 0.0
    while expected(high) < goal * (1 - BUDGET_TOLERANCE) and high < 1e18:
        high *= 2
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        if mid in (low, high):  # neighbouring numbers: no halving changes anything any more
            break
        low, high = (mid, high) if expected(mid) < goal else (low, mid)
    scaled = rated.withColumn("probability", F.least(F.lit(1.0), high * F.col("weight")))
    lost = cells.join(scaled.select(*DIMENSIONS), list(DIMENSIONS), "left_anti")
    zero = lost.withColumns({"weight": F.lit(0.0), "probability": F.lit(0.0)})
    return scaled.unionByName(zero).drop("tokens")


def mix_to_targets(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    budget: float = BUDGET,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
    driver_cells: int = 200_000,
) -> DataFrame:
    """``docs`` with a struct column ``mix``: topic, n_tokens, weight, probability, sampled.

    ``targets`` gives shares per category of source, lang and topic; a dimension left out gets its
    tempered natural shares, a category left out of a given one is not sampled. Null source or lang
    is a category of its own (""). A text without tokens takes its cell's values. The draw is keyed
    by seed and id, so repeated rows share it. An input column ``mix`` is replaced.
    """
    targets = dict(targets or {})
    text = text_or_empty(text_col)
    keyed = docs.drop("mix").withColumns({
        "__source": text_or_empty("source"), "__lang": text_or_empty("lang"),
        "__topic": topic if topic is not None else genre(text), "__tokens": token_count(text),
    })
    cells = keyed.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"))
    cells = written_table(cells.agg(F.sum("__tokens").alias("tokens")), "cells")
    solve = _rake_small if holds_at_most(cells, driver_cells) else _rake_large
    solved = solve(cells, targets, budget).withColumnsRenamed({c: f"__c_{c}" for c in (*DIMENSIONS, "weight", "probability")})
    cond = (F.col("__source") == F.col("__c_source")) & (F.col("__lang") == F.col("__c_lang")) & (F.col("__topic") == F.col("__c_topic"))
    joined = keyed.join(small_or_shuffled(solved, driver_cells), cond, "left")
    drawn = uniform_draw(seed, F.coalesce(F.col(id_col).cast("string"), F.lit(""))) < F.col("__c_probability")
    solved_columns = [F.col(f"__c_{c}").alias(c) for c in ("weight", "probability")]
    mix = F.struct(F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), *solved_columns, drawn.alias("sampled"))
    return joined.select(*[F.col(c) for c in docs.columns if c != "mix"], mix.alias("mix"))


@query("op1_mix_weights")
def op1_mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_to_targets(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "mix.*")

"""Evaluation: choice scoring, accuracy reports, entropy, uncertainty sets, watermark, routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as AR
from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.hashing import md5_int
from ..session import written_table
from .ordering import only_wanted
from .vectors import route_top_k


# ---- scoring -------------------------------------------------------------------------------------

def ngram_counts(docs: DataFrame, words: str = "w", steps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(x, y, nxy) and (x, nx) tables of adjacent words inside each text.

    With ``steps`` (x, y) only the pairs and words that it asks for are counted: the others go before
    the aggregation, so no pair table of the whole corpus is built.
    """
    n = F.size(words)
    nexts = F.slice(words, F.lit(2), n)
    zipped = F.arrays_zip(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("x"), nexts.alias("y"))
    pairs = docs.filter(n > 1).select(F.inline(zipped))
    singles = docs.select(F.explode(words).alias("x"))
    if steps is not None:
        asked = written_table(steps.select("x", "y").distinct(), "asked-pairs")
        both = asked.select(F.explode(F.array("x", "y")).alias("x")).distinct()
        pairs, singles = only_wanted(pairs, asked), only_wanted(singles, written_table(both, "asked-words"))
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("nxy")), singles.groupBy("x").agg(F.count(F.lit(1)).alias("nx"))


def word_steps(df: DataFrame, keys: Sequence[str], context: str, target: str) -> DataFrame:
    """(keys, pos, x, y): each target word with the word before it; the first follows the context."""
    before = F.concat(F.slice(context, -1, 1), F.slice(target, F.lit(1), F.greatest(F.size(target) - 1, F.lit(0))))
    empty = F.when(F.size(context) > 0, before).otherwise(
        F.concat(F.array(F.lit("")), F.slice(target, F.lit(1), F.greatest(F.size(target) - 1, F.lit(0))))
    )
    return df.filter(F.size(target) > 0).select(
        *keys, F.posexplode(F.arrays_zip(empty.alias("x"), F.col(target).alias("y"))).alias("pos", "s")
    ).select(*keys, "pos", "s.x", "s.y")


def smoothed_logprob(steps: DataFrame, pairs: DataFrame, singles: DataFrame, vocab: int = V.VOCAB_SIZE) -> DataFrame:
    """Adds ``logprob`` = ln((n(x, y) + 1) / (n(x) + vocab))."""
    joined = steps.join(pairs, ["x", "y"], "left").join(singles, "x", "left")
    hit, seen = F.coalesce("nxy", F.lit(0)), F.coalesce("nx", F.lit(0))
    return joined.withColumn("logprob", F.log((hit + 1) / (seen + vocab)))


def choice_scores(choices: DataFrame, token_logprobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length-normalised log-likelihood per choice; a choice without tokens scores -inf."""
    means = token_logprobs.groupBy(*keys).agg(F.avg("logprob").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    out = choices.join(means, list(keys), "left")
    return out.withColumns(
        {"score": F.coalesce("_mean", F.lit(float("-inf"))), "n_tokens": F.coalesce("_n", F.lit(0))}
    ).drop("_mean", "_n")


def predict(scored: DataFrame, item: Sequence[str], choice: str = "choice_idx") -> DataFrame:
    """First argmax per item: the highest score, the smallest index on ties."""
    best = F.max_by(choice, F.struct("score", (-F.col(choice)).alias("neg")))
    return scored.groupBy(*item).agg(best.alias("predicted"))


def truth_index(answer: Column, answer_base: int = 0) -> Column:
    """0-based index of an integer answer (in ``answer_base`` counting) or of a letter."""
    text = answer.cast("string")
    letter = F.ascii(F.upper(F.trim(text))) - F.lit(ord("A"))
    return F.coalesce(text.try_cast("int") - answer_base, letter)


def adapt_generated_items(items: DataFrame) -> DataFrame:
    """Generated items (prompt, options, answer text) to the scored form (question, choices, answer)."""
    return items.select(
        "id", F.col("prompt").alias("question"), F.col("options").alias("choices"),
        (F.array_position("options", F.col("answer")) - 1).cast("int").alias("answer"), "category",
    )


def with_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Optional columns: added when absent, filled when null."""
    present = {name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items() if name in df.columns}
    absent = {name: F.lit(value) for name, value in defaults.items() if name not in df.columns}
    return df.withColumns({**present, **absent})


def _pct(value: Column) -> Column:
    return F.format_string("%.2f%%", value)


def accuracy_overall(results: DataFrame) -> DataFrame:
    total, correct = F.count(F.lit(1)), F.count_if("is_correct")
    return results.groupBy("model").agg(
        total.alias("total"), correct.alias("correct"), _pct(correct / total * 100.0).alias("accuracy")
    )


def accuracy_pivot(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Subcategory rows, one accuracy column per model; the model list is given, not discovered."""
    share = F.avg(F.col("is_correct").cast("double")) * 100.0
    table = results.groupBy("subcategory").pivot("model", list(models)).agg(share)
    return table.select("subcategory", *[F.when(F.col(m).isNotNull(), _pct(F.col(m))).alias(m) for m in models])


def accuracy_extremes(results: DataFrame, overall: str = V.OVERALL_NAME, names: Mapping[str, str] | None = None) -> DataFrame:
    """Accuracy per model and category plus overall rows, extremes per category, winner flag, order."""
    label = F.col("category")
    if names:
        lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        label = F.coalesce(F.get(F.array(lookup[label]), F.lit(0)), label)
    named = results.withColumn("category", label)
    acc = (F.count_if("is_correct") / F.count(F.lit(1)) * 100.0).alias("acc")
    both = named.groupingSets([["model"], ["model", "category"]], "model", "category").agg(acc, F.grouping("category").alias("g"))
    rows = both.select("model", F.when(F.col("g") == 1, F.lit(overall)).otherwise(F.col("category")).alias("category"), "acc")
    per = rows.groupBy("category").agg(F.min("acc").alias("min_acc"), F.max("acc").alias("max_acc"), F.avg("acc").alias("mean_acc"))
    order = F.row_number().over(Window.orderBy((F.col("category") == overall).cast("int"), "mean_acc", "category"))
    return rows.join(per.withColumn("position", order), "category").withColumn("is_max", F.col("acc") == F.col("max_acc"))


def best_of_n(scored: DataFrame, prompt: Sequence[str], candidate: str, floor: float = V.REJECT_BELOW) -> DataFrame:
    """Best candidate per prompt by mean log-likelihood, rejected when even that is too low."""
    top = F.max_by(F.struct(F.col(candidate), F.col("score")), F.struct("score", (-F.col(candidate)).alias("neg")))
    return scored.groupBy(*prompt).agg(F.count(F.lit(1)).alias("n_candidates"), top.alias("_top")).select(
        *prompt, "n_candidates", F.col(f"_top.{candidate}").alias("best"), F.col("_top.score").alias("score"),
        F.when(F.col("_top.score") < floor, "rejected").otherwise("accepted").alias("verdict"),
    )


def top1_by_layer(logits: DataFrame, layers: Sequence[int]) -> DataFrame:
    """Position rows, one column per layer with the token of the highest logit."""
    top = F.max_by("token", F.struct("logit", (-F.col("token")).alias("neg")))
    table = logits.groupBy("pos").pivot("layer", list(layers)).agg(top)
    return table.select("pos", *[F.col(str(n)).alias(f"layer_{n}") for n in layers])


# ---- uncertainty ------------------------------------------------------------------------------------

def semantic_entropy(answers: DataFrame, prompt: str, response: str, bands=V.ENTROPY_BANDS) -> DataFrame:
    """Entropy over answer clusters; equal keys form a cluster because the test is an equivalence."""
    clusters = answers.groupBy(F.col(prompt), T.equality_key(F.col(response)).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    # -sum(n/N ln n/N) = ln N - sum(n ln n)/N, so one aggregation is enough
    total = F.sum("n")
    entropy = F.log(total) - F.sum(F.col("n") * F.log("n")) / total
    out = clusters.groupBy(prompt).agg(F.count(F.lit(1)).alias("n_clusters"), total.alias("n_samples"), F.abs(entropy).alias("entropy"))
    band = F.when(F.col("entropy") < bands[0], "confident").when(F.col("entropy") < bands[1], "hesitant").otherwise("guessing")
    return out.withColumn("band", band)


def top_p_set_size(df: DataFrame, probs: str, alpha: float = 0.1) -> DataFrame:
    """Smallest number of most likely tokens whose mass exceeds 1 - alpha, and its vocabulary share."""
    ordered = F.sort_array(probs, asc=False)
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("size"))
    walk = F.aggregate(
        ordered, start,
        lambda acc, p: F.when(acc["mass"] > 1 - alpha, acc).otherwise(
            F.struct((acc["mass"] + p).alias("mass"), (acc["size"] + 1).alias("size"))
        ),
    )
    sized = df.withColumn("set_size", walk["size"])
    return sized.withColumn("set_pct", F.col("set_size") * 100.0 / F.size(probs))


def set_risk(pct: Column) -> Column:
    return F.when(pct <= 1, "safe").when(pct <= 3, "warn").otherwise("high")


def risk_bands(df: DataFrame, value: str, band: str) -> DataFrame:
    """Rows per risk band with minimum, median and maximum of the value.

    The median keeps a counter per distinct value; a share of a set has as many as the set has sizes.
    """
    return df.groupBy(F.col(band).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.percentile(value, F.lit(0.5)).alias("mid"), F.max(value).alias("high")
    )


def _upper_tail(z: pa.Array) -> pa.Array:
    values = z.to_numpy(zero_copy_only=False)
    return pa.array([0.5 * erfc(v / sqrt(2.0)) if np.isfinite(v) else None for v in values], pa.float64())


def upper_tail(z: Column) -> Column:
    """1 - normal CDF; Spark has no error function."""
    return F.arrow_udf(_upper_tail, "double")(z)


def watermark_z(hits: Column, n: Column, gamma: float = V.WATERMARK_GAMMA) -> Column:
    expected = n * gamma
    return F.try_divide(hits - expected, F.sqrt(n * gamma * (1 - gamma)))


def green_hits(
    tokens: Column, prompt_len: Column, k: int = 1, key: int = V.WATERMARK_KEY, gamma: float = V.WATERMARK_GAMMA,
    modulus: int = 1000,
) -> Column:
    """Generated tokens inside the green list of their k-token context.

    Membership is a keyed hash of (context, token), so no list is materialised; only tokens after
    the prompt count, while prompt tokens serve as context.
    """
    first = F.greatest(prompt_len, F.lit(k)) + 1
    n = F.greatest(F.size(tokens) - first + 1, F.lit(0))
    context = F.slice(tokens, first - k, n)
    for back in range(k - 1, 0, -1):
        context = F.zip_with(context, F.slice(tokens, first - back, n), lambda a, b: F.concat_ws(",", a, b))
    target = F.slice(tokens, first, n)
    draw = F.zip_with(context, target, lambda c, w: (md5_int(F.concat_ws(":", F.lit(str(key)), c, w)) % modulus < int(modulus * gamma)).cast("int"))
    return F.aggregate(draw, F.lit(0), lambda s, x: s + x)


def watermark_test(df: DataFrame, tokens: str, prompt_len: Column, z_threshold: float = V.WATERMARK_Z, k: int = 1, **rule) -> DataFrame:
    n = F.greatest(F.size(tokens) - F.greatest(prompt_len, F.lit(k)), F.lit(0))
    counted = df.withColumns({"n_gen": n, "hits": green_hits(F.col(tokens), prompt_len, k, **rule)}).filter("n_gen > 0")
    z = watermark_z(F.col("hits"), F.col("n_gen"), rule.get("gamma", V.WATERMARK_GAMMA))
    return counted.withColumn("z", z).withColumns({"p_value": upper_tail(F.col("z")), "is_marked": F.col("z") >= z_threshold})


# ---- expert routing -----------------------------------------------------------------------------------

def route(df: DataFrame, key: str, vec: str, layers: int, experts: int, k: int) -> DataFrame:
    """(token_pos, layer, slot, expert, weight) from one score vector per token and layer."""
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(layers - 1)), lambda l: F.slice(vec, l * experts + 1, F.lit(experts)).cast("array<double>")
    )
    laid = df.select(F.col(key).alias("token_pos"), F.posexplode(scores).alias("layer", "s"))
    kept = laid.select("token_pos", "layer", F.posexplode(route_top_k(F.col("s"), k)).alias("slot", "r"))
    return kept.select("token_pos", "layer", "slot", "r.expert", "r.weight")


def routing_load(routed: DataFrame, layers: int, experts: int) -> DataFrame:
    """Tokens per (layer, expert) on the full grid, absent cells as 0."""
    counts = routed.groupBy("layer", "expert").agg(F.count(F.lit(1)).alias("n"))
    grid = routed.sparkSession.range(layers * experts).select(
        F.floor(F.col("id") / experts).cast("int").alias("layer"), (F.col("id") % experts).cast("int").alias("expert")
    )
    return grid.join(counts, ["layer", "expert"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def routing_health(load: DataFrame, experts: int) -> DataFrame:
    """Share per expert, deviation from the even share, low flag and layer status."""
    layer = Window.partitionBy("layer")
    ideal = round(100.0 / experts, 1)
    pct = F.round(F.col("n") * 100.0 / F.sum("n").over(layer), 1)
    shared = load.withColumn("pct", pct).withColumn("max_dev", F.round(F.max(F.abs(F.col("pct") - ideal)).over(layer), 1))
    status = F.when(F.col("max_dev") > 30, "COLLAPSE").when(F.col("max_dev") > 15, "SKEWED").otherwise("OK")
    return shared.withColumns({"is_low": F.col("pct") < ideal * 0.5, "status": status})


def balance_penalty(df: DataFrame, key: str, vec: str, layers: int, experts: int, k: int, coef: float = 0.01) -> DataFrame:
    """coef * E * sum(f_i * P_i) per layer: f from kept slots, P from mean router probability."""
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(layers - 1)), lambda l: F.slice(vec, l * experts + 1, F.lit(experts)).cast("array<double>")
    )
    laid = df.select(F.posexplode(scores).alias("layer", "s")).select("layer", AR.softmax(F.col("s")).alias("p"))
    probs = laid.select("layer", F.posexplode("p").alias("expert", "p")).groupBy("layer", "expert").agg(
        F.avg("p").alias("mean_p"), F.count(F.lit(1)).alias("n_tokens")
    )
    load = routing_load(route(df, key, vec, layers, experts, k), layers, experts)
    joined = load.join(probs, ["layer", "expert"])
    return joined.groupBy("layer").agg((F.sum(F.col("n") / F.col("n_tokens") * F.col("mean_p")) * coef * experts).alias("penalty"))


def expert_top_tokens(routed: DataFrame, token: str, top: int = 15) -> DataFrame:
    """The ``top`` most frequent tokens of each expert and layer, ties by token."""
    counts = routed.groupBy("layer", "expert", token).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("layer", "expert").orderBy(F.desc("n"), token))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)

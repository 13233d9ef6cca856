"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from labelled texts: words and word beginnings that toxic texts use far more
often. Each text is turned into lexicon densities, their proximity to the second person, capitals,
punctuation and obfuscation rates. Trees are boosted on a bounded sample of labelled rows, and
pool-adjacent-violators on rows set aside turns the margin into a probability. Learning reads
labelled rows outside the held-out fold only; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches, written_table
from .base import query, table, text_or_empty

#: The classifier learns from at most about so many labelled rows, chosen by a hash of the id.
MAX_LABELLED = 20_000
FOLDS = 5
#: Word beginnings of these lengths are lexicon terms beside whole words.
STEMS = (4, 5, 6)
MIN_LOG_ODDS, MIN_TEXTS, MIN_SHARE, MAX_TERMS = 2.5, 3, 0.004, 3000

#: A plain list to start from, before anything is learned.
SEED_WORDS = frozenset(
    "idiot moron stupid scum trash loser clown pathetic disgusting worthless dumb fool jerk garbage bastard bitch fuck "
    "shit dummkopf arschloch scheisse abschaum trottel connard imbécile salaud ordure idiota estúpido imbécil basura".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine euch ihr tu toi te ton vous votre usted ustedes ti tú vosotros".split()
)
REACH = 5
#: Words whose weight a worker remembers, and texts that it turns into features at once.
KNOWN_WORDS, TEXTS = 200_000, 256
WORD = re.compile(r"[^\W_]+")
SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
MASKED = re.compile(r"[^\W\d_]+(?:[0134578@$!*.+-]+[^\W\d_]+)+")
LEET = str.maketrans("0134578@$!", "oieastbasi", "*.+-")
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
FEATURES = (
    "term_count", "term_density", "distinct_terms", "top_term", "term_weight", "seed_density", "near_second_person",
    "second_person", "capitals", "shouted", "exclaimed", "punctuation", "masked", "masked_terms", "length",
)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def text_terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


class _Weights(dict):
    """Weight of a word: its heaviest lexicon term; each word is looked up once."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> float:
        weight = max((self.terms.get(t, 0.0) for t in text_terms(word)), default=0.0)
        if len(self) >= KNOWN_WORDS:  # keeps a worker's memory bounded; only speeds up
            self.clear()
        self[word] = weight
        return weight


def features(text: str, weights: _Weights) -> list[float]:
    """The dense features of one text, in the order of ``FEATURES``; an empty text has zeros."""
    words = WORD.findall(text.lower())
    n, size = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    hits = {w: weights[w] for w in counts if weights[w] > 0}
    seeds = sum(c for w, c in counts.items() if w in SEED_WORDS)
    count = sum(counts[w] for w in hits)
    near, address = 0, sum(counts[w] for w in SECOND_PERSON if w in counts)
    if (hits or seeds) and address:
        spots = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        where = np.array([i for i, w in enumerate(words) if w in hits or w in SEED_WORDS])
        at = np.searchsorted(spots, where)
        spots = np.array([-REACH - 1, *spots, len(words) + REACH])
        near = int((np.minimum(where - spots[at], spots[at + 1] - where) <= REACH).sum())
    masked = [m for m in MASKED.findall(text) if not m.isalpha()]
    shown = sum(1 for m in masked if (w := m.lower().translate(LEET)) in SEED_WORDS or weights[w] > 0)
    letters = max(sum(c.isalpha() for c in text) if not text.isascii() else len(re.sub(r"[^A-Za-z]+", "", text)), 1)
    return [
        np.log1p(count), count / n, len(hits), max(hits.values(), default=0.0), sum(counts[w] * v for w, v in hits.items()) / n,
        seeds / n, near / max(count + seeds, 1), address / n, len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text)) / letters,
        len(SHOUT.findall(text)) / n, (text.count("!") + text.count("?")) / size, len(PUNCTUATION.findall(text)) / size,
        len(masked) / n, shown, np.log1p(len(words)),
    ]


# ---------------------------------------------------------------- boosted trees


@dataclass
class Trees:
    """Boosted trees of fixed depth: per tree, feature and threshold of each inner node, value of each leaf."""

    base: float
    depth: int
    split: list[np.ndarray] = field(default_factory=list)
    at: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for split, at, leaf in zip(self.split, self.at, self.leaf):
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, split[node]] > at[node])
            total += leaf[node - len(split)]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0) -> Trees:
    """Logistic boosting on quantile bins; every level splits each node at its best gain, or not at all."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))), depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin, inner = np.full(len(x), model.base), 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        split, at, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(x), int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain, choice = np.full(width, 1e-6), [None] * width
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key, cells = (node - first) * (len(e) + 1) + coded[:, j], width * (len(e) + 1)
                gs = np.bincount(key, g, cells).reshape(width, -1)
                hs = np.bincount(key, h, cells).reshape(width, -1)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                won = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                best = won.argmax(1)
                for k in np.nonzero(won[np.arange(width), best] > gain)[0]:
                    gain[k], choice[k] = won[k, best[k]], (j, e[best[k]])
            for k, c in enumerate(choice):
                if c is not None:
                    split[first + k], at[first + k] = c
            node = 2 * node + 1 + (x[np.arange(len(x)), split[node]] > at[node])
        spot = node - inner
        leaf = -rate * np.bincount(spot, g, inner + 1) / (np.bincount(spot, h, inner + 1) + ridge)
        margin += leaf[spot]
        model.split.append(split), model.at.append(at), model.leaf.append(leaf)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a non-decreasing map from margin to probability, by pool-adjacent-violators.

    A pseudo-count of one half of each label anchors the ends, so that no score is exactly 0 or 1.
    """
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of labels, sum of margins
    for m, v in zip(margin[order], y[order]):
        blocks.append([1.0, float(v), float(m)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            w, s, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + t]
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    knots = np.array([t / w for w, _, t in blocks])
    return knots, np.maximum.accumulate(np.array([(s + 0.5 / len(y)) / (w + 1 / len(y)) for w, s, _ in blocks]))


# ---------------------------------------------------------------- learning and scoring


@dataclass
class Model:
    terms: dict[str, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def score(self, texts: list[str], weights: _Weights | None = None) -> np.ndarray:
        weights = _Weights(self.terms) if weights is None else weights
        if self.trees is None or not texts:
            return np.full(len(texts), float(self.values[0]))
        x = np.array([features(t, weights) for t in texts])
        return np.interp(self.trees.margin(x), self.knots, self.values)


def _texts(batch: pa.Array) -> Iterator[list[str]]:
    for i in range(0, len(batch), TEXTS):
        yield batch.slice(i, TEXTS).to_pylist()


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            for term in {t for w in set(WORD.findall(text.lower())) for t in text_terms(w)}:
                seen[term][toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))],
            ["term", "clean", "toxic"],
        )


def _learn_terms(sample: DataFrame) -> dict[str, float]:
    """Lexicon terms with their log odds; the weightiest ``MAX_TERMS`` are model parameters."""
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    counts = sample.select("text", "toxic").mapInArrow(_term_counts, "term string, clean long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    found = counts.filter(F.col("toxic") >= max(MIN_TEXTS, MIN_SHARE * toxic)).withColumn("odds", odds)
    top = found.filter(F.col("odds") >= MIN_LOG_ODDS).orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "term").limit(MAX_TERMS)
    return {r.term: r.odds for r in top.collect()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Model from labelled rows outside the held-out fold, about ``max_labelled`` of them at most.

    Null labels don't count. Without labelled rows of both classes every text scores the share of
    toxic rows (0 when nothing is labelled).
    """
    known = labels.select(F.col(id_col).alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & F.col("l_id").isNotNull() & ~held_out(F.col("l_id"))).groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64("l_id", F.lit("labelled")), F.lit(1_000_000))
    chosen = known.filter(draw < int(1_000_000 * min(1.0, max_labelled / max(n, 1))))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    sample = rows.join(F.broadcast(chosen), F.col("id") == F.col("l_id"))  # at most about max_labelled rows
    part = F.pmod(F.xxhash64("text", F.lit("part")), F.lit(5))  # copies of a text stay in one part
    sample = sample.select("text", "toxic", (part == 0).alias("aside")).groupBy("text", "aside").agg(F.max("toxic").alias("toxic"))
    with bounded_batches(docs.sparkSession):
        sample = written_table(sample, "labelled")
        terms = _learn_terms(sample.filter(~F.col("aside")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(terms)
        for batch in batches:
            x = [features(t, weights) for texts in _texts(batch["text"]) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch["toxic"], batch["aside"]], ["x", "toxic", "aside"])

    with bounded_batches(docs.sparkSession):
        got = sorted(sample.mapInArrow(measure, "x array<double>, toxic int, aside boolean").collect())
    x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    y, aside = np.array([r.toxic for r in got], float), np.array([r.aside for r in got], bool)
    if len(np.unique(y[~aside])) < 2 or not aside.any():
        return Model(terms, None, np.array([0.0]), np.array([y.mean() if len(y) else 0.0]))
    trees = boost(x[~aside], y[~aside])
    return Model(terms, trees, *isotonic(trees.margin(x[aside]), y[aside]))


def toxicity_score(model: Model, text_col: str = "text") -> Column:
    """Column of scores from 0 to 1; null text counts as empty."""

    return F.arrow_udf(toxicity_scorer(model), "double")(text_or_empty(text_col))


def toxicity_scorer(model: Model) -> Callable[[pa.Array], pa.Array]:
    """Scores of a batch; texts leave it ``TEXTS`` at a time, and word weights last from batch to batch."""
    weights = _Weights(model.terms)

    def run(batch: pa.Array) -> pa.Array:
        return pa.array([v for texts in _texts(batch) for v in model.score(texts, weights)], pa.float64())

    return run


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

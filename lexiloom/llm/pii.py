"""Personal data by weak supervision.

Patterns propose candidate spans; four labelers (the pattern's own check, a gazetteer, the context,
the boundary) vote yes, no or abstain. Expectation maximisation over the counts of vote patterns
estimates how reliable each labeler is and what each pattern is worth; a logistic span classifier is
trained on these soft labels. Base spans follow fixed rules and always stay; spans of further kinds
enter when the classifier accepts them. Spark counts and scores every span; the driver sees counts
of vote and feature patterns only, whose number is bounded by construction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written_table
from .base import query, table, text_or_empty


@dataclass(frozen=True)
class Kind:
    """``near`` and ``far`` are context words for and against; ``listed`` and ``unlisted`` gazetteer patterns."""

    name: str
    pattern: str
    check: str
    listed: str
    unlisted: str
    near: str
    far: str
    base: bool = False


OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Characters of the account numbers of the countries in the gazetteer; others have 15 to 34.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "PL": 28, "PT": 25, "SE": 24}
IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(
    f"{country}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for country, n in IBAN_LENGTHS.items()
) + "|[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3}))(?![A-Za-z0-9])"
#: Where the data contract's patterns would try each character of a long run again, look-behinds start
#: at the run's head; loops over single characters replace loops over groups. The matches are the same.
KINDS = (
    Kind("email",
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])+",
         "true", r"(?i)@(gmail|yahoo|outlook|hotmail|icloud|gmx|web|orange|proton|mail)|[.](com|org|net|edu|de|fr|es)$", r"(?i)^(noreply|no-reply|postmaster|webmaster)@",
         "mail|contact|write|reply|from", "version|commit", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", f"value rlike '^{OCTET}([.]{OCTET}){{3}}$'",
         r"^(?!0|10\.|127\.|192\.168\.|255)", r"^(0|10\.|127\.|192\.168\.|255)", "ip|host|server|addr|login", "version|release|build|section", True),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", "luhn_check(regexp_replace(value, '[ -]', ''))",
         r"^(4|5[1-5]|3[47]|6011|65|2[2-7])", "^(0|1|9)", "card|visa|pay|credit|account", "isbn|serial|order|sku|part", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(value, '[^0-9]', '')) BETWEEN 8 AND 15",
         r"^\+(1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"^\+0", "call|tel|phone|mobile|fax|whatsapp", "utc|gmt|score", True),
    Kind("secret", r"""(?i)(?<![A-Za-z0-9_])(?:token|secret|passwd|password|api[_-]?key)\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9+/_-]{16,}+""",
         "value rlike '[0-9]' AND value rlike '[A-Za-z]'", "(?i)^(token|secret|pass|api)", "(?i)(example|placeholder|xxxx|0000)",
         "key|auth|secret|login|config", "sample|dummy"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "NOT value rlike '^(000|666|9..)|-00-|-0000$'",
         "^(00[1-9]|0[1-9]|[1-8])", "^(123-45-6789|111-11-1111)$", "ssn|social|identity|insurance", "isbn|part|serial|order"),
    Kind("local_phone", r"(?<![0-9+().-])(?<!\+[0-9]{1,3} )(?:\([0-9]{3}\) |[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9])", "NOT value rlike '^[(]?[01]'",
         "^[(]?[2-9]", "^[(]?[01]", "call|tel|phone|mobile|fax", "isbn|part|serial|order"),
    Kind("iban", IBAN, "length(regexp_replace(value, ' ', '')) BETWEEN 15 AND 34",
         "^(AT|BE|CH|DE|ES|FI|FR|GB|IE|IT|LU|NL|PL|PT|SE)", "^(XX|ZZ)", "iban|bank|account|konto|compte", "isbn|serial"),
    Kind("spoken_email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63} ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,24}", "true",
         "(?i)(com|org|net|de|fr|es|edu)$", "(?i)^(noreply|postmaster)", "mail|contact|write", "look|meet"),
)
BASE = [k.name for k in KINDS if k.base]
VOTES = ("v_check", "v_gazetteer", "v_context", "v_boundary")
FEATURES = (*VOTES, "f_length", "f_digits")
NEAR_LEFT, NEAR_RIGHT = 40, 20


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, kind, start, end, value, left, right): leftmost non-overlapping matches of each kind.

    Positions count code points, ends are exclusive. Rows that repeat (id, text) are matched once.
    """
    text = F.col("text")
    found = F.array(*[
        F.struct(
            F.lit(k.name).alias("kind"), F.split(text, k.pattern).alias("pieces"),
            F.when(F.size(F.split(text, k.pattern)) > 1, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).alias("matches"),
        ) for k in KINDS
    ])
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # Outer forms spare the filters that would match each text again; matches are never null.
    kinds = rows.select("id", F.xxhash64("text").alias("text_key"), F.explode_outer(found).alias("k"))
    each = kinds.select("id", "text_key", "k.kind", "k.pieces", F.posexplode_outer("k.matches").alias("i", "value"))
    each = each.filter("value IS NOT NULL").select(
        "id", "text_key", "kind", "i", "value", F.char_length(F.get("pieces", F.col("i"))).alias("gap"),
        F.right(F.get("pieces", F.col("i")), F.lit(NEAR_LEFT)).alias("left"),
        F.left(F.get("pieces", F.col("i") + 1), F.lit(NEAR_RIGHT)).alias("right"),
    ).dropDuplicates(["id", "text_key", "kind", "i"])
    so_far = Window.partitionBy("id", "text_key", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.char_length("value")).over(so_far)
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("value")).drop("gap", "i")


def _by_kind(make) -> Column:
    chosen = F
    for k in KINDS:
        chosen = chosen.when(F.col("kind") == k.name, make(k))
    return chosen


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def with_votes(spans: DataFrame) -> DataFrame:
    """``spans`` with the four votes (1, -1, 0 for abstaining) and two binned features."""
    check = _by_kind(lambda k: F.expr(k.check))
    near = _by_kind(lambda k: F.col("left").rlike(f"(?i)(?<![A-Za-z])(?:{k.near})"))
    far = _by_kind(lambda k: F.col("left").rlike(f"(?i)(?<![A-Za-z])(?:{k.far})"))
    joined = F.col("left").rlike(r"[\p{L}\p{N}_=/-]$") | F.col("right").rlike(r"^[\p{L}\p{N}_=/-]")
    digits = F.length(F.regexp_replace("value", "[^0-9]", "")) / F.length("value")
    return spans.withColumns({
        "v_check": _vote(check, ~check),
        "v_gazetteer": _vote(_by_kind(lambda k: F.col("value").rlike(k.listed)), _by_kind(lambda k: F.col("value").rlike(k.unlisted))),
        "v_context": _vote(near, far),
        "v_boundary": _vote(~joined, joined),
        "f_length": F.least(F.floor(F.char_length("value") / 8), F.lit(8)).cast("int"),
        "f_digits": F.round(digits * 4).cast("int"),
    })


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of every vote pattern, labeler reliabilities (P(vote | class), 3 x 2 each) and prior.

    Labelers start out right four times of five; abstaining is a vote of its own, and half a count
    of each outcome keeps estimates off 0 and 1.
    """
    n = votes.shape[1]
    table_ = np.tile(np.array([[0.6, 0.15], [0.25, 0.25], [0.15, 0.6]])[None], (n, 1, 1))  # rows: no, abstain, yes
    prior, post = 0.5, np.full(len(votes), 0.5)
    for _ in range(rounds if len(votes) else 0):
        log = np.log(np.array([1 - prior, prior]))[None] + sum(np.log(table_[j][votes[:, j] + 1]) for j in range(n))
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        weight = np.stack([counts * (1 - post), counts * post], 1)
        prior = (weight[:, 1].sum() + 1) / (counts.sum() + 2)
        for j in range(n):
            seen = np.stack([weight[votes[:, j] == v].sum(0) for v in (-1, 0, 1)]) + 0.5
            table_[j] = seen / seen.sum(0)
    return post, table_, float(prior)


def logistic(features: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression on soft targets, by Newton steps."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - target)) + ridge * w
        hessian = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, kind, start, end, value, base, probability) of every accepted span.

    A base kind's span is accepted when it passes its check, whatever the votes; a further kind's
    when the classifier gives it at least one half. Null text counts as empty and has no spans.
    """
    # Both the votes' counts and the answer read the spans, so the texts are matched once and the spans written.
    voted = written_table(with_votes(candidates(docs, id_col, text_col)).drop("left", "right"), "pii-spans")
    seen = sorted(voted.groupBy(*FEATURES).count().collect())
    x = np.array([[r[f] for f in FEATURES] for r in seen], dtype=int).reshape(len(seen), len(FEATURES))
    counts = np.array([r["count"] for r in seen], dtype=float)
    target, _, _ = expectation_maximisation(x[:, : len(VOTES)], counts)
    weights = logistic(x.astype(float), target, counts)
    score = F.lit(float(weights[0]))
    for name, weight in zip(FEATURES, weights[1:]):
        score = score + F.col(name) * F.lit(float(weight))
    spans = voted.withColumns({"base": F.col("kind").isin(BASE), "probability": 1 / (1 + F.exp(-score))})
    accepted = F.when(F.col("base"), F.col("v_check") == 1).otherwise(F.col("probability") >= 0.5)
    return spans.filter(accepted).select("id", "text_key", "kind", "start", "end", "value", "base", "probability")


def span_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, a count per base kind, base_sha256, spans.

    Rows that repeat an id with its text get the same answer; an empty text has no spans and the
    digest of the empty string.
    """
    spans = find_pii(docs, id_col, text_col)
    order = F.array_position(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind"))
    shown = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    listed = lambda kept: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct(order.alias("o"), "start", shown.alias("shown"))))), lambda s: s["shown"]), ",")  # noqa: E731, E501
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE]
    found = spans.groupBy(F.col("id").alias("f_id"), F.col("text_key").alias("f_key")).agg(
        *counts, listed(F.col("base")).alias("base_spans"), listed(F.lit(True)).alias("spans")
    )
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_key"))
    both = rows.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    return both.select(
        "id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

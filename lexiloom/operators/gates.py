"""Quality gates: each keeps every input row and adds verdict columns, so that
``kept + dropped = read`` and one scan feeds both the clean and the audit sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from .ordering import exact_quantiles


def bad_text(
    text: Column,
    min_chars: int = V.GATE_MIN_CHARS,
    min_purity: float = V.GATE_MIN_PURITY,
    script: str = V.HAN,
    letters: str = V.LETTERS,
) -> Column:
    """Too short or not enough of the wanted script; null text is bad."""
    failed = (F.length(text) < min_chars) | (T.purity(text, script, letters) < min_purity)
    return F.coalesce(failed, F.lit(True))


def quality_gate(df: DataFrame, text: str = "text", **rules) -> DataFrame:
    """Adds ``drop_reason`` (null = kept) from the first gate."""
    bad = bad_text(F.col(text), **rules)
    return df.withColumn("drop_reason", F.when(bad, F.lit(V.GATE_INIT_REASON)))


def two_stage_gate(df: DataFrame, text: str = "text", cleaner=T.clean_basic, **rules) -> DataFrame:
    """Gate, clean, gate again.

    Rows that fail the first gate keep their raw text, later rows carry the cleaned text.
    """
    first = quality_gate(df, text, **rules)
    passed = F.col("drop_reason").isNull()
    cleaned = first.withColumn(text, F.when(passed, cleaner(F.col(text))).otherwise(F.col(text)))
    second = F.when(bad_text(F.col(text), **rules), F.lit(V.GATE_POST_REASON))
    return cleaned.withColumn("drop_reason", F.coalesce(F.col("drop_reason"), second))


def length_band(
    df: DataFrame, text: str = "text", low: int = V.WEB_MIN_CHARS, high: int = V.WEB_MAX_CHARS
) -> DataFrame:
    """Non-empty rows with low <= length < high."""
    n = F.length(text)
    return df.filter(F.col(text).isNotNull() & (n > 0) & (n >= low) & (n < high))


def drop_matching(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Keyword blocklist: rows matching any pattern go; null never matches."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    return df.filter(~hit)


def drop_matching_pairs(
    df: DataFrame, instruction_patterns: Sequence[str], output_patterns: Sequence[str],
    instruction: str = "instruction", output: str = "output",
) -> DataFrame:
    """A blocklist of its own for each side of a pair."""
    return drop_matching(drop_matching(df, instruction, instruction_patterns), output, output_patterns)


def without_url(df: DataFrame, text: str = "text", pattern: str = V.URL) -> DataFrame:
    return drop_matching(df, text, [pattern])


def script_ratio(
    df: DataFrame, text: str = "text", char_class: str = V.HAN_RANGE, at_least: float = V.WEB_MIN_RATIO
) -> DataFrame:
    return df.filter(T.kept_ratio(F.col(text), char_class) >= at_least)


def pair_ratio_gate(
    df: DataFrame,
    band: tuple[int, int, float] = V.CHAT_PAIR_BAND,
    char_class: str = V.HAN_OR_FULLWIDTH,
    instruction: str = "instruction",
    output: str = "output",
) -> DataFrame:
    """Joint length band and joint script ratio of both sides of a pair."""
    low, high, ratio = band
    total = F.length(instruction) + F.length(output)
    hits = T.char_count(F.col(instruction), char_class) + T.char_count(F.col(output), char_class)
    share = F.when(total > 0, hits / total).otherwise(F.lit(0.0))
    return df.filter(total.between(low, high) & (share >= ratio))


def rule_flags(text: Column, rules: Sequence[tuple[str, str]]) -> dict[str, Column]:
    return {name: F.coalesce(text.rlike(pattern), F.lit(False)) for name, pattern in rules}


def multi_rule_filter(
    df: DataFrame, text: str = "text", rules: Sequence[tuple[str, str]] = V.MULTI_RULES
) -> DataFrame:
    """One flag column per rule plus ``is_dirty``; rows with empty text are in neither side."""
    flags = rule_flags(F.col(text), rules)
    tagged = df.filter(F.coalesce(F.col(text), F.lit("")) != "").withColumns(
        {f"hit_{name}": hit for name, hit in flags.items()}
    )
    dirty = F.lit(False)
    for name in flags:
        dirty = dirty | F.col(f"hit_{name}")
    return tagged.withColumn("is_dirty", dirty)


def funnel_first_hit(
    df: DataFrame,
    text: str = "text",
    rules: Sequence[tuple[str, str]] = V.FUNNEL_RULES,
    min_chars: int = V.FUNNEL_MIN_CHARS,
    density: float = V.PUNCT_DENSITY_LIMIT,
) -> DataFrame:
    """``drop_reason`` names the first rule a row fails: length, patterns, punctuation density."""
    body = F.col(text)
    reason = F.when(F.coalesce(F.length(body), F.lit(0)) <= min_chars, F.lit("too_short"))
    for name, pattern in rules:
        reason = reason.when(body.rlike(pattern), F.lit(name))
    reason = reason.when(T.punct_density(body) >= density, F.lit("punct_density"))
    return df.withColumn("drop_reason", reason)


def pair_rules(
    df: DataFrame,
    min_output: int = V.PAIR_MIN_OUTPUT,
    closing: str = V.CLOSING_PUNCT,
    leftover: str = V.THINK_LEFTOVER,
    instruction: str = "instruction",
    output: str = "output",
) -> DataFrame:
    """Instruction-pair rules: non-empty, long enough, no reasoning residue, finished sentence."""
    out = F.col(output)
    return df.filter(
        (F.length(instruction) > 0)
        & (F.length(out) > min_output)
        & ~out.rlike(leftover)
        & out.rlike(closing)
    )


def entity_density(
    df: DataFrame,
    entities: str,
    words: str,
    min_words: int = V.ENTITY_MIN_WORDS,
    max_distinct: int = V.ENTITY_MAX_DISTINCT,
    max_density: float = V.ENTITY_MAX_DENSITY,
) -> DataFrame:
    """Name-list detection from two array columns that any tagger may produce.

    Dirty when there are more than ``max_distinct`` distinct entities *and* they make up more
    than ``max_density`` of all words; texts under ``min_words`` words always pass. A text
    without words is neither clean nor dirty and leaves the table.
    """
    n_words = F.size(words)
    n_distinct = F.size(F.array_distinct(F.col(entities)))
    dirty = (
        (n_words >= min_words)
        & (n_distinct > max_distinct)
        & (F.try_divide(n_distinct, n_words) > max_density)
    )
    return df.filter(n_words > 0).withColumns(
        {"n_words": n_words, "n_entities": n_distinct, "is_dirty": F.coalesce(dirty, F.lit(False))}
    )


def retention_report(df: DataFrame, by: Sequence[str] = (), reason: str = "drop_reason") -> DataFrame:
    """Read, kept, dropped and kept share per group, in one aggregation."""
    kept = F.count_if(F.col(reason).isNull())
    total = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        total.alias("n_read"),
        kept.alias("n_kept"),
        (total - kept).alias("n_dropped"),
        F.round(F.try_divide(kept * 100.0, total), 4).alias("kept_pct"),
    )


def topic_filter(df: DataFrame, topic: str = "topic", **rules) -> DataFrame:
    return df.filter(~T.topic_blocked(F.col(topic), **rules))


def concept_keep_mask(
    df: DataFrame,
    sim_diff: str = "sim_diff",
    name: str = "name",
    cutoff: float = V.CONCEPT_CUTOFF,
    whitelist: str = V.CONCEPT_WHITELIST,
    invalid: str = V.CONCEPT_INVALID,
    entity: str = V.CONCEPT_ENTITY,
    keywords: str = V.CONCEPT_KEYWORDS,
    accuracy: int | None = None,
) -> DataFrame:
    """Adds ``keep``: (not black-listed and (above the cut-off or keyword)) or white-listed.

    The cut-off is the exact quantile of the same rows, found in a few passes; with ``accuracy`` it
    is a scalar subquery over a sketch.
    """
    if accuracy is None:
        threshold = F.lit(exact_quantiles(df, sim_diff, [cutoff])[0]).cast("double")
    else:
        threshold = df.agg(F.percentile_approx(sim_diff, cutoff, accuracy).alias("edge")).scalar()
    label = F.replace(F.col(name), F.lit("_"), F.lit(" "))
    black = label.rlike(invalid) | label.rlike(entity)
    keep = (~black & ((F.col(sim_diff) > threshold) | label.rlike(keywords))) | label.rlike(whitelist)
    return df.withColumn("keep", F.coalesce(keep, F.lit(False)))

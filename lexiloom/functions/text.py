"""Column -> Column text functions, on built-in expressions inside codegen but for phrase maps."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

SPACES = " \t\r\n　 "


def remove(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def remove_all(text: Column, patterns) -> Column:
    """Apply removals in order; cleaners do not commute."""
    return reduce(remove, patterns, text)


def trim_unicode(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def strip_html(text: Column) -> Column:
    return remove_all(text, (V.HTML_TAG, V.HTML_ENTITY))


def normalize_quotes(text: Column, marks: str = V.CORNER_QUOTES, to: str = '"') -> Column:
    return F.translate(text, marks, to * len(marks))


def squeeze_newlines(text: Column, at_least: int = 1, to: int = 1) -> Column:
    return F.regexp_replace(text, "\\n{%d,}" % at_least, "\n" * to)


def collapse_whitespace(text: Column) -> Column:
    return trim_unicode(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_basic(text: Column) -> Column:
    """Markup strip, quote normalisation and newline squeeze of the first pipeline."""
    return squeeze_newlines(normalize_quotes(strip_html(text)))


def strip_wrappers(text: Column, patterns=V.WRAPPER_PATTERNS) -> Column:
    return remove_all(text, patterns)


def remove_first(text: Column, anchored: str) -> Column:
    """Single removal; the pattern is anchored at the start, so one match is all there is."""
    return remove(text, anchored)


def strip_list_marks(text: Column, section_prefix: str | None = V.SECTION_PREFIX) -> Column:
    """Leading marks, footnote marks, item numbers, section prefixes, dead placeholders, bullets."""
    out = remove_first(text, V.LEADING_MARKS)
    out = remove_all(out, (V.FOOTNOTE_MARKS, V.ITEM_NUMBERS))
    if section_prefix:
        out = remove(out, section_prefix)
    return remove(remove_all(out, V.DEAD_PLACEHOLDERS), V.BULLETS)


def strip_markdown(text: Column) -> Column:
    """Rule lines out, bold markers unwrapped."""
    return F.regexp_replace(remove(text, V.RULE_LINE), V.BOLD, "$1")


def strip_reasoning(text: Column) -> Column:
    return remove(text, V.REASONING_BLOCK)


def drop_isolated_dots(text: Column) -> Column:
    return remove_first(F.regexp_replace(text, V.ISOLATED_DOT, " "), V.LEADING_DOT)


def tidy_pretrain(text: Column) -> Column:
    """The whole pretraining clean-up chain in its fixed order."""
    out = strip_list_marks(strip_wrappers(text))
    out = F.regexp_replace(out, V.BOLD, "$1")
    out = drop_isolated_dots(out)
    out = F.regexp_replace(squeeze_newlines(out), r"(?U)\s+", " ")
    return trim_unicode(remove(out, V.ESCAPED_QUOTE))


def strip_news_tail(
    text: Column,
    timestamp: str = V.TIMESTAMP,
    tail: str = V.NEWS_TAIL,
    title_mark: str = V.SOURCE_TITLE,
) -> Column:
    out = remove_all(text, (timestamp, tail))
    out = F.btrim(squeeze_newlines(out, 3, 2), F.lit(" \t\r\n"))
    out = F.regexp_replace(out, V.STAR_BREAK, "\n")
    return F.replace(out, F.lit(title_mark), F.lit(""))


def convert_script(text: Column, source: str, target: str) -> Column:
    """Character-for-character script conversion from a user-supplied map."""
    return F.translate(text, source, target)


def convert_phrases(text: Column, phrases: Mapping[str, str]) -> Column:
    """Leftmost longest phrases replaced by their targets; what is replaced is not read again.

    The map is user-supplied and travels with the function. Characters outside of phrases stay, so a
    character map (``convert_script``) may follow.
    """
    if not phrases:
        return text
    known = dict(phrases)
    pattern = re.compile("|".join(re.escape(p) for p in sorted(known, key=len, reverse=True)))

    def convert(texts: pa.Array) -> pa.Array:
        put = lambda m: known[m[0]]
        return pa.array([None if t is None else pattern.sub(put, t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(convert, "string")(text)


def isolate_punct(text: Column, pattern: str = V.ISOLATED_PUNCT) -> Column:
    return F.regexp_replace(F.regexp_replace(text, pattern, " $1 "), r"\s+", " ")


def detokenize(text: Column) -> Column:
    out = remove_all(text, (V.SPECIAL_TAGS, V.CJK_GAP, V.GAP_BEFORE_PUNCT, V.GAP_AFTER_OPENER))
    return F.btrim(out, F.lit(" \t\r\n"))


def strip_fences(text: Column) -> Column:
    out = remove(text, r"^```json\s*")
    out = remove(out, r"^```\s*")
    return F.btrim(remove(out, r"\s*```\z"), F.lit(" \t\r\n"))


def equality_key(text: Column) -> Column:
    """Two answers are equal when they agree after dropping punctuation and white space."""
    return remove(text, r"(?U)[\p{Punct}\s]+")


def strip_lead_punct(text: Column) -> Column:
    return remove(text, V.LEAD_PUNCT)


def char_count(text: Column, char_class: str) -> Column:
    return F.regexp_count(text, F.lit(char_class))


def kept_ratio(text: Column, char_class: str) -> Column:
    """Share of characters inside ``char_class``; 0 for empty text."""
    return char_count(text, char_class) / F.greatest(F.length(text), F.lit(1))


def purity(text: Column, script: str = V.HAN, letters: str = V.LETTERS) -> Column:
    hits = char_count(text, script)
    return hits / (hits + char_count(text, letters) + F.lit(1e-5))


def punct_density(text: Column) -> Column:
    return F.try_divide(char_count(text, r"\p{P}"), F.length(text))


def words(text: Column, pattern: str = r"[\p{L}\p{N}]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def link_title(href: Column, prefix: str = V.WIKI_PREFIX) -> Column:
    """Text after ``prefix``, URL-decoded, without fragment or query."""
    tail = F.regexp_extract(href, prefix + "(.+)", 1)
    return remove(F.try_url_decode(tail), "(?s)[#?].*")


def topic_blocked(topic: Column, extra: str = V.TOPIC_BLOCK, ignore_case: bool = True) -> Column:
    """True for empty topics, namespaced topics and topics on the block pattern."""
    pattern = f"(?i)({extra})" if ignore_case else f"({extra})"
    hit = (topic == "") | topic.contains(":")
    if extra:
        hit = hit | topic.rlike(pattern)
    return F.coalesce(hit, F.lit(True))

"""License scan by diagonal voting.

All rolling word k-gram hashes of a text are joined to the positions of the same k-grams in license
templates. A hit votes for the diagonal (text position minus template position); votes are summed
per diagonal, neighbouring diagonals are merged, so that an inserted or missing word does not split
a match, and a span counts when the words verified on it cover enough of the template.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import query, small_or_shuffled, table, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a rolling gram; the shortest phrase has two words.
K = 2
#: Diagonals of one template that lie at most so far apart are merged.
SLACK = 3
#: Share of a template's grams that a span must hold.
COVERAGE = 0.75


@dataclass(frozen=True)
class Template:
    """``exact`` templates count at every place where their words stand consecutively."""

    label: str
    text: str
    exact: bool = False


# Phrases and labels of the data contract.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
# Customary notices of public licenses.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("gpl", "this work is licensed under the gnu general public license version"),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by", "licensed under a creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa"),
    Template("cc0", "released under cc0"),
)


def pieces_of(text: Column) -> Column:
    """Words in order; an empty piece leads if the text begins, or trails if it ends, with other characters."""
    return F.split(F.lower(text), NOT_WORD)


def count_words(pieces: Column) -> Column:
    led = (F.get(pieces, F.lit(0)) == "").cast("int")
    trailed = ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return F.size(pieces) - led - trailed


def _index(spark: SparkSession, templates: Iterable[Template]) -> DataFrame:
    rows = [(i, t.label, t.exact, t.text) for i, t in enumerate(templates)]
    made = spark.createDataFrame(rows, "template int, label string, exact boolean, text string")
    made = made.select("template", "label", "exact", pieces_of(F.col("text")).alias("t_words"))
    grams = made.select("*", F.posexplode("t_words").alias("t_pos", "t_word"))
    grams = grams.withColumn("t_next", F.get("t_words", F.col("t_pos") + 1)).filter("t_next IS NOT NULL")
    return grams.select(
        "template", "label", "exact", (F.size("t_words") - (K - 1)).alias("t_grams"), "t_pos", "t_word", "t_next",
        F.xxhash64("t_word", "t_next").alias("gram"),
    )


def license_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Iterable[Template] = PHRASES + NOTICES
) -> DataFrame:
    """Verified spans: id, text_key, template, label, exact, first_word, last_word, coverage.

    ``first_word`` and ``last_word`` bound the span, counted in words from 0; ``coverage`` is the
    share of the template's grams on it. Equal rows of (id, text) give their spans once. Null or
    empty text has none, and other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    tokens = rows.select("id", F.xxhash64("text").alias("text_key"), pieces_of(F.col("text")).alias("words"))
    # The outer form spares a filter that would tokenise each text twice more; no text gives no piece at all.
    grams = tokens.select("id", "text_key", "words", F.posexplode_outer("words").alias("at", "word"))
    grams = grams.select(
        "id", "text_key", "word", F.get("words", F.col("at") + 1).alias("next"),
        (F.col("at") - (F.get("words", F.lit(0)) == "").cast("int")).alias("pos"),
    ).filter("word != '' AND next != ''").withColumn("gram", F.xxhash64("word", "next"))
    index = small_or_shuffled(_index(docs.sparkSession, templates), 100_000)
    hits = grams.join(index, "gram").filter("word = t_word AND next = t_next")
    votes = hits.groupBy("id", "text_key", "template", "label", "exact", "t_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("voted"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    near = Window.partitionBy("id", "text_key", "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(near) > SLACK)
    merged = votes.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(near))
    spans = merged.groupBy("id", "text_key", "template", "label", "exact", "t_grams", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("voted")))).alias("n"),
        F.min("low").alias("first_word"), (F.max("high") + (K - 1)).alias("last_word"),
    )
    spans = spans.withColumn("coverage", F.col("n") / F.col("t_grams"))
    enough = F.col("coverage") >= F.when(F.col("exact"), 1.0).otherwise(COVERAGE)
    return spans.filter(enough).select(
        "id", "text_key", "template", "label", "exact", F.col("first_word").cast("long"), F.col("last_word").cast("long"), "coverage"
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Iterable[Template] = PHRASES + NOTICES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of exact phrases, first_word and last_word are their smallest and
    largest start. ``score`` is the best coverage of any span, 0 without one. Null text counts as
    empty: no words, no labels, score 0. Repeated rows are all answered; columns other than id and
    text are ignored.
    """
    spans = license_spans(docs, id_col, text_col, templates)
    listed = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(kind, F.col("label")))), ",")
    found = spans.groupBy("id", "text_key").agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first_word"))).alias("last_word"),
        listed(F.col("exact")).alias("base_labels"),
        listed(F.lit(True)).alias("labels"),
        F.max("coverage").alias("score"),
    )
    found = found.withColumnsRenamed({"id": "f_id", "text_key": "f_key"})
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"),
        count_words(pieces_of(text)).cast("long").alias("n_words"),
    )
    both = rows.join(found, rows.id.eqNullSafe(F.col("f_id")) & (rows.text_key == F.col("f_key")), "left")
    return both.select(
        "id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    values = ", ".join(
        f"({i}, '{t.label}', {str(t.exact).lower()}, '{t.text}')" for i, t in enumerate(PHRASES + NOTICES)
    )
    return rf"""
WITH t(template, label, exact, text) AS (VALUES {values}),
ti AS (SELECT template, label, exact, len(w) - 1 AS t_grams, p - 1 AS t_pos, w[p] AS t_word, w[p + 1] AS t_next
  FROM (SELECT *, unnest(range(1, len(w))) AS p FROM (SELECT *, string_split(text, ' ') AS w FROM t))),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, p - 1 AS pos, w[p] AS word, w[p + 1] AS nxt FROM (SELECT *, unnest(range(1, len(w))) AS p FROM d)),
h AS (SELECT doc_id, template, label, exact, t_grams, t_pos, pos, pos - t_pos AS diagonal
  FROM g JOIN ti ON g.word = ti.t_word AND g.nxt = ti.t_next),
v AS (SELECT DISTINCT doc_id, template, exact, diagonal FROM h),
m AS (SELECT *, sum(CASE WHEN NOT exact AND diagonal - prev <= {SLACK} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS prev FROM v)),
s AS (SELECT h.doc_id, h.label, h.exact, min(pos) AS f, count(DISTINCT t_pos) / t_grams AS coverage
  FROM h JOIN m USING (doc_id, template, diagonal) GROUP BY h.doc_id, h.template, h.label, h.exact, t_grams, run),
k AS (SELECT * FROM s WHERE coverage >= CASE WHEN exact THEN 1.0 ELSE {COVERAGE} END),
a AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(f) FILTER (exact) AS first_word, max(f) FILTER (exact) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  max(coverage) AS score FROM k GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a USING (doc_id)"""


@query("op4_license", _sql())
def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

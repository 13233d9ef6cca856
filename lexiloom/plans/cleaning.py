"""Filters, cleaners and text statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.hashing import uniform_draw
from ..operators import gates as G
from ..operators import pairs as P
from ..operators import profile as R
from ..session import scratch_path
from ..sources.observed import write_gated
from .registry import Tables, query

ACCENTED = "[À-ÿ]"
GATE = dict(min_chars=60, min_purity=0.02, script=ACCENTED)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(to)}, 'g')"


def cnt(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(pattern)}))"


def digest(df: DataFrame, text, *keys: str) -> DataFrame:
    """Key columns plus length and md5 of the whole text."""
    return df.select(*keys, F.length(text).alias("n_out"), F.md5(text).alias("digest"))


def digest_sql(expr: str, table: str, keys: str, where: str = "true") -> str:
    return (
        f"SELECT {keys}, length(t)::INT AS n_out, md5(t) AS digest "
        f"FROM (SELECT *, {expr} AS t FROM {table} WHERE {where})"
    )


def purity_sql(e: str) -> str:
    return f"{cnt(e, ACCENTED)} / ({cnt(e, ACCENTED)} + {cnt(e, '[a-zA-Z]')} + 1e-5)"


def bad_sql(e: str) -> str:
    return f"coalesce(length({e}) < 60 OR {purity_sql(e)} < 0.02, true)"


def clean_sql(e: str) -> str:
    e = sub(sub(e, V.HTML_TAG), V.HTML_ENTITY)
    return sub(f"translate({e}, '「」', '\"\"')", "\\n+", "\n")


PAIRS_SQL = (
    "(SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS output FROM conversations u "
    "JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
    "WHERE u.role = 'user' AND a.role = 'assistant')"
)


def pairs(t: Tables) -> DataFrame:
    return P.turns_to_pairs(t.conversations)


# ---- filters ------------------------------------------------------------------------------

@query("quality_gate", f"""
SELECT doc_id, CASE WHEN {bad_sql('text')} THEN '{V.GATE_INIT_REASON}' END AS drop_reason FROM documents""")
def quality_gate(t: Tables):
    return G.quality_gate(t.wide("documents"), **GATE).select("doc_id", "drop_reason")


STAGED_SQL = f"""
SELECT doc_id, lang, source,
  CASE WHEN b1 THEN '{V.GATE_INIT_REASON}' WHEN b2 THEN '{V.GATE_POST_REASON}' END AS drop_reason,
  CASE WHEN b1 THEN text ELSE c END AS out
FROM (SELECT *, {bad_sql('text')} AS b1, {bad_sql('c')} AS b2
      FROM (SELECT *, {clean_sql('text')} AS c FROM documents))"""


def staged(t: Tables) -> DataFrame:
    return G.two_stage_gate(t.wide("documents"), **GATE)


@query("two_stage_gate", f"""
SELECT doc_id, drop_reason, length(out)::INT AS n_out, md5(out) AS digest FROM ({STAGED_SQL})""")
def two_stage_gate(t: Tables):
    return digest(staged(t), F.col("text"), "doc_id", "drop_reason")


@query("retention_report", f"""
SELECT source, lang, count(*) AS n_read, count(*) FILTER (drop_reason IS NULL) AS n_kept,
  count(*) FILTER (drop_reason IS NOT NULL) AS n_dropped,
  round(count(*) FILTER (drop_reason IS NULL) * 100.0::DOUBLE / count(*), 4) AS kept_pct
FROM ({STAGED_SQL}) GROUP BY source, lang""")
def retention_report(t: Tables):
    return G.retention_report(staged(t), by=["source", "lang"])


@query("observed_totals", f"""
SELECT count(*) AS n_read, count(*) FILTER (drop_reason IS NULL) AS n_kept, count(*) FILTER (drop_reason IS NOT NULL) AS n_dropped
FROM ({STAGED_SQL})""")
def observed_totals(t: Tables):
    """Totals of the two-stage gate, observed while its rows are written."""
    totals = write_gated(staged(t).select("doc_id", "text", "drop_reason"), scratch_path(t.spark, "gated"))
    return t.spark.createDataFrame([totals[:3]], "n_read long, n_kept long, n_dropped long")


@query("length_band", "SELECT doc_id, length(text)::INT AS n_out FROM documents WHERE length(text) >= 300 AND length(text) < 3000")
def length_band(t: Tables):
    return G.length_band(t.documents).select("doc_id", F.length("text").alias("n_out"))


MARKERS = "###|token =|[Ll]icense|%%%"


@query("keyword_block", f"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, {lit(MARKERS)})")
def keyword_block(t: Tables):
    return G.drop_matching(t.wide("documents"), "text", MARKERS.split("|")).select("doc_id")


@query("url_filter", f"""
SELECT 'documents' AS src, doc_id AS id FROM documents WHERE NOT regexp_matches(text, {lit(V.URL)})
UNION ALL SELECT 'pages', page_id FROM pages WHERE NOT regexp_matches(url || ' ' || html, {lit(V.URL)})""")
def url_filter(t: Tables):
    docs = G.without_url(t.wide("documents")).select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"))
    pages = t.wide("pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return docs.unionByName(
        G.without_url(pages).select(F.lit("pages").alias("src"), F.col("page_id").alias("id"))
    )


BASIC = "[a-zA-Z ]"


@query("pair_ratio_gate", f"""
SELECT conv_id, turn, tot::INT AS total_chars FROM (
  SELECT *, length(instruction) + length(output) AS tot,
    {cnt('instruction', BASIC)} + {cnt('output', BASIC)} AS hits FROM {PAIRS_SQL})
WHERE tot BETWEEN 75 AND 3500 AND hits / tot >= 0.9""")
def pair_ratio_gate(t: Tables):
    kept = G.pair_ratio_gate(pairs(t), band=(75, 3500, 0.9), char_class=BASIC)
    return kept.select(
        "conv_id", "turn", (F.length("instruction") + F.length("output")).alias("total_chars")
    )


@query("script_ratio", f"""
SELECT doc_id FROM documents WHERE {cnt('text', BASIC)} / greatest(length(text), 1) >= 0.9""")
def script_ratio(t: Tables):
    return G.script_ratio(t.wide("documents"), char_class=BASIC, at_least=0.9).select("doc_id")


DOC_RULES = (
    ("secret", "token = "),
    ("licence", "(?i)licen[cs]e"),
    ("junk", "###|%%%"),
    ("mail", "[a-z0-9.]+@[a-z0-9.]+"),
)


@query("multi_rule_filter", "SELECT doc_id, "
       + ", ".join(f"regexp_matches(text, {lit(p)}) AS hit_{n}" for n, p in DOC_RULES)
       + ", (" + " OR ".join(f"regexp_matches(text, {lit(p)})" for _, p in DOC_RULES)
       + ") AS is_dirty FROM documents WHERE text <> ''")
def multi_rule_filter(t: Tables):
    out = G.multi_rule_filter(t.wide("documents"), rules=DOC_RULES)
    return out.select("doc_id", *[f"hit_{n}" for n, _ in DOC_RULES], "is_dirty")


@query("charclass_block", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[êßñ]')")
def charclass_block(t: Tables):
    return G.drop_matching(t.wide("documents"), "text", ["[êßñ]"]).select("doc_id")


@query("funnel_first_hit", f"""
SELECT doc_id, CASE WHEN coalesce(length(text), 0) <= 100 THEN 'too_short' """
       + " ".join(f"WHEN regexp_matches(text, {lit(p)}) THEN '{n}'" for n, p in DOC_RULES)
       + f" WHEN {cnt('text', chr(92) + 'p{P}')} / length(text) >= 0.04 THEN 'punct_density' END AS drop_reason FROM documents")
def funnel_first_hit(t: Tables):
    out = G.funnel_first_hit(t.wide("documents"), rules=DOC_RULES, density=0.04)
    return out.select("doc_id", "drop_reason")


@query("punct_density", f"""
SELECT doc_id, round({cnt('text', chr(92) + 'p{P}')} / length(text), 6) AS density FROM documents
WHERE {cnt('text', chr(92) + 'p{P}')} / length(text) < 0.15""")
def punct_density(t: Tables):
    density = T.punct_density(F.col("text"))
    return t.wide("documents").filter(density < V.PUNCT_DENSITY_LIMIT).select(
        "doc_id", F.round(density, 6).alias("density")
    )


@query("sft_rules", rf"""
SELECT conv_id, turn FROM {PAIRS_SQL} WHERE length(instruction) > 0 AND length(output) > 30
AND NOT regexp_matches(output, '(?i)think') AND regexp_matches(output, '[.!?]\z')""")
def sft_rules(t: Tables):
    return G.pair_rules(pairs(t), closing=r"[.!?]\z").select("conv_id", "turn")


@query("entity_density", r"""
SELECT doc_id, n_words, n_entities,
  (n_words >= 5 AND n_entities > 8 AND n_entities / n_words > 0.10) AS is_dirty
FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))::INT AS n_words,
  len(list_distinct(regexp_extract_all(text, '\p{Lu}\p{L}+')))::INT AS n_entities FROM documents) WHERE n_words > 0""")
def entity_density(t: Tables):
    tagged = t.wide("documents").select(
        "doc_id",
        T.words(F.col("text")).alias("words"),
        F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+"), F.lit(0)).alias("names"),
    )
    return G.entity_density(tagged, "names", "words").select(
        "doc_id", "n_words", "n_entities", "is_dirty"
    )


# ---- cleaners -------------------------------------------------------------------------------

@query("strip_html", digest_sql(sub(sub("html", V.HTML_TAG), V.HTML_ENTITY), "pages", "page_id"))
def strip_html(t: Tables):
    return digest(t.wide("pages"), T.strip_html(F.col("html")), "page_id")


@query("normalize_quotes", digest_sql("translate(text, 'çñ', '\"\"')", "documents", "doc_id"))
def normalize_quotes(t: Tables):
    return digest(t.wide("documents"), T.normalize_quotes(F.col("text"), "çñ"), "doc_id")


TAGS_AS_LINES = sub("html", V.HTML_TAG, "\n")


@query("squeeze_newlines", f"""
SELECT 'documents' AS src, doc_id AS id, length(t)::INT AS n_out, md5(t) AS digest
FROM (SELECT doc_id, {sub('text', chr(92) + 'n+', chr(10))} AS t FROM documents)
UNION ALL SELECT 'pages', page_id, length(t)::INT, md5(t)
FROM (SELECT page_id, {sub(TAGS_AS_LINES, chr(92) + 'n{3,}', chr(10) * 2)} AS t FROM pages)""")
def squeeze_newlines(t: Tables):
    docs = t.wide("documents").select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("id"),
        T.squeeze_newlines(F.col("text")).alias("t"),
    )
    pages = t.wide("pages").select(
        F.lit("pages").alias("src"), F.col("page_id").alias("id"),
        T.squeeze_newlines(page_lines(), 3, 2).alias("t"),
    )
    return digest(docs.unionByName(pages), F.col("t"), "src", "id")


def page_lines():
    return F.regexp_replace("html", V.HTML_TAG, "\n")


@query("collapse_ws", digest_sql(f"trim({sub('text', chr(92) + 's+', ' ')})", "documents", "doc_id"))
def collapse_ws(t: Tables):
    return digest(t.wide("documents"), T.collapse_whitespace(F.col("text")), "doc_id")


LATIN_WRAPPERS = (r"^.*?(that|the) ", r"(under|with) the.*$", r"\| .*$")


@query("strip_wrappers", digest_sql(
    sub(sub(sub("text", LATIN_WRAPPERS[0]), LATIN_WRAPPERS[1]), LATIN_WRAPPERS[2]), "documents", "doc_id"))
def strip_wrappers(t: Tables):
    return digest(t.wide("documents"), T.strip_wrappers(F.col("text"), LATIN_WRAPPERS), "doc_id")


def list_marks_sql(e: str) -> str:
    e = sub(e, V.LEADING_MARKS)
    for p in (V.FOOTNOTE_MARKS, V.ITEM_NUMBERS, V.SECTION_PREFIX, *V.DEAD_PLACEHOLDERS, V.BULLETS):
        e = sub(e, p)
    return e


@query("strip_list_marks", f"""
SELECT 'documents' AS src, doc_id AS id, length(t)::INT AS n_out, md5(t) AS digest
FROM (SELECT doc_id, {list_marks_sql('text')} AS t FROM documents)
UNION ALL SELECT 'pages', page_id, length(t)::INT, md5(t)
FROM (SELECT page_id, {list_marks_sql(TAGS_AS_LINES)} AS t FROM pages)""")
def strip_list_marks(t: Tables):
    docs = t.wide("documents").select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("id"),
        T.strip_list_marks(F.col("text")).alias("t"),
    )
    pages = t.wide("pages").select(
        F.lit("pages").alias("src"), F.col("page_id").alias("id"),
        T.strip_list_marks(page_lines()).alias("t"),
    )
    return digest(docs.unionByName(pages), F.col("t"), "src", "id")


@query("strip_markdown", digest_sql(
    sub(sub(TAGS_AS_LINES, r"(?m)^\s*[-*]{3,}\s*$"), V.BOLD, r"\1"), "pages", "page_id"))
def strip_markdown(t: Tables):
    return digest(t.wide("pages"), T.strip_markdown(page_lines()), "page_id")


@query("strip_reasoning", digest_sql(
    sub("'<think>' || instruction || chr(10) || '</think>' || chr(10) || output", r"(?s)<think>.*?</think>(\\n|\n)*"),
    PAIRS_SQL, "conv_id, turn"))
def strip_reasoning(t: Tables):
    wrapped = F.concat(F.lit("<think>"), "instruction", F.lit("\n</think>\n"), "output")
    return digest(pairs(t), T.strip_reasoning(wrapped), "conv_id", "turn")


DRAW_SQL = "(('0x' || substr(md5('42:' || conv_id || ':' || turn), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("augment_ending", f"""
SELECT conv_id, turn, trim(bare || CASE WHEN {DRAW_SQL} < 0.33 THEN '？' WHEN {DRAW_SQL} < 0.66 THEN '。' ELSE '' END,
  chr(32) || chr(9) || chr(13) || chr(10)) AS instruction
FROM (SELECT conv_id, turn, {sub('instruction', V.TRAILING_PUNCT)} AS bare FROM {PAIRS_SQL})""")
def augment_ending(t: Tables):
    draw = uniform_draw(42, F.col("conv_id"), F.col("turn"))
    return pairs(t).select(
        "conv_id", "turn", P.augment_ending(F.col("instruction"), draw).alias("instruction")
    )


@query("strip_news_tail", digest_sql(
    f"""replace({sub(f"trim({sub(sub(sub('text', '[0-9]{3}-[0-9]{4}'), '(?s)(Released under.*)'), chr(92) + 'n{3,}', chr(10) * 2)}, ' ' || chr(9) || chr(13) || chr(10))", V.STAR_BREAK, chr(10))}, 'tion', '')""",
    "documents", "doc_id"))
def strip_news_tail(t: Tables):
    out = T.strip_news_tail(
        F.col("text"), timestamp="[0-9]{3}-[0-9]{4}", tail="(?s)(Released under.*)", title_mark="tion"
    )
    return digest(t.wide("documents"), out, "doc_id")


FOLD_FROM = "àâäçèéêëîïñóôöùúûüáí"
FOLD_TO = "aaaceeeeiinooouuuuai"


@query("script_convert", digest_sql(f"translate(text, '{FOLD_FROM}', '{FOLD_TO}')", "documents", "doc_id"))
def script_convert(t: Tables):
    return digest(t.wide("documents"), T.convert_script(F.col("text"), FOLD_FROM, FOLD_TO), "doc_id")


@query("isolate_punct", digest_sql(sub(sub("text", V.ISOLATED_PUNCT, r" \1 "), r"\s+", " "), "documents", "doc_id"))
def isolate_punct(t: Tables):
    return digest(t.wide("documents"), T.isolate_punct(F.col("text")), "doc_id")


GAP = r"[\s\x0B]+"
CJK = r"([\x{4e00}-\x{9fa5}\x{3000}-\x{303f}\x{ff00}-\x{ffef}])"


def detokenize_sql(e: str) -> str:
    """Without look-around: captured neighbours are put back. One that serves two gaps needs a second run."""
    e = sub(e, "<BOS>|<EOS>|<PAD>|<UNK>")
    for left, right in [(CJK, CJK), (CJK, CJK), ("([a-zA-Z0-9])", "([,.?!:;/()])"), ("([(.])", "([a-zA-Z0-9])")]:
        e = sub(e, left + GAP + right, r"\1\2")
    return f"trim({e}, ' ' || chr(9) || chr(13) || chr(10))"


@query("detokenize", digest_sql(
    detokenize_sql("'<BOS>' || " + sub(sub("text", V.ISOLATED_PUNCT, r" \1 "), r"\s+", " ") + " || '<EOS>'"), "documents", "doc_id"))
def detokenize(t: Tables):
    tagged = F.concat(F.lit("<BOS>"), T.isolate_punct(F.col("text")), F.lit("<EOS>"))
    return digest(t.wide("documents"), T.detokenize(tagged), "doc_id")


@query("parse_fenced_json", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def parse_fenced_json(t: Tables):
    fenced = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_type") == "view", F.concat(F.lit("```\n"), "props", F.lit("\n```")))
        .otherwise(F.col("props"))
    )
    body = F.from_json(T.strip_fences(fenced), "k INT")
    return t.events.select("event_id", body["k"].alias("k"))


@query("align_columns", f"SELECT conv_id, turn, instruction, md5(output) AS text FROM {PAIRS_SQL}")
def align_columns(t: Tables):
    raw = pairs(t).withColumnsRenamed({"instruction": "human", "output": "explanation"})
    out = P.align_pair_columns(raw, "human", "explanation")
    return out.select("conv_id", "turn", "instruction", F.md5("output").alias("text"))


@query("char_stats", f"""
SELECT doc_id, length(text)::INT AS char_len, {cnt('text', ACCENTED)}::INT AS script_count,
  {cnt('text', '[a-zA-Z]')}::INT AS alpha_count, round({purity_sql('text')}, 6) AS pure_ratio FROM documents""")
def char_stats(t: Tables):
    return R.char_stats(t.wide("documents"), script=ACCENTED).select(
        "doc_id", "char_len", "script_count", "alpha_count", F.round("pure_ratio", 6).alias("pure_ratio")
    )


@query("corpus_stats", f"""
SELECT count(*) AS n_docs, sum(n)::BIGINT AS total_chars, median(n)::DOUBLE AS median_chars,
  round(quantile_cont(n, 0.95), 4)::DOUBLE AS p95_chars, round(avg(p), 6) AS mean_purity
FROM (SELECT length(text) AS n, {purity_sql('text')} AS p FROM documents)""")
def corpus_stats(t: Tables):
    report = R.corpus_report(R.char_stats(t.wide("documents"), script=ACCENTED))
    return report.withColumns(
        {"mean_purity": F.round("mean_purity", 6), "p95_chars": F.round("p95_chars", 4)}
    )


@query("length_histogram", """
WITH l AS (SELECT log10(length(text)) AS v FROM documents WHERE length(text) > 0),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM l)
SELECT least(floor((v - lo) / (hi - lo) * 100)::INT + 1, 100) AS bin, count(*) AS n FROM l, b GROUP BY 1""")
def length_histogram(t: Tables):
    sized = t.documents.select(F.length("text").alias("n")).filter("n > 0")
    return R.histogram(sized, F.log10("n"), bins=100)

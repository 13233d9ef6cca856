"""Whole cleaning chains, blocklists, resumable chunks and the streams that feed them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import bpe as B
from ..operators import gates as G
from ..operators import pairs as P
from ..session import scratch_path, written_table
from ..sources import jsonl as J
from ..sources import manifest as M
from ..streaming import frames as FR
from ..streaming import ingest as ST
from .cleaning import (
    DOC_RULES, DRAW_SQL, GATE, PAIRS_SQL, STAGED_SQL, cnt, detokenize_sql, digest, digest_sql, list_marks_sql, lit, pairs, sub,
)
from .registry import Tables, query
from .sources import DAMAGED, damaged_lines
from .tokens import raw_texts, whole_texts

WHITE = "' ' || chr(9) || chr(13) || chr(10)"


# ---- chains ---------------------------------------------------------------------------------

def tidy_sql(e: str) -> str:
    for p in V.WRAPPER_PATTERNS:
        e = sub(e, p)
    e = sub(list_marks_sql(e), V.BOLD, r"\1")
    e = sub(sub(e, V.ISOLATED_DOT, " "), V.LEADING_DOT)
    e = sub(sub(e, r"\n{1,}", "\n"), r"\s+", " ")
    return f"trim({sub(e, V.ESCAPED_QUOTE)})"


CHAIN_RULES = (*V.FUNNEL_RULES, *DOC_RULES)


@query("pretrain_chain", f"""
SELECT doc_id, length(t)::INT AS n_out, md5(t) AS digest, CASE WHEN coalesce(length(t), 0) <= 100 THEN 'too_short' """
       + " ".join(f"WHEN regexp_matches(t, {lit(p)}) THEN '{n}'" for n, p in CHAIN_RULES)
       + f" WHEN {cnt('t', chr(92) + 'p{P}')} / length(t) >= 0.15 THEN 'punct_density' END AS drop_reason "
       + f"FROM (SELECT doc_id, {tidy_sql('text')} AS t FROM documents)")
def pretrain_chain(t: Tables):
    """The whole clean-up of a pretraining text, then the first rule that what is left fails."""
    tidy = t.wide("documents").select("doc_id", T.tidy_pretrain(F.col("text")).alias("text"))
    return digest(G.funnel_first_hit(tidy, rules=CHAIN_RULES), F.col("text"), "doc_id", "drop_reason")


THOUGHT_SQL = "CASE WHEN turn % 4 = 0 THEN '<think>' || instruction || '</think>' || chr(10) ELSE '' END"
ANSWER_SQL = f"trim({sub(sub(sub('raw', V.REASONING_BLOCK), V.RULE_LINE), V.BOLD, chr(92) + '1')}, {WHITE})"


@query("pair_chain", rf"""
SELECT conv_id, turn, md5(instruction) AS instruction, md5(output) AS output FROM (
  SELECT conv_id, turn, {ANSWER_SQL} AS output,
    trim({sub('instruction', V.TRAILING_PUNCT)} || CASE WHEN {DRAW_SQL} < 0.33 THEN '？' WHEN {DRAW_SQL} < 0.66 THEN '。' ELSE '' END, {WHITE}) AS instruction
  FROM (SELECT *, {THOUGHT_SQL} || '**' || output || '**' || chr(10) || '---' AS raw FROM {PAIRS_SQL}))
WHERE length(instruction) > 0 AND length(output) > 30 AND NOT regexp_matches(output, '(?i)think') AND regexp_matches(output, '[.!?]\z')""")
def pair_chain(t: Tables):
    """Pairs with reasoning and markdown in the answer: cleaned, endings varied, then the pair rules."""
    thought = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<think>"), "instruction", F.lit("</think>\n"))).otherwise(F.lit(""))
    raw = pairs(t).withColumn("output", F.concat(thought, F.lit("**"), "output", F.lit("**\n---")))
    kept = G.pair_rules(P.clean_pairs(raw, "conv_id", "turn"), closing=r"[.!?]\z")
    return kept.select("conv_id", "turn", F.md5("instruction").alias("instruction"), F.md5("output").alias("output"))


# ---- blocklists ---------------------------------------------------------------------------------

BLOCKLISTS = {
    "chat": (V.CHAT_INSTRUCTION_BLOCK, V.CHAT_OUTPUT_BLOCK),
    "late_chat": (V.CHAT_LATE_INSTRUCTION_BLOCK, V.CHAT_LATE_OUTPUT_BLOCK),
    "triple": (V.TRIPLE_INSTRUCTION_BLOCK, V.TRIPLE_OUTPUT_BLOCK),
}
BARE = "[b-zA-Z ]+"  # leaves some texts with a Latin letter and some without


def _free_of(column: str, patterns) -> str:
    return " AND ".join(f"NOT coalesce(regexp_matches({column}, {lit(p)}), false)" for p in patterns)


@query("pair_blocklists", " UNION ALL ".join(f"""
SELECT '{name}' AS list, conv_id, turn FROM (SELECT conv_id, turn, {sub('instruction', BARE)} AS instruction, output FROM {PAIRS_SQL})
WHERE {_free_of('instruction', left)} AND {_free_of('output', right)}""" for name, (left, right) in BLOCKLISTS.items()))
def pair_blocklists(t: Tables):
    bare = pairs(t).withColumn("instruction", T.remove(F.col("instruction"), BARE))
    kept = [G.drop_matching_pairs(bare, *patterns).select(F.lit(name).alias("list"), "conv_id", "turn") for name, patterns in BLOCKLISTS.items()]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query("web_blocklist", f"SELECT page_id FROM pages WHERE NOT coalesce(regexp_matches(html, {lit(V.WEB_BLOCKLIST)}), false)")
def web_blocklist(t: Tables):
    return G.drop_matching(t.wide("pages"), "html", [V.WEB_BLOCKLIST]).select("page_id")


#: No phrase ends as another one begins, so the twin may replace them one by one, the longest first.
PHRASES = {"ation": "①", "tion": "②", "ti": "③", "qu": "④"}


def phrase_sql(e: str) -> str:
    for phrase in sorted(PHRASES, key=len, reverse=True):
        e = f"replace({e}, '{phrase}', '{PHRASES[phrase]}')"
    return e


@query("phrase_convert", digest_sql(f"translate({phrase_sql('text')}, 'éèñ', 'een')", "documents", "doc_id"))
def phrase_convert(t: Tables):
    phrased = T.convert_phrases(F.col("text"), PHRASES)
    return digest(t.wide("documents"), T.convert_script(phrased, "éèñ", "een"), "doc_id")


# ---- sources ------------------------------------------------------------------------------------

@query("quarantine_lines", f"""
SELECT row_number() OVER (ORDER BY event_id) AS line_no, line, CASE WHEN NOT json_valid(line) THEN 'invalid json' END AS problem
FROM (SELECT event_id, {DAMAGED} AS line FROM events)""")
def quarantine_lines(t: Tables):
    """The error log names the absolute line of the read files."""
    path = scratch_path(t.spark, "lines")
    damaged_lines(t).repartitionByRange("event_id").sortWithinPartitions("event_id").select("line").write.text(path)
    return J.quarantine(J.numbered_lines(t.spark, path)).select("line_no", "line", "problem")


@query("load_relations", "SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem")
def load_relations(t: Tables):
    """A crawl's nested relation lists, found at the second place that is asked."""
    path = scratch_path(t.spark, "relations")
    edge = F.struct(F.format_string("p%d", "l_partkey").alias("src"), F.format_string("s%d", "l_suppkey").alias("dst"))
    t.lineitem.select(edge.alias("e")).select(F.array("e").alias("relations")).write.parquet(path)
    return M.load_relations(t.spark, [f"{path}-absent", path])


@query("resume_chunks", """
SELECT doc_id, doc_id // step AS chunk, md5(text) AS digest FROM documents, (SELECT max(doc_id) // 4 + 1 AS step FROM documents)""")
def resume_chunks(t: Tables):
    """Four chunks of a job that is stopped after the second one's data and before its manifest entry, then resumed."""
    docs = t.documents.select("doc_id", "text")
    step = docs.agg(F.max("doc_id")).first()[0] // 4 + 1
    path = scratch_path(t.spark, "chunks")
    print_ = M.data_fingerprint(docs, "doc_id", "text").first()["data_fp"]

    def chunk(k: int):
        return docs.filter(F.col("doc_id").between(k * step, (k + 1) * step - 1))

    M.write_chunk(chunk(0), path, 0, print_, {"step": step})
    chunk(1).limit(1).write.parquet(M.chunk_path(path, 1))
    for k in range(M.resume_point(t.spark, path, print_, {"step": step}), 4):
        M.write_chunk(chunk(k), path, k, print_, {"step": step})
    return M.read_chunks(t.spark, path).select("doc_id", "chunk", F.md5("text").alias("digest"))


# ---- streams --------------------------------------------------------------------------------------

@query("stream_gate_totals", f"""
SELECT CASE WHEN drop_reason IS NULL THEN 'clean' ELSE 'audit' END AS verdict, drop_reason, count(*) AS n FROM ({STAGED_SQL}) GROUP BY 1, 2""")
def stream_gate_totals(t: Tables):
    """Running totals of the streamed gate after all that has arrived."""
    path = scratch_path(t.spark, "arriving")
    files, at_once = ST.arriving_files(t.documents)
    J.write_jsonl(t.documents.repartition(files), path, "doc_id", "text")
    arriving = ST.stream_jsonl(t.spark, path, "doc_id BIGINT, text STRING", max_files=at_once)
    gated = ST.stream_gate(arriving, lambda df: G.two_stage_gate(df, **GATE))
    return ST.run_totals(ST.running_totals(gated, "verdict", "drop_reason"), "gate-totals")


@query("stream_frames", r"""
SELECT conv_id || ':' || turn AS request_id, md5(regexp_replace('.,' || text, '^[\s!-/:-@\[-`{-~。？！，、：；]+', '')) AS answer,
 len(regexp_extract_all('.,' || text, '\S+\s*'))::INT AS n_frames, true AS is_done FROM conversations""")
def stream_frames(t: Tables):
    """Frames that arrive in any order and partly twice, put together as a stream."""
    path = scratch_path(t.spark, "frames-arriving")
    text = F.concat(F.lit(".,"), F.col("text"))
    parts = F.concat(F.regexp_extract_all(text, F.lit(r"(?s)\S+\s*"), F.lit(0)), F.array(F.lit(FR.DONE)))
    frames = t.conversations.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), F.posexplode(parts).alias("seq", "frame")
    )
    replayed = frames.filter(F.col("seq") % 7 == 0)
    files, at_once = ST.arriving_files(t.conversations)
    J.write_jsonl(frames.unionByName(replayed).repartition(files), path)
    arriving = ST.stream_jsonl(t.spark, path, "request_id STRING, seq INT, frame STRING", max_files=at_once)
    out = ST.run_to_table(FR.assemble_stream(arriving, timeout_ms=None), "frames")
    return out.withColumn("answer", F.md5("answer"))


# ---- byte pairs ------------------------------------------------------------------------------------

@query("bpe_roundtrip", digest_sql(
    detokenize_sql(sub(sub("text", V.ISOLATED_PUNCT, r" \1 "), r"\s+", " ")), "documents", "doc_id"))
def bpe_roundtrip(t: Tables):
    """Encoding with a whole vocabulary and decoding gives the detokenised text back when the alphabet covers all characters."""
    texts = whole_texts(t)
    words = written_table(B.word_table(raw_texts(t)), "bpe-words")
    chars = B.alphabet(words, coverage=1.0)
    merges = B.train_bpe(words, n_merges=V.VOCAB_SIZE - len(chars) - 4)
    vocab = B.build_vocab(chars, merges)
    ids = texts.select("doc_id", B.encoder(merges, vocab)("text").alias("ids"))
    return digest(ids, B.decode(F.col("ids"), vocab), "doc_id")

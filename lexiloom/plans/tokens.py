"""Token engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as AR
from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import bpe as B
from ..operators import ordering as O
from ..operators import profile as R
from ..operators import tokens as K
from ..session import scratch_path, spread, written_table
from ..sources import arrow_files as A
from .cleaning import PAIRS_SQL, digest, digest_sql, pairs, sub
from .registry import Tables, query

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

IDS_SQL = rf"""
docw AS (SELECT doc_id, text, {WORDS} AS w FROM documents WHERE text <> ''),
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docw),
vocab AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) + 4 AS id FROM tok GROUP BY word QUALIFY id <= 16384),
ids AS (SELECT doc_id, i, word, coalesce(id, 2)::INT AS id FROM tok LEFT JOIN vocab USING (word))"""

PACK_SQL = IDS_SQL + """,
dn AS (SELECT doc_id, len(w) AS n, sum(len(w) + 3) OVER (ORDER BY doc_id) - (len(w) + 3) AS off FROM docw),
seq0 AS (SELECT off AS pos, 3 AS id FROM dn UNION ALL SELECT off + n + 1, 4 FROM dn UNION ALL SELECT off + n + 2, 4 FROM dn
  UNION ALL SELECT off + i, id FROM ids JOIN dn USING (doc_id)),
tot AS (SELECT count(*) AS n FROM seq0),
seq AS (SELECT pos, id FROM seq0 UNION ALL SELECT unnest(range(n, (n + 511) // 512 * 512)), 1 FROM tot),
blk AS (SELECT (pos // 512)::BIGINT AS block_id, list(id ORDER BY pos) AS ids FROM seq GROUP BY 1),
nxt AS (SELECT pos, id AS x, lead(id) OVER (ORDER BY pos) AS y FROM seq),
pc AS (SELECT x, y, count(*) AS nxy FROM nxt WHERE y IS NOT NULL GROUP BY x, y)"""


def doc_words(t: Tables):
    return spread(t.documents.filter("text != ''").select("doc_id", "text")).withColumn("w", T.words(F.col("text")))


def encoded(t: Tables):
    words = doc_words(t)
    encode = K.vocab_encoder(K.word_vocab(words))
    return words.select("doc_id", "text", encode("w").alias("ids"), F.size("w").alias("n_ids"))


def packed(t: Tables):
    return K.pack_blocks(encoded(t), "doc_id", n_ids="n_ids")


def counts(t: Tables):
    """Pair counts as a written table: later steps read it several times."""
    return written_table(K.bigram_counts(packed(t)), "bigrams")


def block_digest(df, *columns):
    return df.select(
        "block_id", *[F.md5(AR.ids_text(F.col(c))).alias(c) for c in columns], F.size(columns[0]).alias("n")
    )


IDS_TEXT = "array_to_string({0}, ',')"
PACKED_SQL = f"WITH {PACK_SQL} SELECT block_id, md5({IDS_TEXT.format('ids')}) AS ids, len(ids)::INT AS n FROM blk"


@query("pack_blocks", PACKED_SQL)
def pack_blocks(t: Tables):
    return block_digest(packed(t), "ids")


@query("token_bin_roundtrip", PACKED_SQL)
def token_bin_roundtrip(t: Tables):
    path = scratch_path(t.spark, "token-bin")
    A.write_token_bin(packed(t), path, parts=t.spark.sparkContext.defaultParallelism)
    rows = A.read_token_bin(t.spark, path, tokens_per_split=1 << 18)
    return block_digest(K.samples_from_rows(rows, "pos", ids="token").withColumnRenamed("sample_id", "block_id"), "ids")


@query("token_bin_append", PACKED_SQL)
def token_bin_append(t: Tables):
    """The same tokens written in two runs, over what an older run with more parts left."""
    path = scratch_path(t.spark, "token-bin")
    blocks = written_table(packed(t), "packed")
    early = F.col("block_id") <= blocks.agg(F.percentile_approx("block_id", 0.5)).scalar()
    A.write_token_bin(blocks, path, parts=5)
    A.write_token_bin(blocks.filter(early), path, parts=2)
    A.write_token_bin(blocks.filter(~early), path, parts=3, append=True)
    rows = A.read_token_bin(t.spark, path, tokens_per_split=1 << 18)
    return block_digest(K.samples_from_rows(rows, "pos", ids="token").withColumnRenamed("sample_id", "block_id"), "ids")


@query("rows_to_samples", f"""
WITH {PACK_SQL} SELECT block_id AS sample_id, md5({IDS_TEXT.format('ids')}) AS x,
 md5({IDS_TEXT.format('list_transform(ids, lambda v: v % 2)')}) AS flag FROM blk""")
def rows_to_samples(t: Tables):
    flat = packed(t).select("block_id", F.posexplode("ids").alias("pos", "token"))
    rows = flat.select((F.col("block_id") * V.BLOCK_LEN + F.col("pos")).alias("row"), "token", (F.col("token") % 2).alias("odd"))
    out = K.samples_from_rows(rows, x="token", flag="odd")
    return out.select("sample_id", F.md5(AR.ids_text(F.col("x"))).alias("x"), F.md5(AR.ids_text(F.col("flag"))).alias("flag"))


@query("blocks_disjoint", f"""
WITH {PACK_SQL} SELECT block_id, md5({IDS_TEXT.format('ids[1:511]')}) AS x, md5({IDS_TEXT.format('ids[2:512]')}) AS y, 511 AS n FROM blk""")
def blocks_disjoint(t: Tables):
    return block_digest(K.blocks_disjoint(packed(t)), "x", "y")


@query("blocks_overlap", f"""
WITH {PACK_SQL} SELECT a.block_id, md5({IDS_TEXT.format('a.ids')}) AS x,
 md5({IDS_TEXT.format('list_append(a.ids[2:512], b.ids[1])')}) AS y, 512 AS n
FROM blk a JOIN blk b ON b.block_id = a.block_id + 1""")
def blocks_overlap(t: Tables):
    return block_digest(K.blocks_overlap(packed(t)), "x", "y")


@query("bigram_pairs", f"WITH {PACK_SQL} SELECT x, y, nxy FROM pc")
def bigram_pairs(t: Tables):
    return K.bigram_counts(packed(t))


PMI_SQL = PACK_SQL + """,
mx AS (SELECT x, sum(nxy)::BIGINT AS nx FROM pc GROUP BY x), my AS (SELECT y, sum(nxy)::BIGINT AS ny FROM pc GROUP BY y),
tn AS (SELECT (sum(nxy) + 1)::DOUBLE AS n FROM pc),
pm AS (SELECT x, y, nxy, nx, ny, log2(nxy * n / (nx::DOUBLE * ny)) AS pmi FROM pc JOIN mx USING (x) JOIN my USING (y), tn)"""


@query("bigram_pmi", f"WITH {PMI_SQL} SELECT x, y, nxy, nx, ny, round(pmi, 6) AS pmi FROM pm")
def bigram_pmi(t: Tables):
    return K.pmi(counts(t)).select("x", "y", "nxy", "nx", "ny", F.round("pmi", 6).alias("pmi"))


@query("pmi_heatmap", f"""
WITH {PMI_SQL} SELECT floor(round(log10(nxy), 9) / 0.1)::BIGINT AS x_bin, floor(round(pmi, 9) / 0.25)::BIGINT AS y_bin,
 count(*) AS n FROM pm WHERE nxy > 10 GROUP BY 1, 2""")
def pmi_heatmap(t: Tables):
    frequent = K.pmi(counts(t)).filter("nxy > 10")
    return K.joint_bins(frequent, F.log10("nxy"), F.col("pmi"), 0.1, 0.25)


LATIN_ENTITY = dict(
    count_band=(3, 300), pmi_band=(0.5, 13.5), shape=r"^\p{L}+\z", length=(3, 14), punct="['-]",
    prefix="^(the|de|la|der)", suffix=r"(s|n)\z",
)


@query("pmi_entities", rf"""
WITH {PMI_SQL}, best AS (SELECT * FROM pm WHERE nxy > 3 AND nxy < 300 AND pmi > 0.5 AND pmi < 13.5 ORDER BY pmi DESC, x, y LIMIT 500)
SELECT a.word || b.word AS entity, nxy, round(pmi, 6) AS pmi FROM best JOIN vocab a ON a.id = x JOIN vocab b ON b.id = y
WHERE regexp_matches(entity, '^\p{{L}}+\z') AND length(entity) BETWEEN 3 AND 14 AND NOT regexp_matches(entity, '[''-]')
 AND NOT regexp_matches(entity, '^(the|de|la|der)') AND NOT regexp_matches(entity, '(s|n)\z')""")
def pmi_entities(t: Tables):
    words = doc_words(t)
    vocab = written_table(K.word_vocab(words), "vocab")
    blocks = K.pack_blocks(words.select("doc_id", K.vocab_encoder(vocab)("w").alias("ids")), "doc_id")
    scored = K.pmi(written_table(K.bigram_counts(blocks), "bigrams"))
    out = K.pmi_entities(scored, vocab, **LATIN_ENTITY)
    return out.select("entity", "nxy", F.round("pmi", 6).alias("pmi"))


@query("tokenizer_report", f"""
WITH {IDS_SQL}, a AS (SELECT count(*) AS n, count(*) FILTER (id = 2) AS u FROM ids),
b AS (SELECT count(*) AS d, sum(length(text)) AS c FROM docw)
SELECT (n + 2 * d)::BIGINT AS total_tokens, round(u / (n + 2 * d), 6) AS unk_ratio, round((n + 2 * d) / c, 6) AS tokens_per_char FROM a, b""")
def tokenizer_report(t: Tables):
    out = K.tokenizer_report(encoded(t))
    return out.select("total_tokens", F.round("unk_ratio", 6).alias("unk_ratio"), F.round("tokens_per_char", 6).alias("tokens_per_char"))


PIECES = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"


@query("token_spans", rf"""
WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '{PIECES}') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM p),
s AS (SELECT doc_id, i, tok, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM e),
g AS (SELECT doc_id, count(*) AS n, md5(string_agg((e - length(tok))::VARCHAR, ',' ORDER BY i)) AS starts,
  md5(string_agg(e::VARCHAR, ',' ORDER BY i)) AS ends, string_agg(tok, '' ORDER BY i) AS again FROM s GROUP BY doc_id)
SELECT g.doc_id, n::INT AS n_tokens, starts, ends, again = text AS rebuilt FROM g JOIN documents USING (doc_id)""")
def token_spans(t: Tables):
    tokens = t.wide("documents").select("doc_id", "text", K.pieces(F.col("text"), PIECES).alias("tokens"))
    return K.with_spans(tokens).select(
        "doc_id", F.size("tokens").alias("n_tokens"),
        F.md5(AR.ids_text(F.col("starts"))).alias("starts"), F.md5(AR.ids_text(F.col("ends"))).alias("ends"),
        (F.array_join("tokens", "") == F.col("text")).alias("rebuilt"),
    )


@query("truncate_by_span", rf"""
WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '{PIECES}') AS w FROM documents),
c AS (SELECT doc_id, CASE WHEN len(w) > 64 THEN rtrim(array_to_string(w[1:64], ''), ' ' || chr(9) || chr(13) || chr(10)) ELSE text END AS t FROM p)
SELECT doc_id, len(regexp_extract_all(t, '{PIECES}'))::INT AS n_tokens, md5(t) AS digest FROM c WHERE len(regexp_extract_all(t, '{PIECES}')) >= 2""")
def truncate_by_span(t: Tables):
    out = K.truncate_by_span(t.wide("documents").select("doc_id", "text"), 64, PIECES)
    return out.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5("text").alias("digest"))


SFT_SQL = rf"""
WITH cw AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM conversations),
vocab AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) + 4 AS id FROM cw GROUP BY word QUALIFY id <= 16384),
pr AS (SELECT conv_id, turn, regexp_extract_all(lower(instruction), '[\p{{L}}\p{{N}}]+') AS p, regexp_extract_all(lower(output), '[\p{{L}}\p{{N}}]+') AS r FROM {PAIRS_SQL}),
pe AS (SELECT conv_id, turn, 0 AS part, unnest(p) AS word, generate_subscripts(p, 1) AS i FROM pr
  UNION ALL SELECT conv_id, turn, 1, unnest(r), generate_subscripts(r, 1) FROM pr),
en AS (SELECT conv_id, turn, part, list(coalesce(id, 2)::INT ORDER BY i) AS ids FROM pe LEFT JOIN vocab USING (word) GROUP BY ALL),
fu AS (SELECT pr.conv_id, pr.turn, len(p) AS np, len(r) AS nr,
   [3] || coalesce(a.ids, []) || coalesce(b.ids, []) || [4] AS f FROM pr
   LEFT JOIN en a ON a.conv_id = pr.conv_id AND a.turn = pr.turn AND a.part = 0
   LEFT JOIN en b ON b.conv_id = pr.conv_id AND b.turn = pr.turn AND b.part = 1)
SELECT conv_id, turn, md5(array_to_string(list_resize(f[1:len(f) - 1], 512, 1), ',')) AS x,
 md5(array_to_string(list_resize(f[2:len(f)], 512, 1), ',')) AS y, least(nr + 1, greatest(512 - np, 0))::INT AS n_loss,
 least(np, 512)::INT AS first_loss FROM fu"""


@query("sft_masked_samples", SFT_SQL)
def sft_masked_samples(t: Tables):
    encode = K.vocab_encoder(K.word_vocab(t.conversations.select(T.words(F.col("text")).alias("w"))))
    ids = pairs(t).select(
        "conv_id", "turn",
        encode(T.words(F.col("instruction"))).alias("prompt_ids"), encode(T.words(F.col("output"))).alias("response_ids"),
    )
    out = K.masked_sample(ids)
    flagged = F.array_position("loss_mask", True)
    return out.select(
        "conv_id", "turn", F.md5(AR.ids_text(F.col("x"))).alias("x"), F.md5(AR.ids_text(F.col("y"))).alias("y"),
        F.size(F.filter("loss_mask", lambda m: m)).alias("n_loss"),
        F.when(flagged > 0, flagged - 1).otherwise(F.size("loss_mask")).cast("int").alias("first_loss"),
    )


@query("bpe_sample", digest_sql(
    sub(sub("text", V.ISOLATED_PUNCT, r" \1 "), r"\s+", " "), "documents", "doc_id",
    "text <> '' AND ('0x' || substr(md5('123:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3"))
def bpe_sample(t: Tables):
    return digest(bpe_rows(t), F.col("text"), "doc_id")


def bpe_rows(t: Tables):
    kept = O.hash_sample(t.documents.select("doc_id", "text").filter("text != ''"), 0.3, 123, "doc_id")
    return kept.withColumn("text", T.isolate_punct(F.col("text")))


#: Merges of ``bpe_train``, whose SQL twin spells out every step; all other queries learn whole vocabularies.
N_MERGES = 40

#: Every word of the corpus with its symbols, then one greedy merge per step.
BPE_SQL = r"""
WITH tx AS (SELECT doc_id, string_split_regex(trim(t), '\s+') AS ws FROM (SELECT doc_id, """ + (
    sub(sub("text", V.ISOLATED_PUNCT, r" \1 "), r"\s+", " ") + r""" AS t FROM documents)),
dw AS (SELECT * FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM tx) WHERE word <> ''),
w0 AS MATERIALIZED (SELECT word, chr(1) || array_to_string(regexp_extract_all('▁' || word, '(?s).'), chr(2) || chr(1)) || chr(2) AS s, count(*) AS freq
  FROM dw GROUP BY word)""") + "".join(f""",
p{i} AS (SELECT p.l, p.r, sum(freq) AS n FROM (SELECT unnest(list_transform(range(1, len(x)), lambda k: {{'l': x[k], 'r': x[k + 1]}})) AS p, freq
  FROM (SELECT string_split(s[2:length(s) - 1], chr(2) || chr(1)) AS x, freq FROM w{i - 1})) GROUP BY ALL),
b{i} AS MATERIALIZED (SELECT {i}::INT AS rank, l, r FROM p{i} WHERE n >= 2 ORDER BY n DESC, l, r LIMIT 1),
w{i} AS MATERIALIZED (SELECT word, coalesce(replace(s, chr(1) || l || chr(2) || chr(1) || r || chr(2), chr(1) || l || r || chr(2)), s) AS s, freq
  FROM w{i - 1} LEFT JOIN b{i} ON true)""" for i in range(1, N_MERGES + 1)) + """,
merges AS (""" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(1, N_MERGES + 1)) + ")"


def raw_texts(t: Tables):
    return spread(t.documents.select("doc_id", "text"))


def whole_texts(t: Tables):
    return raw_texts(t).withColumn("text", T.isolate_punct(F.col("text")))


@query("bpe_train", BPE_SQL + ' SELECT rank, l AS "left", r AS "right" FROM merges')
def bpe_train(t: Tables):
    merges = B.train_bpe(B.word_table(whole_texts(t)), n_merges=N_MERGES)
    return t.spark.createDataFrame(
        [(i + 1, left, right) for i, (left, right) in enumerate(merges)], "rank INT, left STRING, right STRING"
    )


@query("bpe_vocabulary")
def bpe_vocabulary(t: Tables):
    """The whole vocabulary: special symbols, characters and merged symbols, up to its size or until nothing repeats."""
    words = written_table(B.word_table(raw_texts(t)), "bpe-words")
    vocab = B.build_vocab(B.alphabet(words), B.train_bpe(words))
    return t.spark.createDataFrame(list(enumerate(vocab, 1)), "id INT, symbol STRING")


@query("bpe_first_merge", r"""
WITH w AS (SELECT unnest(string_split_regex(trim(t), '\s+')) AS word FROM (SELECT """
       + sub(sub("text", V.ISOLATED_PUNCT, r" \1 "), r"\s+", " ") + r""" AS t FROM documents
  WHERE text <> '' AND ('0x' || substr(md5('123:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3)),
f AS (SELECT '▁' || word AS word, count(*) AS freq FROM w WHERE word <> '' GROUP BY word),
p AS (SELECT substr(word, i, 1) AS l, substr(word, i + 1, 1) AS r, freq FROM (SELECT *, unnest(range(1, length(word))) AS i FROM f))
SELECT l AS "left", r AS "right", sum(freq)::BIGINT AS n FROM p GROUP BY l, r ORDER BY n DESC, l, r LIMIT 1""")
def bpe_first_merge(t: Tables):
    return B.pair_counts(B.word_table(spread(bpe_rows(t)))).orderBy(F.desc("n"), "left", "right").limit(1)


@query("bpe_encode")
def bpe_encode(t: Tables):
    """Texts in ids of the whole vocabulary, as ``bpe_vocabulary`` learns it."""
    texts = whole_texts(t)
    words = written_table(B.word_table(raw_texts(t)), "bpe-words")
    merges = B.train_bpe(words)
    vocab = B.build_vocab(B.alphabet(words), merges)
    ids = texts.select("doc_id", B.encoder(merges, vocab)("text").alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), F.md5(AR.ids_text(F.col("ids"))).alias("digest"))


@query("array_pad_truncate", rf"""
SELECT doc_id, md5(array_to_string(list_resize(list_transform({WORDS}, lambda w: length(w)), 64, 0), ',')) AS ids FROM documents""")
def array_pad_truncate(t: Tables):
    lengths = F.transform(T.words(F.col("text")), F.length)
    return t.documents.select("doc_id", F.md5(AR.ids_text(AR.pad_to(lengths, 64, F.lit(0)))).alias("ids"))


@query("token_loss_profile", f"""
WITH {PMI_SQL}, l AS (SELECT n.y AS token, -ln(nxy::DOUBLE / nx) AS loss FROM nxt n JOIN pm USING (x, y))
SELECT token, count(*) AS freq, round(avg(loss), 5) AS mean_loss, round(stddev_samp(loss), 5) AS sd_loss FROM l
GROUP BY token HAVING count(*) > 15 ORDER BY mean_loss DESC, token LIMIT 50""")
def token_loss_profile(t: Tables):
    pair_table = counts(t)
    nx = pair_table.groupBy("x").agg(F.sum("nxy").alias("nx"))
    loss = (-F.log(F.col("nxy") / F.col("nx"))).alias("loss")
    rows = pair_table.join(nx, "x").select(F.col("y").alias("token"), loss, "nxy")
    return R.token_loss_profile(rows, digits=5, weight="nxy")

"""Evaluation, diagnostics, routing, enrichment and streaming queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import arrays as AR
from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import enrich as EN
from ..operators import evals as E
from ..operators import gates as G
from ..operators import vectors as VE
from ..session import scratch_path, written_table
from ..sources import jsonl as J
from ..streaming import frames as FR
from ..streaming import ingest as ST
from .cleaning import GATE, PAIRS_SQL, STAGED_SQL, pairs
from .registry import Tables, query
from .sources import QA_SQL, RANKED_SQL, qa_log, ranked_customers
from .tokens import WORDS, doc_words
from .vectors import D, DIRECTION_SQL, UNIT_SQL, VEC, directed

# ---- choice scoring -----------------------------------------------------------------------------

COUNT_SQL = rf"""
docw AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text <> ''),
tok AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM docw),
nx AS (SELECT x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM tok),
pc AS (SELECT x, y, count(*) AS nxy FROM nx WHERE y IS NOT NULL GROUP BY x, y),
sc AS (SELECT x, count(*) AS nx FROM tok GROUP BY x)"""

ITEM_SQL = COUNT_SQL + rf""",
bw AS (SELECT item_id, w, len(w) // 2 AS h FROM (SELECT item_id, {WORDS} AS w FROM benchmark)),
bn AS (SELECT count(*) AS n FROM bw),
ch AS (SELECT a.item_id, ((a.item_id + k) % 4)::INT AS choice_idx, a.w[1:a.h] AS q, b.w[b.h + 1:] AS c
  FROM bw a, bn, range(4) r(k) JOIN bw b ON b.item_id = (a.item_id + k * 7) % n),
st0 AS (SELECT item_id, choice_idx, unnest(c) AS y, generate_subscripts(c, 1) AS i, unnest(list_prepend(coalesce(q[-1], ''), c[1:len(c) - 1])) AS x FROM ch),
lg AS (SELECT item_id, choice_idx, i, y, ln((coalesce(nxy, 0) + 1) / (coalesce(nx, 0) + 16384)) AS logprob
  FROM st0 LEFT JOIN pc USING (x, y) LEFT JOIN sc USING (x)),
ug AS (SELECT item_id, choice_idx, ln((coalesce(nx, 0) + 1) / 1e6) AS logprob FROM st0 LEFT JOIN sc ON sc.x = st0.y),
s1 AS (SELECT ch.item_id, ch.choice_idx, coalesce(avg(logprob), '-inf'::DOUBLE) AS score, count(logprob) AS n_tokens
  FROM ch LEFT JOIN lg USING (item_id, choice_idx) GROUP BY ALL),
s2 AS (SELECT ch.item_id, ch.choice_idx, coalesce(avg(logprob), '-inf'::DOUBLE) AS score FROM ch LEFT JOIN ug USING (item_id, choice_idx) GROUP BY ALL),
pr AS (SELECT 'bigram' AS model, item_id, choice_idx AS predicted FROM s1 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, choice_idx) = 1
  UNION ALL SELECT 'unigram', item_id, choice_idx FROM s2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, choice_idx) = 1),
rs AS (SELECT model, item_id, predicted, (item_id % 4)::INT AS truth, predicted = item_id % 4 AS is_correct,
  CASE WHEN item_id % 3 = 0 THEN 'general' ELSE 'cat' || (item_id % 3) END AS category, 'default' AS subcategory0, 'sub' || (item_id % 5) AS subcategory FROM pr)"""


def choice_items(t: Tables):
    """Question = first half of a passage; choices = its true second half and three others."""
    halves = t.benchmark.select("item_id", T.words(F.col("text")).alias("w"))
    h = F.floor(F.size("w") / 2).cast("int")
    halves = written_table(
        halves.select("item_id", F.slice("w", F.lit(1), h).alias("q"), F.slice("w", h + 1, F.size("w")).alias("c")), "halves"
    )
    n = halves.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = halves.select("item_id", "q", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select(
        "item_id", "q", ((F.col("item_id") + F.col("k")) % 4).cast("int").alias("choice_idx"),
        ((F.col("item_id") + F.col("k") * 7) % n).alias("other"),
    )
    return wanted.join(halves.select(F.col("item_id").alias("other"), "c"), "other").drop("other")


def counts(t: Tables, steps):
    pair, single = E.ngram_counts(doc_words(t), steps=steps)
    return written_table(pair, "word-pairs"), written_table(single, "word-counts")


def scored_choices(t: Tables):
    keys = ["item_id", "choice_idx"]
    items = written_table(choice_items(t), "choices")
    steps = E.word_steps(items, keys, "q", "c")
    pair, single = counts(t, steps)
    bigram = E.choice_scores(items.select(*keys), E.smoothed_logprob(steps, pair, single), keys)
    alone = steps.drop("x").withColumnRenamed("y", "x").join(single, "x", "left")
    unigram = alone.withColumn("logprob", F.log((F.coalesce("nx", F.lit(0)) + 1) / F.lit(1e6)))
    return bigram, E.choice_scores(items.select(*keys), unigram, keys)


@query("choice_loglik", f"WITH {ITEM_SQL} SELECT item_id, choice_idx, n_tokens, round(score, 6) AS score FROM s1")
def choice_loglik(t: Tables):
    bigram, _ = scored_choices(t)
    return bigram.select("item_id", "choice_idx", "n_tokens", F.round("score", 6).alias("score"))


def results(t: Tables):
    bigram, unigram = scored_choices(t)
    both = E.predict(bigram, ["item_id"]).withColumn("model", F.lit("bigram")).unionByName(
        E.predict(unigram, ["item_id"]).withColumn("model", F.lit("unigram"))
    )
    truth = E.truth_index(F.when(F.col("item_id") % 2 == 0, (F.col("item_id") % 4).cast("string"))
                          .otherwise(F.char(F.lit(ord("A")) + F.col("item_id") % 4)))
    named = both.withColumns({
        "truth": truth,
        "category": F.when(F.col("item_id") % 3 != 0, F.format_string("cat%d", F.col("item_id") % 3)),
        "subcategory": F.format_string("sub%d", F.col("item_id") % 5),
    })
    judged = named.withColumn("is_correct", F.col("predicted") == F.col("truth"))
    return written_table(E.with_defaults(judged, {"category": "general", "subcategory": "default"}), "results")


@query("choice_predict", f"WITH {ITEM_SQL} SELECT model, item_id, predicted, truth, is_correct FROM rs")
def choice_predict(t: Tables):
    return results(t).select("model", "item_id", "predicted", "truth", "is_correct")


@query("optional_defaults", """
SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'general') AS category, 'default' AS subcategory FROM events""")
def optional_defaults(t: Tables):
    rows = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("category"))
    return E.with_defaults(rows, {"category": "general", "subcategory": "default"})


@query("accuracy_overall", f"""
WITH {ITEM_SQL} SELECT model, count(*) AS total, count(*) FILTER (is_correct) AS correct,
 printf('%.2f%%', count(*) FILTER (is_correct) / count(*) * 100.0::DOUBLE) AS accuracy FROM rs GROUP BY model""")
def accuracy_overall(t: Tables):
    return E.accuracy_overall(results(t))


@query("accuracy_pivot", f"""
WITH {ITEM_SQL} SELECT subcategory, printf('%.2f%%', avg(is_correct::INT) FILTER (model = 'bigram') * 100.0::DOUBLE) AS bigram,
 printf('%.2f%%', avg(is_correct::INT) FILTER (model = 'unigram') * 100.0::DOUBLE) AS unigram FROM rs GROUP BY subcategory""")
def accuracy_pivot(t: Tables):
    return E.accuracy_pivot(results(t), ["bigram", "unigram"])


@query("accuracy_extremes", f"""
WITH {ITEM_SQL}, a AS (SELECT model, '{V.OVERALL_NAME}' AS category, count(*) FILTER (is_correct) / count(*) * 100.0::DOUBLE AS acc FROM rs GROUP BY model
 UNION ALL SELECT model, category, count(*) FILTER (is_correct) / count(*) * 100.0::DOUBLE FROM rs GROUP BY model, category),
p AS (SELECT category, min(acc) AS min_acc, max(acc) AS max_acc, avg(acc) AS mean_acc FROM a GROUP BY category),
o AS (SELECT *, row_number() OVER (ORDER BY (category = '{V.OVERALL_NAME}')::INT, mean_acc, category) AS position FROM p)
SELECT model, category, round(acc, 6) AS acc, round(min_acc, 6) AS min_acc, round(max_acc, 6) AS max_acc, round(mean_acc, 6) AS mean_acc,
 position::INT AS position, acc = max_acc AS is_max FROM a JOIN o USING (category)""")
def accuracy_extremes(t: Tables):
    out = E.accuracy_extremes(results(t))
    return out.select("model", "category", *[F.round(c, 6).alias(c) for c in ("acc", "min_acc", "max_acc", "mean_acc")], "position", "is_max")


@query("best_of_n", rf"""
WITH {COUNT_SQL}, cd AS (SELECT conv_id, turn, regexp_extract_all(lower(instruction), '[\p{{L}}\p{{N}}]+') AS q,
  regexp_extract_all(lower(output), '[\p{{L}}\p{{N}}]+') AS c FROM {PAIRS_SQL}),
st0 AS (SELECT conv_id, turn, unnest(c) AS y, unnest(list_prepend(coalesce(q[-1], ''), c[1:len(c) - 1])) AS x FROM cd),
s AS (SELECT conv_id, turn, avg(ln((coalesce(nxy, 0) + 1) / (coalesce(nx, 0) + 16384))) AS score FROM st0 LEFT JOIN pc USING (x, y) LEFT JOIN sc USING (x) GROUP BY conv_id, turn),
f AS (SELECT cd.conv_id, cd.turn, coalesce(score, '-inf'::DOUBLE) AS score FROM cd LEFT JOIN s ON s.conv_id = cd.conv_id AND s.turn = cd.turn)
SELECT conv_id, count(*) OVER (PARTITION BY conv_id) AS n_candidates, turn AS best, round(score, 6) AS score,
 CASE WHEN score < -9.0 THEN 'rejected' ELSE 'accepted' END AS verdict
FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) = 1""")
def best_of_n(t: Tables):
    candidates = pairs(t).select(
        "conv_id", "turn", T.words(F.col("instruction")).alias("q"), T.words(F.col("output")).alias("c")
    )
    keys = ["conv_id", "turn"]
    steps = E.word_steps(candidates, keys, "q", "c")
    pair, single = counts(t, steps)
    logp = E.smoothed_logprob(steps, pair, single)
    scored = E.choice_scores(candidates.select(*keys), logp, keys)
    return E.best_of_n(scored, ["conv_id"], "turn", floor=-9.0).withColumn("score", F.round("score", 6))


@query("layer_top1_pivot", f"""
WITH l AS (SELECT vec_id AS pos, (d - 1) // 16 AS layer, (d - 1) % 16 AS token, x FROM (SELECT vec_id, unnest({D}) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)),
b AS (SELECT pos, layer, token FROM l QUALIFY row_number() OVER (PARTITION BY pos, layer ORDER BY x DESC, token) = 1)
SELECT pos, """ + ", ".join(f"(max(token) FILTER (layer = {i}))::INT AS layer_{i}" for i in range(4)) + " FROM b GROUP BY pos")
def layer_top1_pivot(t: Tables):
    flat = t.embeddings.select(F.col("vec_id").alias("pos"), F.posexplode(VEC).alias("d", "logit"))
    logits = flat.select("pos", F.floor(F.col("d") / 16).cast("int").alias("layer"), (F.col("d") % 16).cast("int").alias("token"), "logit")
    return E.top1_by_layer(logits, range(4))


# ---- uncertainty --------------------------------------------------------------------------------

@query("semantic_entropy", r"""
WITH a AS (SELECT 'u' || user_id AS prompt, event_type AS response FROM events UNION ALL SELECT 'c' || conv_id, text FROM conversations WHERE role = 'assistant'),
c AS (SELECT prompt, regexp_replace(response, '[[:punct:]\s]+', '', 'g') AS key, count(*) AS n FROM a GROUP BY 1, 2),
s AS (SELECT prompt, count(*) AS n_clusters, sum(n)::BIGINT AS n_samples, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS e FROM c GROUP BY prompt)
SELECT prompt, n_clusters, n_samples, abs(round(e, 6)) AS entropy, CASE WHEN abs(e) < 0.5 THEN 'confident' WHEN e < 1.2 THEN 'hesitant' ELSE 'guessing' END AS band FROM s""")
def semantic_entropy(t: Tables):
    by_user = t.events.select(F.format_string("u%d", "user_id").alias("prompt"), F.col("event_type").alias("response"))
    by_conv = t.conversations.filter("role = 'assistant'").select(F.format_string("c%d", "conv_id").alias("prompt"), F.col("text").alias("response"))
    out = E.semantic_entropy(by_user.unionByName(by_conv), "prompt", "response")
    return out.withColumn("entropy", F.abs(F.round("entropy", 6)))


SET_SQL = UNIT_SQL + """,
sm AS (SELECT vec_id, d, exp(10 * x) AS e FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e)),
pb AS (SELECT vec_id, d, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM sm),
cu AS (SELECT vec_id, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, d) AS mass, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, d) AS r FROM pb),
sz AS (SELECT vec_id, coalesce(min(r) FILTER (mass > 1 - 0.1::DOUBLE), max(r))::INT AS set_size FROM cu GROUP BY vec_id),
sp AS (SELECT vec_id, set_size, set_size * 100.0::DOUBLE / 64 AS set_pct FROM sz)"""


def prediction_sets(t: Tables):
    scaled = F.transform(VE.as_double(F.col(VEC)), lambda x: x * 10.0)
    probs = t.embeddings.select("vec_id", AR.softmax(scaled).alias("p"))
    return E.top_p_set_size(probs, "p")


@query("top_p_set_size", f"WITH {SET_SQL} SELECT vec_id, set_size, round(set_pct, 6) AS set_pct FROM sp")
def top_p_set_size(t: Tables):
    return prediction_sets(t).select("vec_id", "set_size", F.round("set_pct", 6).alias("set_pct"))


@query("risk_bands", f"""
WITH {SET_SQL}, {DIRECTION_SQL[DIRECTION_SQL.index('pd AS'):]},
x AS (SELECT 'set_' || CASE WHEN set_pct / 20 <= 1 THEN 'safe' WHEN set_pct / 20 <= 3 THEN 'warn' ELSE 'high' END AS band, set_pct / 20 AS v FROM sp
  UNION ALL SELECT 'score_' || risk, score FROM dr)
SELECT band, count(*) AS n, round(min(v), 6) AS low, round(median(v), 6) AS mid, round(max(v), 6) AS high FROM x GROUP BY band""")
def risk_bands(t: Tables):
    sets = prediction_sets(t).select((F.col("set_pct") / 20).alias("v"))
    tagged = sets.withColumn("band", F.concat(F.lit("set_"), E.set_risk(F.col("v"))))
    scores = directed(t).select(F.col("score").alias("v"), F.concat(F.lit("score_"), "risk").alias("band"))
    out = E.risk_bands(tagged.unionByName(scores), "v", "band")
    return out.withColumns({c: F.round(c, 6) for c in ("low", "mid", "high")})


@query("watermark_z", rf"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text <> ''),
g AS (SELECT doc_id, len(w) - 10 AS n, unnest(w[11:]) AS y, unnest(w[10:len(w) - 1]) AS c FROM w WHERE len(w) > 10),
h AS (SELECT doc_id, n, sum((('0x' || substr(md5('421337:' || c || ':' || y), 1, 8))::BIGINT % 1000 < 500)::INT) AS hits FROM g GROUP BY doc_id, n)
SELECT doc_id, n::INT AS n_gen, hits::INT AS hits, round((hits - n * 0.5::DOUBLE) / sqrt(n * 0.25::DOUBLE), 6) AS z,
 (hits - n * 0.5::DOUBLE) / sqrt(n * 0.25::DOUBLE) >= 2 AS is_marked FROM h""")
def watermark_z(t: Tables):
    out = E.watermark_test(written_table(doc_words(t).select("doc_id", "w"), "words"), "w", F.lit(10))
    return out.select("doc_id", "n_gen", "hits", F.round("z", 6).alias("z"), "is_marked")


@query("watermark_pairs", rf"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text <> ''),
g AS (SELECT doc_id, len(w) - 10 AS n, unnest(w[11:]) AS y, unnest(w[10:len(w) - 1]) AS c, unnest(w[9:len(w) - 2]) AS b FROM w WHERE len(w) > 10)
SELECT doc_id, n::INT AS n_gen,
 sum((('0x' || substr(md5('421337:' || b || ',' || c || ':' || y), 1, 8))::BIGINT % 1000 < 500)::INT)::INT AS hits FROM g GROUP BY doc_id, n""")
def watermark_pairs(t: Tables):
    """The watermark whose green list hangs on the two tokens before."""
    words = written_table(doc_words(t).select("doc_id", "w"), "words")
    return E.watermark_test(words, "w", F.lit(10), k=2).select("doc_id", "n_gen", "hits")


@query("accuracy_named", f"""
WITH {ITEM_SQL}, a AS (SELECT model, CASE category WHEN 'cat1' THEN '{V.CATEGORY_NAMES["math"]}' WHEN 'cat2' THEN '{V.CATEGORY_NAMES["memory"]}' ELSE category END AS category,
 is_correct FROM rs)
SELECT model, category, round(count(*) FILTER (is_correct) / count(*) * 100.0::DOUBLE, 6) AS acc FROM a GROUP BY model, category
UNION ALL SELECT model, '{V.OVERALL_NAME}', round(count(*) FILTER (is_correct) / count(*) * 100.0::DOUBLE, 6) FROM a GROUP BY model""")
def accuracy_named(t: Tables):
    """Accuracy under display names; a category without one keeps its own."""
    known = results(t).withColumn("category", F.replace(F.replace("category", F.lit("cat1"), F.lit("math")), F.lit("cat2"), F.lit("memory")))
    return E.accuracy_extremes(known, names=V.CATEGORY_NAMES).select("model", "category", F.round("acc", 6).alias("acc"))


# ---- routing ---------------------------------------------------------------------------------------

ROUTE_SQL = UNIT_SQL + """,
rx AS (SELECT vec_id, (d - 1) // 4 AS layer, (d - 1) % 4 AS expert, exp(x) AS e FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e)),
rp AS (SELECT vec_id, layer, expert, e / sum(e) OVER (PARTITION BY vec_id, layer) AS p FROM rx),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id, layer ORDER BY p DESC, expert) - 1 AS slot FROM rp),
rt AS (SELECT vec_id AS token_pos, layer, slot, expert, p / sum(p) OVER (PARTITION BY vec_id, layer) AS weight FROM rk WHERE slot < 2)"""
LOAD_SQL = ROUTE_SQL + """,
ld AS (SELECT layer, expert, count(*) AS n FROM rk WHERE slot = 0 GROUP BY layer, expert),
lo AS (SELECT l AS layer, x AS expert, coalesce(n, 0) AS n FROM range(16) a(l) CROSS JOIN range(4) b(x) LEFT JOIN ld ON layer = l AND expert = x)"""


@query("route_topk", f"WITH {ROUTE_SQL} SELECT token_pos, layer::INT AS layer, slot::INT AS slot, expert::INT AS expert, round(weight, 6) AS weight FROM rt")
def route_topk(t: Tables):
    return E.route(t.embeddings, "vec_id", VEC, 16, 4, 2).withColumn("weight", F.round("weight", 6))


@query("routing_load", f"WITH {LOAD_SQL} SELECT layer::INT AS layer, expert::INT AS expert, n FROM lo")
def routing_load(t: Tables):
    return E.routing_load(E.route(t.embeddings, "vec_id", VEC, 16, 4, 1), 16, 4)


@query("routing_health", f"""
WITH {LOAD_SQL}, p AS (SELECT layer, expert, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY layer), 1) AS pct FROM lo),
m AS (SELECT *, round(max(abs(pct - 25)) OVER (PARTITION BY layer), 1) AS max_dev FROM p)
SELECT layer::INT AS layer, expert::INT AS expert, n, pct, max_dev, pct < 12.5 AS is_low,
 CASE WHEN max_dev > 30 THEN 'COLLAPSE' WHEN max_dev > 15 THEN 'SKEWED' ELSE 'OK' END AS status FROM m""")
def routing_health(t: Tables):
    return E.routing_health(E.routing_load(E.route(t.embeddings, "vec_id", VEC, 16, 4, 1), 16, 4), 4)


@query("balance_penalty", f"""
WITH {ROUTE_SQL}, f AS (SELECT layer, expert, count(*) AS n FROM rt GROUP BY layer, expert),
p AS (SELECT layer, expert, avg(p) AS mp, count(*) AS t FROM rp GROUP BY layer, expert)
SELECT layer::INT AS layer, round(0.04::DOUBLE * sum(coalesce(n, 0) / t * mp), 8) AS penalty FROM p LEFT JOIN f USING (layer, expert) GROUP BY layer""")
def balance_penalty(t: Tables):
    return E.balance_penalty(t.embeddings, "vec_id", VEC, 16, 4, 2).withColumn("penalty", F.round("penalty", 8))


@query("expert_top_tokens", f"""
WITH {ROUTE_SQL}, c AS (SELECT layer, expert, (token_pos * 7 % 61)::BIGINT AS token, count(*) AS n FROM rt GROUP BY ALL)
SELECT layer::INT AS layer, expert::INT AS expert, token, n, (row_number() OVER (PARTITION BY layer, expert ORDER BY n DESC, token))::INT AS rank
FROM c QUALIFY rank <= 15""")
def expert_top_tokens(t: Tables):
    routed = E.route(t.embeddings, "vec_id", VEC, 16, 4, 2)
    return E.expert_top_tokens(routed.withColumn("token", F.col("token_pos") * 7 % 61), "token")


# ---- enrichment -------------------------------------------------------------------------------------

PROMPT_SQL = f"""
SELECT (rank - 1) // 20 + 1 AS batch, count(*)::INT AS n_items,
 string_agg(printf('%d. %s (PageRank: %.6f)', (rank - 1) % 20 + 1, name, score), chr(10) ORDER BY rank) AS prompt FROM {RANKED_SQL} GROUP BY 1"""


@query("render_batches", PROMPT_SQL)
def render_batches(t: Tables):
    return EN.render_batches(ranked_customers(t))


def stub_client(prompt: str) -> str:
    """Offline client: answers every listed concept, fenced like a chatty service."""
    rows = []
    for line in prompt.split("\n"):
        name = line.split(". ", 1)[1].rsplit(" (PageRank: ", 1)[0]
        score = float(line.rsplit(": ", 1)[1].rstrip(")"))
        rows.append({"name": name, "name_cn": name.lower(), "explanation": f"about {name}", "pagerank": score})
    content = "```json\n" + json.dumps(rows) + "\n```"
    return json.dumps({"choices": [{"message": {"content": content}}]})


def picky_client(prompt: str) -> str:
    """Refuses every prompt that lists a name ending in 77."""
    if "77 (" in prompt:
        raise RuntimeError("refused")
    return stub_client(prompt)


@query("enrich_stub", f"""
SELECT (rank - 1) // 20 + 1 AS batch, name, lower(name) AS name_cn, 'about ' || name AS explanation, score AS pagerank FROM {RANKED_SQL}""")
def enrich_stub(t: Tables):
    rows, _ = EN.enrich(EN.render_batches(ranked_customers(t)), stub_client, wait=0.0)
    return rows


@query("parse_enrichment", """
SELECT c_custkey // 10 AS batch, c_name AS name, c_mktsegment AS name_cn, 'nation ' || c_nationkey AS explanation, c_acctbal AS pagerank FROM customer""")
def parse_enrichment(t: Tables):
    item = F.struct(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("name_cn"),
        F.format_string("nation %d", "c_nationkey").alias("explanation"), F.col("c_acctbal").alias("pagerank"),
    )
    grouped = t.customer.groupBy(F.floor(F.col("c_custkey") / 10).alias("batch")).agg(F.to_json(F.collect_list(item)).alias("rows"))
    wrapped = F.when(F.col("batch") % 2 == 0, F.col("rows")).otherwise(F.concat(F.lit('{"data": '), "rows", F.lit("}")))
    content = F.concat(F.lit("```json\n"), wrapped, F.lit("\n```"))
    message = F.struct(F.struct(content.alias("content")).alias("message"))
    response = F.to_json(F.struct(F.array(message).alias("choices")))
    return EN.parse_responses(grouped.select("batch", response.alias("response")))


@query("completion_rate", f"""
WITH b AS (SELECT (rank - 1) // 20 + 1 AS batch, bool_or(name LIKE '%77') AS refused FROM {RANKED_SQL} GROUP BY 1)
SELECT count(*) AS n_batches, count(*) FILTER (NOT refused) AS n_completed, round(count(*) FILTER (NOT refused) * 100.0::DOUBLE / count(*), 4) AS completed_pct FROM b""")
def completion_rate(t: Tables):
    batches = written_table(EN.render_batches(ranked_customers(t)), "batches")
    _, ledger = EN.enrich(batches, picky_client, wait=0.0)
    return EN.completion_rate(batches, ledger)


# ---- streaming ---------------------------------------------------------------------------------------

@query("stream_clean", f"""
SELECT CASE WHEN drop_reason IS NULL THEN 'clean' ELSE 'audit' END AS verdict, doc_id, drop_reason, md5(out) AS digest FROM ({STAGED_SQL})""")
def stream_clean(t: Tables):
    path = scratch_path(t.spark, "arriving")
    files, at_once = ST.arriving_files(t.documents)
    J.write_jsonl(t.documents.repartition(files), path, "doc_id", "text")
    arriving = ST.stream_jsonl(t.spark, path, "doc_id BIGINT, text STRING", max_files=at_once)
    gated = ST.stream_gate(arriving, lambda df: G.two_stage_gate(df, **GATE))
    table = ST.run_to_table(gated, "stream-clean", partition_by="verdict")
    return table.select("verdict", "doc_id", "drop_reason", F.md5("text").alias("digest"))


@query("stream_qa_log", QA_SQL)
def stream_qa_log(t: Tables):
    path = scratch_path(t.spark, "qa-arriving")
    J.write_jsonl(qa_log(t), path)
    pairs_in = J.qa_log_pairs(ST.stream_jsonl(t.spark, path, J.QA_LOG_SCHEMA))
    out = ST.run_to_table(pairs_in, "stream-qa")
    return out.withColumns({"output": F.md5("output"), "logged_at": F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss")})


def text_frames(t: Tables):
    """Conversation texts as numbered frames with a closing marker."""
    parts = F.concat(F.lit(".,"), F.col("text"))
    pieces = F.concat(F.regexp_extract_all(parts, F.lit(r"(?s)\S+\s*"), F.lit(0)), F.array(F.lit(FR.DONE)))
    return t.conversations.select("conv_id", "turn", F.posexplode(pieces).alias("seq", "frame"))


@query("assemble_frames", r"""
SELECT conv_id, turn, md5(regexp_replace('.,' || text, '^[\s!-/:-@\[-`{-~。？！，、：；]+', '')) AS answer,
 len(regexp_extract_all('.,' || text, '\S+\s*'))::INT AS n_frames, true AS is_done FROM conversations""")
def assemble_frames(t: Tables):
    out = FR.assemble_frames(text_frames(t), "conv_id", "turn")
    return out.select("conv_id", "turn", F.md5("answer").alias("answer"), "n_frames", "is_done")


@query("stream_counts", "SELECT event_type, user_id % 16 AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(t: Tables):
    path = scratch_path(t.spark, "events-arriving")
    files, at_once = ST.arriving_files(t.events)
    J.write_jsonl(t.events.select("event_type", (F.col("user_id") % 16).alias("bucket")).repartition(files), path)
    arriving = ST.stream_jsonl(t.spark, path, "event_type STRING, bucket BIGINT", max_files=at_once)
    return ST.run_totals(ST.running_totals(arriving, "event_type", "bucket"), "stream-counts")

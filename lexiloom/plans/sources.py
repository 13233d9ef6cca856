"""Scans, sinks, sampling, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import ordering as O
from ..operators import pairs as P
from ..operators import profile as R
from ..session import scratch_path
from ..sources import arrow_files as A
from ..sources import jsonl as J
from ..sources import logs as L
from ..sources import manifest as M
from .cleaning import PAIRS_SQL, STAGED_SQL, digest, digest_sql, pairs, staged
from .registry import Tables, query

MD5_8 = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


# ---- sources and sinks ---------------------------------------------------------------------

@query("scan_jsonl", digest_sql("text", "documents", "doc_id"))
def scan_jsonl(t: Tables):
    path = scratch_path(t.spark, "jsonl")
    J.write_jsonl(t.documents, path, "doc_id", "text")
    return digest(J.read_jsonl(t.spark, path, "doc_id BIGINT, text STRING, extra STRING"), F.col("text"), "doc_id")


DAMAGED = "CASE WHEN event_id % 10 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END"


def damaged_lines(t: Tables):
    cut = F.when(F.col("event_id") % 10 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return t.events.select("event_id", cut.alias("line"))


@query("quarantine_bad_json", f"""
SELECT event_id, line, CASE WHEN NOT json_valid(line) THEN 'invalid json' END AS problem
FROM (SELECT event_id, {DAMAGED} AS line FROM events)""")
def quarantine_bad_json(t: Tables):
    return J.quarantine(damaged_lines(t))


@query("drop_invalid_json", f"""
SELECT event_id, line FROM (SELECT event_id, {DAMAGED} AS line FROM events) WHERE json_valid(line)""")
def drop_invalid_json(t: Tables):
    return J.drop_invalid_json(damaged_lines(t))


@query("scan_json_array", f"""
SELECT conv_id, turn, md5(instruction) AS instruction, md5(output) AS output FROM {PAIRS_SQL} WHERE turn = 0""")
def scan_json_array(t: Tables):
    path = scratch_path(t.spark, "json-array")
    extra = F.when(F.col("turn") == 0, F.lit("")).otherwise(F.lit("context"))
    triples = pairs(t).withColumn("input", extra)
    triples.select(F.to_json(F.array(F.struct("*"))).alias("value")).write.text(path)
    schema = "conv_id BIGINT, turn BIGINT, instruction STRING, input STRING, output STRING"
    rows = P.without_context(J.read_json_array(t.spark, path, schema, whole_file=False))
    return rows.select("conv_id", "turn", F.md5("instruction").alias("instruction"), F.md5("output").alias("output"))


@query("scan_project", digest_sql("text", "documents", "doc_id", "text IS NOT NULL AND text <> ''"))
def scan_project(t: Tables):
    content = t.documents.select("doc_id", F.col("text").alias("content"))
    renamed = content.select("doc_id", F.col("content").alias("text"))
    return digest(renamed.filter("text is not null and text != ''"), F.col("text"), "doc_id")


@query("unnest_conversation", f"""
SELECT conv_id, turn, md5(instruction) AS instruction, md5(output) AS output FROM {PAIRS_SQL}""")
def unnest_conversation(t: Tables):
    nested = pairs(t).select(
        "conv_id", "turn",
        F.array(F.struct(F.col("instruction").alias("human"), F.col("output").alias("assistant"))).alias("conversation"),
    )
    return P.unnest_conversation(nested).select(
        "conv_id", "turn", F.md5("instruction").alias("instruction"), F.md5("output").alias("output")
    )


@query("feather_import", digest_sql("text", "documents", "doc_id"))
def feather_import(t: Tables):
    path = scratch_path(t.spark, "feather")
    A.write_feather(t.documents.select("doc_id", "text"), path)
    return digest(A.read_feather(t.spark, path, "doc_id BIGINT, text STRING"), F.col("text"), "doc_id")


LOSS_SQL = """(SELECT day(ts)::INT AS epoch, event_id::INT AS step, value AS loss FROM events)"""


def loss_log(t: Tables):
    return t.events.select(
        F.dayofmonth("ts").alias("epoch"), F.col("event_id").cast("int").alias("step"), F.col("value").alias("loss")
    )


@query("scan_loss_csv", f"""
SELECT epoch, max(step) AS last_step, count(*) AS n, round(avg(loss), 6) AS mean_loss FROM {LOSS_SQL} GROUP BY epoch""")
def scan_loss_csv(t: Tables):
    path = scratch_path(t.spark, "loss-csv")
    loss_log(t).write.csv(path)
    log = L.read_loss_log(t.spark, path)
    return R.epoch_summary(log).withColumn("mean_loss", F.round("mean_loss", 6))


@query("audit_split", f"""
SELECT CASE WHEN drop_reason IS NULL THEN 'clean' ELSE 'audit' END AS verdict, doc_id, drop_reason, md5(out) AS digest
FROM ({STAGED_SQL})""")
def audit_split(t: Tables):
    path = scratch_path(t.spark, "verdicts")
    L.write_verdicts(staged(t).select("doc_id", "text", "drop_reason"), path)
    written = t.spark.read.schema("doc_id BIGINT, text STRING, drop_reason STRING, verdict STRING").parquet(path)
    return written.select("verdict", "doc_id", "drop_reason", F.md5("text").alias("digest"))


@query("resume_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(t: Tables):
    return M.pending(t.documents.select("doc_id"), t.labels, "doc_id")


@query("data_fingerprint", """
SELECT n_rows, sha256(n_rows || ':' || h) AS data_fp FROM
 (SELECT count(*) AS n_rows FROM documents),
 (SELECT string_agg(h, ':' ORDER BY o, h) AS h FROM
   (SELECT md5('0:' || doc_id) AS o, sha256(text) AS h FROM documents ORDER BY o, h LIMIT 3))""")
def data_fingerprint(t: Tables):
    return M.data_fingerprint(t.documents, "doc_id", "text")


def qa_log(t: Tables):
    logged = F.expr("timestampadd(SECOND, conv_id * 60 + turn, TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    meta = F.struct(
        F.date_format(logged, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.format_string("10.0.0.%d", F.col("conv_id") % 250).alias("ip"),
        F.lit("causal").alias("engine"),
    )
    return pairs(t).select(
        F.concat(F.lit(" "), "instruction", F.lit("\n")).alias("input"), "output", meta.alias("meta")
    )


QA_SQL = f"""
SELECT trim(instruction, ' ' || chr(9) || chr(13) || chr(10)) AS instruction,
  md5(trim(output, ' ' || chr(9) || chr(13) || chr(10))) AS output,
  strftime(make_timestamp((1704067200 + conv_id * 60 + turn) * 1000000), '%Y-%m-%d %H:%M:%S') AS logged_at,
  '10.0.0.' || (conv_id % 250) AS ip, 'causal' AS engine FROM {PAIRS_SQL}"""


def qa_result(log):
    return J.qa_log_pairs(log).withColumns(
        {"output": F.md5("output"), "logged_at": F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss")}
    )


@query("qa_log_to_sft", QA_SQL)
def qa_log_to_sft(t: Tables):
    path = scratch_path(t.spark, "qa-log")
    J.write_jsonl(qa_log(t), path)
    return qa_result(J.read_jsonl(t.spark, path, J.QA_LOG_SCHEMA))


@query("parse_service_log", """
SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'PROMPT' END AS type, '10.0.0.' || (user_id % 16) AS ip,
  count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, sum(length(props) + 3)::BIGINT AS message_chars
FROM events GROUP BY ALL""")
def parse_service_log(t: Tables):
    path = scratch_path(t.spark, "service-log")
    kind = F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("PROMPT"))
    ip = F.format_string("10.0.0.%d", F.col("user_id") % 16)
    message = F.concat(F.lit("a\nb"), "props")
    t.events.select(L.render_log_line(F.col("ts"), kind, ip, message).alias("value")).write.text(path)
    parsed = L.parse_log(t.spark.read.text(path))
    return parsed.groupBy("type", "ip").agg(
        F.count(F.lit(1)).alias("n"),
        F.date_format(F.max("logged_at"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
        F.sum(F.length("message")).alias("message_chars"),
    )


# ---- loss log ---------------------------------------------------------------------------------

@query("loss_tail_mean", f"""
SELECT round(avg(loss), 6) AS tail_mean FROM (SELECT loss FROM {LOSS_SQL} ORDER BY epoch DESC, step DESC LIMIT 16)""")
def loss_tail_mean(t: Tables):
    return R.loss_tail_mean(loss_log(t), ["epoch", "step"]).select(F.round("tail_mean", 6).alias("tail_mean"))


def _moment(j: int, y: str = "") -> str:
    return f"sum(w * u ** {j} {y})"


@query("loss_smooth", f"""
WITH l AS (SELECT epoch, step::DOUBLE AS x, loss AS y FROM {LOSS_SQL}),
e AS (SELECT epoch, count(*) AS n, min(x) AS lo, max(x) AS hi, avg(y) AS mean, list(x) AS xs, least(count(*), greatest(4, floor(0.2 * count(*))::BIGINT)) AS k
  FROM l GROUP BY epoch),
g AS (SELECT *, CASE WHEN i = 100 THEN hi ELSE lo + i * ((hi - lo) / 100) END AS p FROM (SELECT *, unnest(range(0, 101)) AS i FROM e)),
h AS (SELECT epoch, n, mean, lo, hi, i, p, list_sort(list_transform(xs, lambda x: abs(x - g.p)))[k] AS reach FROM g),
m AS (SELECT epoch, i, (x - p) / reach AS u, (1 - abs((x - p) / reach) ** 3) ** 3 AS w, y FROM l JOIN h USING (epoch) WHERE abs(x - p) < reach),
s AS (SELECT epoch, i, {", ".join(f"{_moment(j)} AS s{j}" for j in range(5))}, {", ".join(f"{_moment(j, '* y')} AS t{j}" for j in range(3))} FROM m GROUP BY ALL),
d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det,
  t0 * (s2 * s4 - s3 * s3) - t1 * (s1 * s4 - s2 * s3) + t2 * (s1 * s3 - s2 * s2) AS top FROM h LEFT JOIN s USING (epoch, i)),
v AS (SELECT epoch, lo, (hi - lo) / 100 AS width, list(CASE WHEN n < 4 THEN mean ELSE coalesce(CASE WHEN det > 1e-9 * s0 ** 3 THEN top / det ELSE t0 / s0 END, mean) END ORDER BY i) AS v
  FROM d GROUP BY ALL),
o AS (SELECT *, CASE WHEN width > 0 THEN (x - lo) / width ELSE 0 END AS place FROM l JOIN v USING (epoch)),
q AS (SELECT *, least(floor(place)::BIGINT, 99) AS a FROM o)
SELECT epoch, x::INT AS step, y AS loss, round(v[a + 1] + (place - a) * (v[a + 2] - v[a + 1]), 6) AS smooth FROM q""")
def loss_smooth(t: Tables):
    curve = R.loss_smooth(loss_log(t))
    return curve.withColumns({"step": F.col("step").cast("int"), "smooth": F.round("smooth", 6)})


@query("masked_mean", """
SELECT event_type, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END) / nullif(sum(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END), 0), 6) AS masked_mean
FROM events GROUP BY event_type""")
def masked_mean(t: Tables):
    out = R.masked_mean(t.events, "value", F.col("value") > 50, by=["event_type"])
    return out.withColumn("masked_mean", F.round("masked_mean", 6))


@query("quantile_vector", """
SELECT unnest([0.25, 0.5, 0.75, 0.85, 0.95])::DOUBLE AS prob,
  unnest(list_transform(quantile_cont(value, [0.25, 0.5, 0.75, 0.85, 0.95]), lambda q: round(q, 6))) AS value FROM events""")
def quantile_vector(t: Tables):
    out = R.quantile_vector(t.events, "value", [0.25, 0.5, 0.75, 0.85, 0.95])
    return out.withColumn("value", F.round("value", 6))


@query("sketch_quantiles", """
SELECT unnest([0.25, 0.5, 0.75, 0.95])::DOUBLE AS prob, (SELECT count(value) FROM events) AS n_values, true AS within""")
def sketch_quantiles(t: Tables):
    """Sketches of the parts of the table, merged; ``within`` says that the rank is off by 0.02 at most."""
    parts = t.events.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(16)))
    answers = R.merged_quantiles(R.quantile_sketches(parts, "value", ["part"]), [0.25, 0.5, 0.75, 0.95])
    checks = []
    for prob, n, value in answers.select("prob", "n_values", "value").collect():  # four rows
        near = (F.count_if(F.col("value") < value) <= (prob + 0.02) * n) & (F.count_if(F.col("value") <= value) >= (prob - 0.02) * n)
        checks.append(F.struct(F.lit(prob).alias("prob"), F.lit(n).cast("long").alias("n_values"), near.alias("within")))
    return t.events.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))


# ---- order, sample, set operations ---------------------------------------------------------------

@query("topn", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 500""")
def topn(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return O.top_n(rows, "l_extendedprice", 500, "l_orderkey", "l_linenumber", "l_partkey")


@query("rank_slice", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 501 OFFSET 2999""")
def rank_slice(t: Tables):
    return O.rank_slice(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 3000, 3500, "o_orderkey")


@query("hash_sample", f"""
SELECT doc_id FROM documents WHERE {MD5_8.format("'7:' || doc_id")} / 4294967296.0::DOUBLE < 0.3""")
def hash_sample(t: Tables):
    return O.hash_sample(t.documents.select("doc_id"), 0.3, 7, "doc_id")


WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query("fixed_sample", f"""
SELECT doc_id, least(len(w), 512)::INT AS n_words, md5(array_to_string(w[1:512], ' ')) AS digest
FROM (SELECT doc_id, text, {WORDS_SQL} AS w FROM
  (SELECT * FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 400)) WHERE length(text) >= 10""")
def fixed_sample(t: Tables):
    rows = O.fixed_sample(t.documents.select("doc_id", "text"), 400, 11, "doc_id").filter(F.length("text") >= 10)
    cut = F.slice(T.words(F.col("text")), 1, 512)
    return rows.select("doc_id", F.size(cut).alias("n_words"), F.md5(F.array_join(cut, " ")).alias("digest"))


@query("seeded_shuffle", """
SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rank FROM documents""")
def seeded_shuffle(t: Tables):
    return O.seeded_shuffle(t.documents.select("doc_id"), 42, "doc_id")


@query("length_buckets", """
WITH b AS (SELECT length(text) AS len, (row_number() OVER (ORDER BY length(text), md5('0:' || doc_id), doc_id) - 1) // 16 AS batch FROM documents)
SELECT batch, count(*) AS n_rows, max(len)::INT AS max_len, (count(*) * max(len))::BIGINT AS padded_cells, sum(len)::BIGINT AS used_cells
FROM b GROUP BY batch""")
def length_buckets(t: Tables):
    sized = t.documents.select("doc_id", F.length("text").alias("n"))
    return O.padded_cost(O.length_batches(sized, F.col("n"), 16, "doc_id"))


@query("union_dedup", """
WITH u AS (SELECT 0 AS src, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
SELECT src, id, md5(text) AS digest FROM u
QUALIFY row_number() OVER (PARTITION BY text ORDER BY src, id) = 1""")
def union_dedup(t: Tables):
    docs = t.documents.select(F.lit(0).alias("src"), F.col("doc_id").alias("id"), "text")
    items = t.benchmark.select(F.lit(1).alias("src"), F.col("item_id").alias("id"), "text")
    return O.keep_first(docs.unionByName(items), "text", "src", "id").select("src", "id", F.md5("text").alias("digest"))


def trade_edges(t: Tables):
    parts = t.lineitem.select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst")
    )
    orders = t.orders.select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("dst")
    )
    return parts.unionByName(orders)


@query("distinct_nodes", """
SELECT DISTINCT node FROM (SELECT unnest(['p' || l_partkey, 's' || l_suppkey]) AS node FROM lineitem
UNION ALL SELECT unnest(['c' || o_custkey, 'o' || o_orderkey]) FROM orders)""")
def distinct_nodes(t: Tables):
    return O.distinct_endpoints(trade_edges(t).distinct())


@query("set_difference", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def set_difference(t: Tables):
    busy = t.lineitem.filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return O.not_in(t.part.select("p_partkey"), busy, "p_partkey")


RANKED_SQL = """(SELECT c_name AS name, c_acctbal AS score, row_number() OVER (ORDER BY c_acctbal DESC, c_name) AS rank
 FROM customer)"""


def ranked_customers(t: Tables):
    rows = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    return O.assign_batches(rows, [F.desc("score"), F.col("name")], V.PROMPT_BATCH, coarse=F.floor(-F.col("score") / 50))


@query("batch_assign", f"""
SELECT name, rank::INT AS rank, (rank - 1) // 20 + 1 AS batch, (rank - 1) // 200 + 1 AS batch_group FROM {RANKED_SQL}""")
def batch_assign(t: Tables):
    return ranked_customers(t).select("name", "rank", "batch", "batch_group")


@query("pending_batches", f"""
SELECT DISTINCT (rank - 1) // 20 + 1 AS batch FROM {RANKED_SQL}
WHERE batch NOT IN (SELECT n_nationkey * 2 FROM nation)""")
def pending_batches(t: Tables):
    done = t.nation.select((F.col("n_nationkey") * 2).cast("bigint").alias("batch"))
    return M.pending(ranked_customers(t).select("batch").distinct(), done, "batch")


QUOTA_SQL = """(SELECT lang AS category, substr(lang, 1, 2) AS code, count(*) AS n FROM documents GROUP BY lang)"""
BATCH_SQL = f"""(SELECT category, code, n, unnest(range(1, ceil(n / 50)::BIGINT + 1))::INT AS batch FROM {QUOTA_SQL})"""


def lang_quota(t: Tables):
    quota = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("count"))
    return quota.select(F.col("lang").alias("category"), F.substring("lang", 1, 2).alias("code"), "count")


@query("quota_plan", f"""
SELECT category, code, batch, n AS "count", least(50, n - (batch - 1) * 50)::INT AS n_items FROM {BATCH_SQL}""")
def quota_plan(t: Tables):
    return O.quota_batches(lang_quota(t), V.QUOTA_BATCH)


@query("quota_ids", f"""
SELECT category, batch, printf('%s_%04d', code, (batch - 1) * 50 + i) AS id FROM
 (SELECT *, unnest(range(1, least(50, n - (batch - 1) * 50) - batch % 3 + 1)) AS i FROM {BATCH_SQL})""")
def quota_ids(t: Tables):
    returned = O.quota_batches(lang_quota(t), V.QUOTA_BATCH).withColumn(
        "n_items", F.col("n_items") - F.col("batch") % 3
    )
    return O.quota_item_ids(returned, V.QUOTA_BATCH).select("category", "batch", "id")


@query("label_lookup", """
SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def label_lookup(t: Tables):
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")

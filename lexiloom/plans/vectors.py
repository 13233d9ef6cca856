"""Vector and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as AR
from ..functions.hashing import md5_int
from ..operators import gates as G
from ..operators import graph as GR
from ..operators import neighbours as NB
from ..operators import vectors as VE
from ..session import written_table
from .cleaning import lit
from .registry import Tables, query
from .tokens import WORDS, doc_words

VEC = "embedding"
D = "embedding::DOUBLE[]"
UNIT_SQL = f"""
e AS (SELECT vec_id, label, {D} AS v FROM embeddings),
u AS (SELECT vec_id, label, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e)"""
MEANS_SQL = UNIT_SQL + """,
pd AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e),
md AS (SELECT label, d, avg(x) AS x FROM pd GROUP BY label, d),
m0 AS (SELECT label, list(x ORDER BY d) AS v FROM md GROUP BY label),
m AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS c FROM m0)"""


def vector_count(t: Tables):
    """Number of vectors as a scalar subquery; words are hashed onto the whole vector table."""
    return t.embeddings.agg(F.count(F.lit(1)).alias("n")).scalar()


def label_means(t: Tables):
    return VE.mean_vectors(t.embeddings, ["label"], VEC)


@query("mean_pool", f"""
WITH w AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents),
tk AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM w),
x AS (SELECT doc_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d FROM tk JOIN embeddings USING (vec_id)),
a AS (SELECT doc_id, d, avg(x) AS x, count(*) AS n FROM x GROUP BY doc_id, d)
SELECT doc_id, max(n) AS n_tokens, round(sum(x * d), 6) AS checksum, round(max(x), 6) AS top FROM a GROUP BY doc_id""")
def mean_pool(t: Tables):
    words = doc_words(t).select("doc_id", "w", vector_count(t).alias("n"))
    tokens = words.select("doc_id", F.transform("w", lambda word: md5_int(word) % F.col("n")).alias("vec_id"))
    out = VE.mean_pool(tokens, t.embeddings.select("vec_id", VEC), "doc_id", "vec_id")
    weighted = AR.total(F.transform(VEC, lambda x, i: x * (i + 1)))
    return out.select("doc_id", "n_tokens", F.round(weighted, 6).alias("checksum"), F.round(F.array_max(VEC), 6).alias("top"))


@query("token_embed_lookup", f"""
WITH w AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents),
tk AS (SELECT ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) + 200 FROM embeddings) AS vec_id, count(*) AS n FROM w GROUP BY 1)
SELECT vec_id, n, round(embedding[1]::DOUBLE, 6) AS first_dim FROM tk LEFT JOIN embeddings USING (vec_id)""")
def token_embed_lookup(t: Tables):
    tokens = doc_words(t).select(F.explode("w").alias("word")).groupBy((md5_int(F.col("word")) % (vector_count(t) + 200)).alias("vec_id"))
    first = F.get(F.col(VEC), F.lit(0)).cast("double")
    table = t.embeddings.select("vec_id", F.round(first, 6).alias("first_dim"))
    return tokens.agg(F.count(F.lit(1)).alias("n")).join(table, "vec_id", "left").select("vec_id", "n", "first_dim")


@query("l2_normalize", f"""
WITH {UNIT_SQL} SELECT vec_id, round(list_dot_product(u, u), 6) AS norm2, round(u[1], 6) AS first_dim,
 round(list_sum(list_transform(u, lambda x, i: x * i)), 6) AS checksum FROM u""")
def l2_normalize(t: Tables):
    unit = t.embeddings.select("vec_id", AR.l2_normalize(VE.as_double(F.col(VEC))).alias("u"))
    return unit.select(
        "vec_id", F.round(AR.dot(F.col("u"), F.col("u")), 6).alias("norm2"), F.round(F.get("u", F.lit(0)), 6).alias("first_dim"),
        F.round(AR.total(F.transform("u", lambda x, i: x * (i + 1))), 6).alias("checksum"),
    )


@query("softmax_lse", f"""
WITH {UNIT_SQL}, s AS (SELECT vec_id, v, list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) AS lse FROM e)
SELECT vec_id, round(lse, 6) AS lse, round(exp(v[1] - lse), 6) AS p1, round(exp(list_max(v) - lse), 6) AS p_top,
 round(list_sum(list_transform(v, lambda x: exp(x - lse))), 6) AS total FROM s""")
def softmax_lse(t: Tables):
    v = VE.as_double(F.col(VEC))
    rows = t.embeddings.select("vec_id", AR.logsumexp(v).alias("lse"), AR.softmax(v).alias("p"))
    return rows.select(
        "vec_id", F.round("lse", 6).alias("lse"), F.round(F.get("p", F.lit(0)), 6).alias("p1"),
        F.round(F.array_max("p"), 6).alias("p_top"), F.round(AR.total(F.col("p")), 6).alias("total"),
    )


@query("semantic_filter", f"""
WITH {MEANS_SQL}, s AS (SELECT vec_id, max(list_dot_product(u, c)) AS sim FROM u, m GROUP BY vec_id)
SELECT vec_id, round(sim, 6) AS max_sim FROM s WHERE sim > 0.3""")
def semantic_filter(t: Tables):
    out = VE.semantic_filter(t.embeddings, label_means(t), VEC, "label", threshold=0.3)
    return out.select("vec_id", F.round("max_sim", 6).alias("max_sim"))


def contrasted(t: Tables):
    return VE.anchor_contrast(
        t.embeddings, label_means(t).filter("label < 5"), label_means(t).filter("label >= 5"), VEC
    )


CONTRAST_SQL = MEANS_SQL + """,
ca AS (SELECT d, avg(x) AS x FROM md WHERE label < 5 GROUP BY d), cb AS (SELECT d, avg(x) AS x FROM md WHERE label >= 5 GROUP BY d),
la AS (SELECT list(x ORDER BY d) AS v FROM ca), lb AS (SELECT list(x ORDER BY d) AS v FROM cb),
ct AS (SELECT vec_id, list_dot_product(u, la.v) / sqrt(list_dot_product(la.v, la.v)) AS sa,
  list_dot_product(u, lb.v) / sqrt(list_dot_product(lb.v, lb.v)) AS sb FROM u, la, lb)"""


@query("anchor_contrast", f"""
WITH {CONTRAST_SQL} SELECT vec_id, round(sa, 6) AS sim_wanted, round(sb, 6) AS sim_unwanted, round(sa - sb, 6) AS sim_diff FROM ct""")
def anchor_contrast(t: Tables):
    return contrasted(t).select("vec_id", *[F.round(c, 6).alias(c) for c in ("sim_wanted", "sim_unwanted", "sim_diff")])


KEEP = dict(whitelist="(?i)license", invalid="(?i)^(the|das)", entity="###", keywords="(?i)zu|qui")


@query("concept_keep_mask", f"""
WITH {CONTRAST_SQL}, j AS (SELECT doc_id, sa - sb AS diff, replace(text, '_', ' ') AS t FROM ct JOIN documents ON vec_id = doc_id),
q AS (SELECT quantile_cont(diff, 0.06) AS cut FROM j)
SELECT doc_id, ((NOT (regexp_matches(t, {lit(KEEP['invalid'])}) OR regexp_matches(t, '###')) AND (diff > cut OR regexp_matches(t, {lit(KEEP['keywords'])})))
 OR regexp_matches(t, {lit(KEEP['whitelist'])})) AS keep FROM j, q""")
def concept_keep_mask(t: Tables):
    named = contrasted(t).join(t.documents, F.col("vec_id") == F.col("doc_id"))
    return G.concept_keep_mask(named, "sim_diff", "text", **KEEP).select("doc_id", "keep")


KNN_SQL = UNIT_SQL + """,
pr AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.u, b.u) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id),
kn AS (SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM pr QUALIFY rank <= 20)"""


@query("knn_exact", f"WITH {KNN_SQL} SELECT src, dst, rank::INT AS rank, round(sim, 6) AS sim FROM kn")
def knn_exact(t: Tables):
    return VE.nearest_neighbours(t.embeddings, "vec_id", VEC).select("src", "dst", "rank", F.round("sim", 6).alias("sim"))


def cell_index(t: Tables):
    """All vectors by cell, and the query rows: every id divisible by 100."""
    units = written_table(NB.unit_rows(t.embeddings, "vec_id", VEC), "units")
    return NB.CellIndex(units, 20), units.filter("id % 100 = 0")


@query("knn_cells_all", f"WITH {KNN_SQL} SELECT src, dst, rank::INT AS rank, round(sim, 6) AS sim FROM kn WHERE src % 100 = 0")
def knn_cells_all(t: Tables):
    index, queries = cell_index(t)
    return index.search(queries, len(index.centres)).select("src", "dst", "rank", F.round("sim", 6).alias("sim"))


@query("knn_cells_recall", f"""WITH {KNN_SQL}
SELECT count(DISTINCT src) AS n_queries, count(*) AS n_true, true AS recall_reached, (SELECT count(*) FROM e) AS n_indexed FROM kn WHERE src % 100 = 0""")
def knn_cells_recall(t: Tables):
    """Whether the probed cells hold at least 0.9 of the true neighbours of the query rows."""
    index, queries = cell_index(t)
    near = index.search(queries, index.probes_for(0.95)).select("src", "dst", F.lit(True).alias("found"))
    true = index.search(queries, len(index.centres)).select("src", "dst")
    both = true.join(near, ["src", "dst"], "left")
    return both.agg(
        F.count_distinct("src").alias("n_queries"), F.count(F.lit(1)).alias("n_true"),
        (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"), F.lit(index.n).cast("long").alias("n_indexed"),
    )


def knn_edges(t: Tables):
    return written_table(VE.nearest_neighbours(t.embeddings, "vec_id", VEC), "knn").select("src", "dst", "sim")


PRUNE_SQL = KNN_SQL + ", pq AS (SELECT quantile_cont(sim, 0.2) AS cut FROM kn), pe AS (SELECT src, dst, sim FROM kn, pq WHERE sim >= cut)"


@query("prune_edges", f"WITH {PRUNE_SQL} SELECT src, dst, round(sim, 6) AS sim FROM pe")
def prune_edges(t: Tables):
    return GR.prune_edges(knn_edges(t)).select("src", "dst", F.round("sim", 6).alias("sim"))


def rank_sql(edges: str, steps: int) -> str:
    """Unrolled PageRank over a CTE (src, dst, w)."""
    parts = [
        f"lk AS MATERIALIZED (SELECT src, dst, sum(w) / sum(sum(w)) OVER (PARTITION BY src) AS share FROM {edges} GROUP BY src, dst)",
        "nd AS MATERIALIZED (SELECT node, max(o) = 0 AS dangling FROM (SELECT src AS node, 1 AS o FROM lk UNION ALL SELECT dst, 0 FROM lk) GROUP BY node)",
        "nn AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nd)",
        "r0 AS MATERIALIZED (SELECT node, dangling, 1 / n AS rank FROM nd, nn)",
    ]
    for i in range(1, steps + 1):
        p = f"r{i - 1}"
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT nd.node, nd.dangling, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(f, 0) + lost / n) AS rank FROM nd LEFT JOIN "
            f"(SELECT dst AS node, sum(rank * share) AS f FROM lk JOIN {p} ON src = {p}.node GROUP BY dst) x ON x.node = nd.node, nn, "
            f"(SELECT coalesce(sum(rank) FILTER (dangling), 0) AS lost FROM {p}) y)"
        )
    return ", ".join(parts)


@query("pagerank_weighted", f"""
WITH {PRUNE_SQL}, ed AS (SELECT src, dst, sim AS w FROM pe), {rank_sql('ed', 10)} SELECT node, round(rank, 8) AS rank FROM r10""")
def pagerank_weighted(t: Tables):
    edges = GR.prune_edges(knn_edges(t))
    return GR.pagerank(edges, iterations=10, weight="sim").select("node", F.round("rank", 8).alias("rank"))


TRADE_SQL = """ed AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, 1.0::DOUBLE AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 1.0::DOUBLE FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'c' || c_custkey, 1.0::DOUBLE FROM supplier JOIN customer ON s_suppkey = c_custkey)"""


def trade_graph(t: Tables):
    def node(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    bought = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        node("c", "o_custkey").alias("src"), node("p", "l_partkey").alias("dst")
    )
    supplied = t.lineitem.select(node("p", "l_partkey").alias("src"), node("s", "l_suppkey").alias("dst"))
    back = t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey")).select(
        node("s", "s_suppkey").alias("src"), node("c", "c_custkey").alias("dst")
    )
    return bought.unionByName(supplied).unionByName(back)


@query("pagerank", f"WITH {TRADE_SQL}, {rank_sql('ed', 10)} SELECT node, round(rank, 9) AS rank FROM r10")
def pagerank(t: Tables):
    return GR.pagerank(trade_graph(t), iterations=10).select("node", F.round("rank", 9).alias("rank"))


LINK_RULES = dict(extra="Glossary|List|ournal|onference|und", ignore_case=True)
LINKS_SQL = r"""
hr AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages),
tl AS (SELECT page_id AS src, regexp_replace(url_decode(regexp_extract(href, '/(.+)', 1)), '(?s)[#?].*', '') AS dst FROM hr
  WHERE contains(href, '/') AND NOT regexp_matches(href, 'wiki/(File|Category):')),
lnk AS (SELECT DISTINCT src, dst FROM tl WHERE dst <> '' AND NOT contains(dst, ':') AND NOT regexp_matches(dst, '(?i)(Glossary|List|ournal|onference|und)'))"""


def page_links(t: Tables):
    return GR.extract_links(
        t.pages, "page_id", "html", prefix="/", namespaces="wiki/(File|Category):", topic_rules=LINK_RULES
    )


@query("extract_links", f"WITH {LINKS_SQL} SELECT src, dst FROM lnk")
def extract_links(t: Tables):
    return page_links(t)


@query("topic_filter", f"""
WITH hr AS (SELECT DISTINCT substr(x, 2) AS topic FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS x FROM pages))
SELECT topic FROM hr WHERE topic <> '' AND NOT contains(topic, ':') AND NOT regexp_matches(topic, '(Glossary|List|ournal|onference|er)')""")
def topic_filter(t: Tables):
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(GR.HREF), F.lit(1)))
    topics = t.pages.select(hrefs.alias("h")).select(F.expr("substr(h, 2)").alias("topic")).distinct()
    return G.topic_filter(topics, extra="Glossary|List|ournal|onference|er", ignore_case=False)


GRAPH_SQL = LINKS_SQL + """,
g AS (SELECT 'p' || src AS src, 'w' || dst AS dst FROM lnk UNION SELECT 'w' || dst, 'p' || src FROM lnk)"""


def page_graph(t: Tables):
    links = page_links(t)
    page, word = F.concat(F.lit("p"), F.col("src").cast("string")), F.concat(F.lit("w"), F.col("dst"))
    return links.select(page.alias("src"), word.alias("dst")).unionByName(links.select(word.alias("src"), page.alias("dst")))


BFS_SQL = f"""
WITH RECURSIVE {GRAPH_SQL},
walk(node, depth) AS (SELECT 'p0', 1 UNION SELECT g.dst, depth + 1 FROM walk JOIN g ON g.src = node WHERE depth < 3),
lv AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
SELECT src, dst, depth::INT AS depth FROM lv JOIN g ON src = node"""


@query("bfs_expand", BFS_SQL)
def bfs_expand(t: Tables):
    graph = written_table(page_graph(t), "page-graph")
    seeds = graph.filter("src = 'p0'").select("src")
    return GR.bfs_edges(GR.bfs_expand(graph, seeds, max_depth=3), graph)


@query("bfs_resume", BFS_SQL)
def bfs_resume(t: Tables):
    graph = written_table(page_graph(t), "page-graph")
    first = written_table(GR.bfs_expand(graph, graph.filter("src = 'p0'").select("src"), max_depth=2), "bfs-levels")
    frontier = first.filter("depth = 2").select("src")
    next_seeds = GR.bfs_level(frontier, graph, first.select("src"))
    return GR.bfs_edges(GR.bfs_expand(graph, next_seeds, max_depth=3, visited=first, depth=3), graph)


@query("codebook_assign", f"""
WITH {MEANS_SQL}, s AS (SELECT vec_id, m.label AS code, list_dot_product(u, c) AS sim FROM u, m),
b AS (SELECT vec_id, code, sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, code) = 1)
SELECT vec_id, code, round(sim, 6) AS code_sim, count(*) OVER (PARTITION BY code) AS code_usage FROM b""")
def codebook_assign(t: Tables):
    out = VE.codebook_assign(t.embeddings, label_means(t), VEC, "label").select("vec_id", "code", F.round("code_sim", 6).alias("code_sim"))
    usage = out.groupBy("code").agg(F.count(F.lit(1)).alias("code_usage"))
    return out.join(usage, "code").select("vec_id", "code", "code_sim", "code_usage")


def signed(t: Tables):
    return t.embeddings.withColumn("sign", F.when(F.col("label") < 5, 1).otherwise(-1))


#: The covariance is squared until only its first axis is left of it: 14 squarings are 16384 power steps.
SQUARINGS = 14
PCA_SQL = UNIT_SQL + """,
c0 AS (SELECT generate_subscripts(v, 1) AS d, vec_id, label, unnest(v) AS x FROM e),
cm AS (SELECT d, avg(x) AS m FROM c0 GROUP BY d),
cx AS MATERIALIZED (SELECT vec_id, label, d, x - m AS x FROM c0 JOIN cm USING (d)),
a0 AS MATERIALIZED (SELECT a.d AS i, b.d AS j, sum(a.x * b.x) AS v FROM cx a JOIN cx b USING (vec_id) GROUP BY 1, 2)""" + "".join(f""",
q{k} AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a{k - 1} a JOIN a{k - 1} b ON a.j = b.i GROUP BY 1, 2),
a{k} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{k} WHERE i = j) AS v FROM q{k})""" for k in range(1, SQUARINGS + 1)) + f""",
col AS (SELECT i AS d, v FROM a{SQUARINGS} WHERE j = (SELECT i FROM a{SQUARINGS} WHERE i = j ORDER BY v DESC LIMIT 1)),
ax AS (SELECT d, v / sqrt((SELECT sum(v * v) FROM col)) AS v FROM col),
pr AS (SELECT vec_id, label, sum(x * v) AS score FROM cx JOIN ax USING (d) GROUP BY vec_id, label),
sg AS (SELECT CASE WHEN avg(score) FILTER (label < 5) < 0 THEN -1 ELSE 1 END AS s FROM pr)"""


@query("pca_direction", f"""
WITH {PCA_SQL}, r AS (SELECT vec_id, s * score AS score FROM pr, sg)
SELECT vec_id, round(score, 6) AS score, CASE WHEN score < -2 THEN 'high' WHEN score < 0 THEN 'low' ELSE 'normal' END AS risk FROM r""")
def pca_direction(t: Tables):
    direction, centre = VE.pca_direction(signed(t), "sign", VEC)
    scored = VE.direction_score(t.embeddings, direction, VEC, centre=centre)
    return scored.select("vec_id", F.round("score", 6).alias("score"), "risk")


DIRECTION_SQL = UNIT_SQL + """,
pd AS (SELECT label < 5 AS pos, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e),
dm AS (SELECT d, avg(x) FILTER (pos) - avg(x) FILTER (NOT pos) AS x FROM pd GROUP BY d),
dv AS (SELECT list(x ORDER BY d) AS v FROM dm),
ds AS (SELECT vec_id, list_dot_product(e.v, dv.v) / sqrt(list_dot_product(dv.v, dv.v)) * 10 AS score FROM e, dv),
dr AS (SELECT vec_id, score, CASE WHEN score < -2 THEN 'high' WHEN score < 0 THEN 'low' ELSE 'normal' END AS risk FROM ds)"""


def directed(t: Tables):
    direction = VE.difference_direction(signed(t), "sign", VEC)
    return VE.direction_score(t.embeddings, direction, VEC, scale=10.0)


@query("direction_score", f"WITH {DIRECTION_SQL} SELECT vec_id, round(score, 6) AS score, risk FROM dr")
def direction_score(t: Tables):
    return directed(t).select("vec_id", F.round("score", 6).alias("score"), "risk")


@query("contrastive_score", f"""
WITH {UNIT_SQL}, b AS (SELECT vec_id, label, vec_id // 64 AS batch, u, list_append(u[2:], u[1]) AS t FROM u),
s AS (SELECT a.batch, a.vec_id AS id, a.vec_id = b.vec_id AS own,
  CASE WHEN a.label = b.label AND a.vec_id <> b.vec_id THEN -100 ELSE list_dot_product(a.u, b.t) / 0.07 END AS sim
  FROM b a JOIN b ON a.batch = b.batch)
SELECT batch, id, round(max(sim) + ln(sum(exp(sim - mx))) - max(sim) FILTER (own), 6) AS loss
FROM (SELECT *, max(sim) OVER (PARTITION BY id) AS mx FROM s) GROUP BY batch, id""")
def contrastive_score(t: Tables):
    return VE.contrastive_score(t.embeddings, "vec_id", "label", VEC).select("batch", "id", F.round("loss", 6).alias("loss"))


@query("contrastive_unmasked", f"""
WITH {UNIT_SQL}, b AS (SELECT vec_id, vec_id // 64 AS batch, u, list_append(u[2:], u[1]) AS t FROM u),
s AS (SELECT a.batch, a.vec_id AS id, a.vec_id = b.vec_id AS own, list_dot_product(a.u, b.t) / 0.07 AS sim FROM b a JOIN b ON a.batch = b.batch)
SELECT batch, id, round(max(sim) + ln(sum(exp(sim - mx))) - max(sim) FILTER (own), 6) AS loss
FROM (SELECT *, max(sim) OVER (PARTITION BY id) AS mx FROM s) GROUP BY batch, id""")
def contrastive_unmasked(t: Tables):
    scored = VE.contrastive_score(t.embeddings, "vec_id", "label", VEC, mask_same_label=False)
    return scored.select("batch", "id", F.round("loss", 6).alias("loss"))


@query("embedding_collapse", f"""
WITH {UNIT_SQL}, x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e),
c AS (SELECT a.d AS i, b.d AS j, covar_samp(a.x, b.x) AS cv, var_pop(a.x) AS vp FROM x a JOIN x b USING (vec_id) GROUP BY a.d, b.d)
SELECT round(avg(greatest(1 - sqrt(vp + 1e-4), 0)) FILTER (i = j), 6) AS var_loss,
 round(sum(cv * cv) FILTER (i <> j) / count(*) FILTER (i = j), 8) AS cov_loss FROM c""")
def embedding_collapse(t: Tables):
    out = VE.embedding_collapse(t.embeddings, VEC)
    return out.select(F.round("var_loss", 6).alias("var_loss"), F.round("cov_loss", 8).alias("cov_loss"))

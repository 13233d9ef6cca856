"""Near-duplicate removal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as D
from ..session import spread
from .registry import Tables, query

SIG_SQL = r"""
docs AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
  WHERE length(trim(text)) >= 5),
grams AS (SELECT DISTINCT doc, ('0x' || substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 8))::BIGINT % 2147483647 AS h
  FROM (SELECT doc, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
fam AS (SELECT i, 1 + ('0x' || substr(md5('a:42:' || i), 1, 8))::BIGINT % 2147483646 AS a,
  ('0x' || substr(md5('b:42:' || i), 1, 8))::BIGINT % 2147483647 AS b FROM range(100) r(i)),
slots AS (SELECT doc, i, min((a * h + b) % 2147483647) AS v FROM grams, fam GROUP BY doc, i),
bandkeys AS (SELECT doc, i // 5 AS band, md5(string_agg(v::VARCHAR, '_' ORDER BY i)) AS key FROM slots GROUP BY doc, i // 5)"""


def signature_table(t: Tables):
    return D.signatures(spread(t.documents.select("doc_id", "text")), "doc_id")


@query("lsh_candidates", f"""
WITH {SIG_SQL}
SELECT band::INT AS band, key, count(*) AS n_docs, min(doc) AS first_doc, max(doc) AS last_doc
FROM bandkeys GROUP BY band, key HAVING count(*) > 1""")
def lsh_candidates(t: Tables):
    return D.collision_buckets(signature_table(t))


@query("minhash_dedup", f"""
WITH {SIG_SQL},
pairs AS (SELECT DISTINCT a.doc AS da, b.doc AS db FROM bandkeys a JOIN bandkeys b ON a.band = b.band AND a.key = b.key AND a.doc < b.doc),
gone AS (SELECT DISTINCT db FROM pairs JOIN slots x ON x.doc = da JOIN slots y ON y.doc = db AND y.i = x.i
  GROUP BY da, db HAVING count(*) FILTER (x.v = y.v) >= 80)
SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT db FROM gone)""")
def minhash_dedup(t: Tables):
    kept = D.drop_near_duplicates(spread(t.documents.select("doc_id", "text")), "doc_id")
    return kept.select("doc_id", F.md5("text").alias("digest"))

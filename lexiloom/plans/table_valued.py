"""Queries that call table-valued functions from SQL text."""

from __future__ import annotations

from ..functions.table_valued import register_tables
from .registry import Tables, query


@query("page_hrefs", """
SELECT page_id, unnest(range(1, len(l) + 1)) AS place, unnest(l) AS href
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""")
def page_hrefs(t: Tables):
    register_tables(t.spark)
    return t.spark.sql("SELECT * FROM page_hrefs(TABLE(SELECT page_id, html FROM {pages}))", pages=t.pages)


@query("cut_batches", """
SELECT doc_id AS id, (row_number() OVER w - 1) // 20 + 1 AS batch, (row_number() OVER w - 1) % 20 + 1 AS place
FROM documents WINDOW w AS (PARTITION BY lang, doc_id // 4096 ORDER BY doc_id)""")
def cut_batches(t: Tables):
    """Batches of 20 documents of a language; ranges of 4096 ids keep a common language out of one task."""
    register_tables(t.spark)
    rows = "SELECT doc_id AS id, lang, doc_id DIV 4096 AS part FROM {documents}"
    return t.spark.sql(f"SELECT * FROM cut_batches(TABLE({rows}) PARTITION BY (lang, part) ORDER BY (id), 20)", documents=t.documents)

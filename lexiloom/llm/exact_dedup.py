"""Exact duplicates by skew-safe combining.

Three stages, each comparing the whole content: every task folds its own copies, the folds of one
salted digest group are merged, and the salt winners of a digest are combined globally. A text that
fills a third of the table reaches the salted groups as one row per task and the global stage as one
row per salt. Documents then find their group by digest; the global stage has proved that a digest
stands for one content, and digests for which it has not are matched on digest and content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written_table
from .base import SPACE_RUN, query, table, text_or_empty


def squeeze_space(col: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(col, SPACE_RUN, " ")


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def content_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = squeeze_space,
    digest: Callable[[Column], Column] = sha256,
    salts: int = 32,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest.

    Texts are equal when their normalised forms are identical; null text counts as empty. The
    smallest id of a group stays. Rows that repeat an id with its text are copies of the same
    document: each is counted in group_size, and all of them are kept if the id is. A null id never
    wins against another id; a group of null ids has keep_id null and stays. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalise(text_or_empty(text_col)).alias("body"))
    rows = rows.withColumn("digest", digest(F.col("body")))
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "body")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    )
    contents = salted.groupBy("digest", "body").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    groups = written_table(
        contents.groupBy("digest").agg(
            F.count(F.lit(1)).alias("contents"), F.min("first").alias("keep_id"), F.sum("n").alias("group_size")
        ),
        "content-groups",
    )
    clashing = groups.filter("contents > 1").select("digest")
    sole = groups.filter("contents = 1").drop("contents")
    found = rows.select("id", "digest").join(sole, "digest")
    if clashing.head(1):
        shared = rows.join(clashing, "digest", "left_semi")
        apart = shared.groupBy("digest", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = found.unionByName(shared.join(apart, ["digest", "body"]).select(*found.columns))
    return found.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


@query(
    "op5_exact_dedup",
    r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d""",
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content_groups(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )

"""Shared helpers of the training-data operators and the registry of their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the data contracts define it: space, tab, line feed, vertical tab, form feed, return.
SPACE_RUN = r"[\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with an optional SQL twin."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: Column | str) -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def holds_at_most(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; stops counting there."""
    return df.limit(limit + 1).count() <= limit


def small_or_shuffled(df: DataFrame, limit: int) -> DataFrame:
    """``df`` marked for broadcast when a count proves it has at most ``limit`` rows.

    Beyond that it is returned unmarked and the join is a shuffled one.
    """
    return F.broadcast(df) if holds_at_most(df, limit) else df


def without_ids(docs: DataFrame, key: str, dropped: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in the one-column table ``dropped``.

    ``dropped`` should be a written table: it is counted, then joined. A row with a null key is kept.
    """
    (name,) = dropped.columns
    gone = small_or_shuffled(dropped.select(F.col(name).alias("__gone")), limit)
    return docs.join(gone, docs[key] == F.col("__gone"), "left_anti")

"""Resumable jobs: what is left to do, and whether a rerun still sees the same data."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import shuffle_key
from ..operators.ordering import not_in


def pending(df: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return not_in(df, done, *keys)


def data_fingerprint(df: DataFrame, key: str, text: str, probes: int = 3, seed: int = 0) -> DataFrame:
    """sha256 over the row count and a few probe rows in hash order."""
    order = shuffle_key(seed, F.col(key))
    probe = df.select(order.alias("o"), F.sha2(text, 256).alias("h")).orderBy("o", "h").limit(probes)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda s: s["h"]), ":")
    hashes = probe.agg(joined.alias("h")).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), hashes), 256).alias("data_fp")
    )


def config_mismatches(saved: DataFrame, current: DataFrame) -> DataFrame:
    """(name, value) tables side by side; rows that differ or exist on one side only."""
    old = saved.select("name", F.col("value").alias("saved"))
    new = current.select("name", F.col("value").alias("current"))
    differs: Column = ~F.col("saved").eqNullSafe(F.col("current"))
    return old.join(new, "name", "full_outer").filter(differs)


# ---- resumable chunks: <path>/data/chunk=k holds the rows, <path>/manifest one row per finished chunk

MANIFEST_SCHEMA = "chunk BIGINT, data_fp STRING, config STRING"


def chunk_path(path: str, chunk: int) -> str:
    return f"{path}/data/chunk={chunk}"


def _read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_chunk(df: DataFrame, path: str, chunk: int, data_fp: str, config: Mapping) -> None:
    """Write a chunk, then its manifest entry.

    The entry follows the commit of the data, so a chunk without one is unfinished; writing the
    chunk again replaces what an interrupted attempt left.
    """
    df.write.mode("overwrite").parquet(chunk_path(path, chunk))
    entry = [(chunk, data_fp, json.dumps(dict(config), sort_keys=True))]
    df.sparkSession.createDataFrame(entry, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def resume_point(spark: SparkSession, path: str, data_fp: str, config: Mapping) -> int:
    """The first chunk to write: the finished ones before it have no gap. Other data or settings are an error."""
    manifest = _read_if_there(spark, f"{path}/manifest", MANIFEST_SCHEMA)
    if manifest is None:
        return 0
    saved = json.dumps(dict(config), sort_keys=True)
    other = manifest.filter((F.col("data_fp") != data_fp) | (F.col("config") != saved)).head(1)
    if other:
        raise ValueError(f"chunk {other[0]['chunk']} was written from other data or settings: {other[0]['config']}")
    done = manifest.select("chunk").distinct()
    following = done.select((F.col("chunk") + 1).alias("chunk")).unionByName(spark.range(1).toDF("chunk"))
    return following.join(done, "chunk", "left_anti").agg(F.min("chunk")).first()[0]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of finished chunks only."""
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    done = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest").select("chunk").distinct()
    return rows.withColumn("chunk", F.col("chunk").cast("bigint")).join(done, "chunk", "left_semi")


def load_relations(spark: SparkSession, paths: Sequence[str], nested: str = "relations") -> DataFrame:
    """(src, dst) from the first of ``paths`` that exists and has rows; nested lists are flattened."""
    for path in paths:
        found = _read_if_there(spark, path)
        if found is None or not found.head(1):
            continue
        return (found.select(F.inline(nested)) if nested in found.columns else found).select("src", "dst")
    raise FileNotFoundError(f"no relations at any of {list(paths)}")

"""Structured Streaming forms of the ingest jobs; each equals its batch counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def arriving_files(table: DataFrame, triggers: int = 2) -> tuple[int, int]:
    """(files, files of a trigger): as many as ``table`` has splits, and enough for all cores in each trigger."""
    files = max(triggers * table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions())
    return files, -(-files // triggers)


def stream_jsonl(spark: SparkSession, path: str, schema: str, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def run_to_table(stream: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Process everything available now into an exactly-once parquet sink and return the table."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_gate(stream: DataFrame, gate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Clean/audit verdict on arriving rows; the gate is the batch operator itself."""
    verdict = F.when(F.col("drop_reason").isNull(), F.lit("clean")).otherwise(F.lit("audit"))
    return gate(stream).withColumn("verdict", verdict)


def running_totals(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def run_totals(counts: DataFrame, name: str) -> DataFrame:
    """Final state of a running aggregation after all available input.

    In update mode each batch holds only the changed keys, so what is written grows with the
    changes; the newest row per key is the running total.
    """
    spark = counts.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", state)
    query.trigger(availableNow=True).start().awaitTermination()
    keys = [c for c in counts.columns if c != "n"]
    return spark.read.parquet(f"{out}/batch_id=*").groupBy(*keys).agg(F.max_by("n", "batch_id").alias("n"))

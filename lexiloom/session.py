"""Session helpers: a tuned local session, durable checkpoints, shared scratch paths."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
}

#: Bytes of a batch that goes to a Python worker. The executor fills it in direct memory that doubles as it
#: grows, and the worker holds it beside all that it makes of it, so Spark's 64 MB count several times a core.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexiloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
    )
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local master, whose executors share the driver's disk, may fall back to a
    folder of its own. A cluster without the setting is an error, because a folder on
    one machine would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="lexiloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder for tables a job writes and re-reads."""
    return f"{checkpoint_root(spark).rstrip('/')}/lexiloom-{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str, group_mb: int | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and return a scan of it.

    Used where a result is read several times: the scan prunes columns, survives lost
    executors and gives the optimizer real sizes. Rows that hold whole documents as arrays should have
    small row groups: a reader decodes up to 4096 rows of a group at once, whatever they weigh.
    """
    path = scratch_path(df.sparkSession, name)
    sized = df.write if group_mb is None else df.write.option("parquet.block.size", group_mb << 20)
    sized.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written once in the shared folder, bucketed by ``key``, and a function that takes it out of the catalog.

    Joins on ``key`` read it without a shuffle. Unlike a checkpoint it keeps its layout under adaptive
    planning. ``df`` should come in ``buckets`` partitions by ``key``, which makes one file a bucket.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = f"lexiloom_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")

    return spark.table(table), drop


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer splits than cores; a large scan passes unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bound_batches(spark: SparkSession) -> bool:
    """Bound batches to ``BATCH_BYTES`` from now on; False where the session has a limit of its own, which stays."""
    if spark.conf.get(_BATCH_CONF, None) is not None:
        return False
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return True


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the batches of what runs inside; a frame that runs later takes the limit of that time."""
    bound = bound_batches(spark)
    try:
        yield
    finally:
        if bound:
            spark.conf.unset(_BATCH_CONF)

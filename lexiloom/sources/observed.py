"""Totals that are taken while a table is written, instead of a second pass over it."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Totals(NamedTuple):
    n_read: int
    n_kept: int
    n_dropped: int
    seconds: float
    rows_per_second: float


def write_gated(gated: DataFrame, path: str, reason: str = "drop_reason") -> Totals:
    """Write kept and dropped rows in one pass below ``path``, in folders kept=true and kept=false, and count them.

    A row is kept when its ``reason`` is null. ``path`` must not exist. The counts belong to the writing tasks
    themselves, so a task that is run again counts once. An empty table has totals of zero. A column ``kept``
    of the input is replaced.
    """
    counts = Observation()
    marked = gated.withColumn("kept", F.col(reason).isNull())
    marked = marked.observe(counts, F.count(F.lit(1)).alias("n_read"), F.count_if("kept").alias("n_kept"))
    started = time.monotonic()
    marked.write.partitionBy("kept").parquet(path)
    seconds = time.monotonic() - started
    n_read, n_kept = (counts.get.get(c) or 0 for c in ("n_read", "n_kept"))
    return Totals(n_read, n_kept, n_read - n_kept, seconds, n_read / seconds)

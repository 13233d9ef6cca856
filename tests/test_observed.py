"""Totals observed while writing against counts of what was written."""

from lexiloom.session import scratch_path
from lexiloom.sources.observed import write_gated


def test_totals_are_those_of_the_written_rows(spark):
    rows = [(i, None if i % 3 else "short", "extra") for i in range(100)] + [(None, None, None), (1, "", None)]
    gated = spark.createDataFrame(rows, "doc_id long, drop_reason string, n_read string").repartition(5)
    path = scratch_path(spark, "observed")
    totals = write_gated(gated, path)
    written = spark.read.parquet(path)
    assert totals[:3] == (102, written.filter("kept = 'true'").count(), written.filter("kept = 'false'").count()) == (102, 67, 35)
    assert totals.seconds > 0 and totals.rows_per_second > 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, drop_reason string")
    assert write_gated(empty, scratch_path(spark, "observed"))[:3] == (0, 0, 0)

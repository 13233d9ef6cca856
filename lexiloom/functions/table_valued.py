"""Table-valued functions for SQL text: one row in, many out, or ordered rows of a partition in.

Rows pass through Python one by one; where a column function says the same, that is the faster way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

HREF = re.compile('href="([^"]*)"')


@udtf(returnType="page_id bigint, place bigint, href string")
class PageHrefs:
    """``page_hrefs(TABLE(page_id, html))``: every href of a page with its place from 1; a null html has none."""

    def eval(self, row: Row) -> Iterator[tuple]:
        for place, href in enumerate(HREF.findall(row["html"] or ""), 1):
            yield row["page_id"], place, href


@udtf(returnType="id bigint, batch bigint, place bigint")
class CutBatches:
    """``cut_batches(TABLE(id, ...) PARTITION BY ... ORDER BY (...), size)``: batch and place of a row in its partition.

    Both count from 1. State is two numbers a partition, however many rows it has.
    """

    def __init__(self):
        self.batch, self.place = 1, 0

    def eval(self, row: Row, size: int) -> Iterator[tuple]:
        if self.place == size:
            self.batch, self.place = self.batch + 1, 0
        self.place += 1
        yield row["id"], self.batch, self.place


def register_tables(spark: SparkSession) -> None:
    """Make the functions known to SQL text of this session."""
    spark.udtf.register("page_hrefs", PageHrefs)
    spark.udtf.register("cut_batches", CutBatches)

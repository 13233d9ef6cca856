"""Approximate cosine neighbours by an inverted file of cells, searched exactly inside the cells a query probes.

Cell centres are learned from a bounded sample, every row lies in the cell of its nearest centre and is stored
once. A query looks at its nearest cells only; how many it takes for the recall asked for is
measured on a few queries. Large cells are cut into blocks, so a task multiplies bounded matrices.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as AR
from ..functions.hashing import shuffle_key
from ..session import written_table
from .vectors import as_double, top_k_block

#: Rows that centres are learned from, centres at most, rows of a block, queries that measure the recall.
SAMPLE, MOST_CELLS, BLOCK, MEASURED = 20_000, 4096, 16_384, 200


def unit_rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, unit); rows without a vector have no neighbours and are left out."""
    return df.filter(F.col(vec).isNotNull()).select(F.col(key).alias("id"), AR.l2_normalize(as_double(F.col(vec))).alias("unit"))


def learn_cells(units: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Unit centres by spherical k-means over ``sample`` rows at most, drawn by a hash of the id."""
    drawn = units.select("unit", shuffle_key(7, F.col("id")).alias("h")).orderBy("h").limit(sample).collect()
    rows = np.array([r["unit"] for r in drawn])
    centres = rows[:: max(1, len(rows) // cells)][:cells].copy()
    for _ in range(rounds if len(rows) else 0):
        nearest = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def _nearest_cells(centres: np.ndarray, probes: int):
    def nearest(units: pa.Array) -> pa.Array:
        if not len(units):
            return pa.array([], pa.list_(pa.int32()))
        rows = units.flatten().to_numpy(zero_copy_only=False).reshape(len(units), -1)
        order = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :probes]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * probes, pa.int32()), pa.array(order.ravel(), pa.int32()))

    return F.arrow_udf(nearest, "array<int>")


class CellIndex:
    """Rows of a table by cell; ``search`` returns the ``k`` best of the probed cells."""

    def __init__(self, units: DataFrame, k: int, cells: int | None = None, block: int = BLOCK):
        """``k`` is the largest number of neighbours a search may ask for.

        Of rows with one vector only the k + 1 smallest ids are stored: equal similarities go to the smaller
        id, so no answer can hold another one, and a vector that many rows share fills no cell.
        """
        self.k = k
        self.n = units.count()
        self.centres = learn_cells(units, cells or min(MOST_CELLS, max(1, ceil(sqrt(self.n)))))
        first = F.row_number().over(Window.partitionBy("unit").orderBy("id"))
        rows = units.withColumn("copy", first).filter(F.col("copy") <= k + 1)
        rows = rows.select("id", "unit", F.get(_nearest_cells(self.centres, 1)("unit"), F.lit(0)).alias("cell"))
        rows = written_table(rows, "cells")
        sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        self.sizes = written_table(sizes, "cell-sizes")  # a row per cell
        self.rows = rows.join(F.broadcast(self.sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))

    def search(self, queries: DataFrame, probes: int, k: int | None = None) -> DataFrame:
        """(src, dst, sim, rank) of the rows ``queries`` (id, unit) in their ``probes`` nearest cells, self excluded.

        Queries with one vector are searched once, for one neighbour more than asked for.
        """
        k = min(k or self.k, self.k)
        probes = min(probes, len(self.centres))
        asked = written_table(queries.groupBy("unit").agg(F.min("id").alias("asked")), "asked")
        placed = asked.select(F.col("asked").alias("id"), "unit", F.explode(_nearest_cells(self.centres, probes)("unit")).alias("cell"))
        placed = placed.join(F.broadcast(self.sizes), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"src": [], "dst": [], "sim": []})
            return top_k_block(left, right, k + 1, False)

        pairs = placed.select("id", "unit", "cell", "block").groupBy("cell", "block")
        held = self.rows.select("id", "unit", "cell", "block").groupBy("cell", "block")
        kind = queries.schema["id"].dataType.simpleString()
        found = pairs.cogroup(held).applyInPandas(best, f"src {kind}, dst {kind}, sim double")
        top = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
        found = found.withColumn("place", top).filter(F.col("place") <= k + 1).drop("place").withColumnRenamed("src", "asked")
        named = queries.join(asked, "unit").select(F.col("id").alias("src"), "asked").join(found, "asked").filter("src != dst")
        rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
        return named.select("src", "dst", "sim", rank.alias("rank")).filter(F.col("rank") <= k)

    def probes_for(self, recall: float, measured: int = MEASURED) -> int:
        """The fewest cells that hold ``recall`` of the true neighbours of ``measured`` rows drawn by a hash."""
        drawn = written_table(self.rows.select("id", "unit").orderBy(shuffle_key(11, F.col("id"))).limit(measured), "measured")
        true = self.search(drawn, len(self.centres)).join(self.rows.select(F.col("id").alias("dst"), "cell"), "dst")
        order = drawn.select(F.col("id").alias("src"), _nearest_cells(self.centres, len(self.centres))("unit").alias("order"))
        at = true.join(F.broadcast(order), "src").select(F.array_position("order", F.col("cell")).alias("at"))
        places = sorted(r["at"] for r in at.collect())  # at most measured * k numbers
        return int(places[min(len(places) - 1, ceil(recall * len(places)) - 1)]) if places else 1

"""Array and vector helpers on built-in higher-order functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda Spark evaluates an outer expression again for every element; bound as a
    lambda variable it is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """v / max(|v|, eps)."""
    return let(v, lambda u: let(F.greatest(norm(u), F.lit(eps)), lambda s: F.transform(u, lambda x: x / s)))


def _shifted_exp(v: Column, body) -> Column:
    """``body(top, exps)`` with top = max(v) and exps = exp(v - top)."""
    return let(
        v,
        lambda u: let(
            F.array_max(u), lambda top: let(F.transform(u, lambda x: F.exp(x - top)), lambda e: body(top, e))
        ),
    )


def logsumexp(v: Column) -> Column:
    return _shifted_exp(v, lambda top, e: top + F.log(total(e)))


def softmax(v: Column) -> Column:
    return _shifted_exp(v, lambda top, e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def pad_to(arr: Column, length: int, fill: Column) -> Column:
    """Truncate or right-pad an array to exactly ``length`` items."""
    missing = F.greatest(F.lit(length) - F.size(arr), F.lit(0))
    return F.concat(F.slice(arr, 1, length), F.array_repeat(fill, missing))


def ids_text(arr: Column) -> Column:
    """Array rendered as comma-separated text."""
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")


#: Items of lists, or characters, that a function over a batch is handed at once.
PIECE = 1 << 20


def list_parts(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 on and the values they point to, of a piece of a batch too."""
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.values.slice(offsets[0], offsets[-1] - offsets[0])


def pieces_of(column: pa.Array, items: int) -> list[tuple[int, int]]:
    """Row ranges (start, stop) with about ``items`` items each; a longer row is a range with its neighbours before it at most."""
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    lengths = pc.binary_length(column) if text else pc.list_value_length(column)
    ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.concatenate([[0], ends])[:-1]
    cuts = (np.flatnonzero(np.diff(starts // items)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(column)]))


def piecewise_udf(run: Callable[..., pa.Array], kind: str, items: int = PIECE):
    """Arrow UDF of ``run`` that handles a batch in pieces of about ``items`` items of its first column.

    Spark bounds the rows and the bytes of a batch as it comes; what a function makes of it may be
    many times as large. Pieces bound that in the worker and in the executor that reads it.
    """

    def handle(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for start, stop in pieces_of(columns[0], items):
                yield run(*[c.slice(start, stop - start) for c in columns])

    return F.arrow_udf(handle, kind, F.ArrowUDFType.SCALAR_ITER)


def _running_sums(lengths: pa.Array) -> pa.Array:
    offsets, values = list_parts(lengths)
    sums = np.concatenate([[0], np.cumsum(values.to_numpy(zero_copy_only=False), dtype=np.int64)])
    inside = sums[1:] - np.repeat(sums[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(inside, pa.int32()))


def running_sums(lengths: Column) -> Column:
    """Inclusive running sums inside each array, vectorised over pieces of a batch."""
    return piecewise_udf(_running_sums, "array<int>")(lengths)

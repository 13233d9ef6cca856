"""Hash draws that give the same value in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_int(value: Column, hex_digits: int = 8) -> Column:
    """First ``hex_digits`` of md5 as BIGINT (8 digits: 0 .. 2^32-1)."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, hex_digits), 16, 10).cast("bigint")


def keyed(seed: int | str, *keys: Column) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])


def uniform_draw(seed: int | str, *keys: Column) -> Column:
    """Reproducible uniform draw in [0, 1) keyed by (seed, keys)."""
    return md5_int(keyed(seed, *keys)) / F.lit(4294967296.0)


def shuffle_key(seed: int | str, *keys: Column) -> Column:
    return F.md5(keyed(seed, *keys))

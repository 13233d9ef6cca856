"""Instruction pairs: building them from other shapes and preparing them for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.hashing import uniform_draw


def turns_to_pairs(df: DataFrame) -> DataFrame:
    """Each ``user`` turn with the ``assistant`` turn right after it.

    An equi-join on (conversation, turn) rather than a window per conversation, so one very
    long conversation still spreads over all partitions.
    """
    asked = df.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("instruction")
    )
    answered = df.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return asked.join(answered, ["conv_id", "turn"])


def unnest_conversation(df: DataFrame, column: str = "conversation") -> DataFrame:
    """Array of (human, assistant) structs to one (instruction, output) row per element."""
    keys = [c for c in df.columns if c != column]
    return df.select(*keys, F.inline(column)).withColumnsRenamed(
        {"human": "instruction", "assistant": "output"}
    )


def align_pair_columns(df: DataFrame, instruction: str, output: str) -> DataFrame:
    return df.withColumnsRenamed({instruction: "instruction", output: "output"})


def without_context(df: DataFrame, column: str = "input") -> DataFrame:
    """Triples whose extra input is empty."""
    return df.filter(F.length(column) == 0)


def strip_trailing_punct(text: Column, pattern: str = V.TRAILING_PUNCT) -> Column:
    return T.remove(text, pattern)


def augment_ending(
    text: Column,
    draw: Column,
    question: str = "？",
    stop: str = "。",
    question_share: float = V.ENDING_QUESTION_SHARE,
    stop_share: float = V.ENDING_STOP_SHARE,
) -> Column:
    """Bare instruction plus a question mark, a full stop or nothing, chosen by ``draw``."""
    bare = strip_trailing_punct(text)
    mark = F.when(draw < question_share, F.lit(question)).when(draw < stop_share, F.lit(stop))
    return F.btrim(F.concat(bare, F.coalesce(mark, F.lit(""))), F.lit(" \t\r\n"))


def clean_pairs(df: DataFrame, *keys: str, seed: int = 42) -> DataFrame:
    """Reasoning and markdown out of the answer, varied endings on the instruction."""
    answer = F.btrim(T.strip_markdown(T.strip_reasoning(F.col("output"))), F.lit(" \t\r\n"))
    draw = uniform_draw(seed, *[F.col(k) for k in keys])
    return df.withColumns(
        {"output": answer, "instruction": augment_ending(F.col("instruction"), draw)}
    )

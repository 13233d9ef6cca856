"""Assembling token frames into full answers, in batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T

DONE = "[[DONE]]"


def assemble_frames(frames: DataFrame, *keys: str) -> DataFrame:
    """(keys, answer, n_frames, is_done) from (keys, seq, frame) rows; a group is one answer."""
    item = F.when(F.col("frame") != DONE, F.struct("seq", "frame"))
    grouped = frames.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("_f"), F.bool_or(F.col("frame") == DONE).alias("is_done")
    )
    joined = F.array_join(F.transform("_f", lambda s: s["frame"]), "")
    return grouped.select(*keys, T.strip_lead_punct(joined).alias("answer"), F.size("_f").alias("n_frames"), "is_done")


def assemble_stream(frames: DataFrame, timeout_ms: int | None = 60_000) -> DataFrame:
    """Stream of (request_id, seq, frame) to finished answers.

    State holds the frames of one open answer by number, so a replayed frame counts once; the done
    marker closes it once every earlier frame has arrived, a processing-time timeout closes it when
    the marker is lost. ``timeout_ms=None``
    is for bounded runs: a pending timeout would keep such a query alive.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, parts, last = state.get if state.exists else ([], [], -1)
        held = dict(zip(seqs, parts))
        if not state.hasTimedOut:
            for pdf in batches:
                for seq, frame in zip(pdf["seq"], pdf["frame"]):
                    if frame == DONE:
                        last = int(seq)
                    else:
                        held[int(seq)] = frame
        finished = last >= 0 and len(held) >= last
        if finished or state.hasTimedOut:
            state.remove()
            text = "".join(held[seq] for seq in sorted(held))
            yield pd.DataFrame({"request_id": [key[0]], "raw": [text], "n_frames": [len(held)], "is_done": [last >= 0]})
        else:
            state.update((list(held), list(held.values()), last))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    closed = frames.groupBy("request_id").applyInPandasWithState(
        step, "request_id string, raw string, n_frames int, is_done boolean",
        "seqs array<int>, parts array<string>, last int", "append", timeout,
    )
    return closed.select("request_id", T.strip_lead_punct(F.col("raw")).alias("answer"), "n_frames", "is_done")

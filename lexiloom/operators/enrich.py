"""External enrichment: prompts per batch, isolated calls with retries, parsing, re-drive ledger."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written_table

ENRICHED = "array<struct<name: string, name_cn: string, explanation: string, pagerank: double>>"
RESPONSE = "struct<choices: array<struct<message: struct<content: string>>>>"


def render_batches(ranked: DataFrame, batch: str = "batch", name: str = "name", score: str = "score", rank: str = "rank") -> DataFrame:
    """Numbered prompt list per batch; a batch is a fixed small number of rows."""
    item = F.struct(F.col(rank).alias("r"), F.col(name).alias("name"), F.col(score).alias("score"))
    listed = ranked.groupBy(batch).agg(F.array_sort(F.collect_list(item)).alias("items"))
    line = F.transform("items", lambda s, i: F.format_string("%d. %s (PageRank: %.6f)", i + 1, s["name"], s["score"]))
    return listed.select(batch, F.size("items").alias("n_items"), F.array_join(line, "\n").alias("prompt"))


def call_batches(
    batches: DataFrame, client: Callable[[str], str], tries: int = 3, wait: float = 5.0, in_flight: int = 10
) -> DataFrame:
    """(batch, response, attempts, error): each batch fails alone; waits grow with the attempt.

    ``client`` is any picklable function from prompt to response text. Calls overlap in threads
    inside a task, the number of partitions bounds the total.
    """

    def one(row: tuple[int, str]) -> dict:
        batch, prompt = row
        error = None
        for attempt in range(1, tries + 1):
            try:
                return {"batch": batch, "response": client(prompt), "attempts": attempt, "error": None}
            except Exception as e:  # a failed call must not lose the other batches
                error = f"{type(e).__name__}: {e}"
                if attempt < tries and wait:
                    time.sleep(wait * attempt)
        return {"batch": batch, "response": None, "attempts": tries, "error": error}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in frames:
                rows = list(pool.map(one, zip(pdf["batch"], pdf["prompt"])))
                yield pd.DataFrame(rows, columns=["batch", "response", "attempts", "error"])

    return batches.select("batch", "prompt").mapInPandas(run, "batch bigint, response string, attempts int, error string")


def response_rows(response: Column) -> Column:
    """Response text to an array of rows: message content, fences off, a wrapped list unwrapped."""
    message = F.from_json(response, RESPONSE)
    content = T.strip_fences(F.get(message["choices"], F.lit(0))["message"]["content"])
    unwrapped = F.when(content.startswith("{"), F.regexp_extract(content, r"(?s)\{\s*\"[^\"]*\"\s*:\s*(\[.*\])\s*\}", 1)).otherwise(content)
    return F.from_json(unwrapped, ENRICHED)


def parse_responses(responses: DataFrame) -> DataFrame:
    return responses.filter("response is not null").select("batch", F.inline(response_rows(F.col("response"))))


def enrich(
    batches: DataFrame, client: Callable[[str], str], rounds: int = 2, **call_options
) -> tuple[DataFrame, DataFrame]:
    """(rows, ledger): first pass plus at most ``rounds`` re-drives of the batches without rows.

    Every pass is written to the shared folder before the next one starts, so finished calls are
    never repeated after a failure.
    """
    results = []
    left = batches
    for attempt in range(rounds + 1):
        done = written_table(call_batches(left, client, **call_options).withColumn("round", F.lit(attempt)), "enrich-round")
        results.append(done)
        finished = done.filter(F.size(response_rows(F.col("response"))) > 0).select("batch")
        left = left.join(finished, "batch", "left_anti")
        if left.isEmpty():
            break
    ledger = results[0]
    for more in results[1:]:
        ledger = ledger.unionByName(more)
    ledger = ledger.withColumn("ok", F.coalesce(F.size(response_rows(F.col("response"))) > 0, F.lit(False)))
    return parse_responses(ledger.filter("ok")), ledger.select("batch", "round", "attempts", "error", "ok")


def completion_rate(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Planned and completed batches and the completed share."""
    done = ledger.filter("ok").select("batch").distinct().withColumn("done", F.lit(1))
    total, completed = F.count(F.lit(1)), F.count("done")
    return batches.select("batch").join(done, "batch", "left").agg(
        total.alias("n_batches"), completed.alias("n_completed"), F.round(F.try_divide(completed * 100.0, total), 4).alias("completed_pct")
    )

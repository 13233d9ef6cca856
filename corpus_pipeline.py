"""Corpus pipeline: toxicity, exact duplicates, near duplicates, benchmark leaks, then the mix.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The first four
return the columns of their input; the last adds the sampling weight and probability. Rows with a
null id pass the duplicate and leak stages, since a decision is tied to an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.base import table, without_ids
from lexiloom.llm.decontaminate import leaks
from lexiloom.llm.exact_dedup import content_groups
from lexiloom.llm.mixing import mix_to_targets
from lexiloom.llm.near_dups import near_duplicates
from lexiloom.llm.toxicity import toxicity_score, train
from lexiloom.session import bound_batches, bounded_batches, written_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below one half. They are scored when the result is read, so the session keeps the bound on batches."""
    bound_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity_score(model) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    groups = content_groups(docs)
    return without_ids(docs, "doc_id", written_table(groups.filter("NOT kept").select("id"), "copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, that with the smallest id."""
    found = near_duplicates(docs)
    return without_ids(docs, "doc_id", written_table(found.filter("NOT kept").select("id"), "near-copies"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, "doc_id", written_table(found.select("id").distinct(), "leaks"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample drawn by the calibrated probabilities, with columns weight and probability."""
    mixed = mix_to_targets(docs).filter("mix.sampled")
    return mixed.select(*docs.columns, F.col("mix.weight").alias("mix_weight"), F.col("mix.probability").alias("mix_probability"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix),
]
#: Learned scores and full-set links are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with bounded_batches(spark):
        for name, stage in STAGES:
            docs = written_table(stage(spark, docs, sf_dir), name)
    return docs

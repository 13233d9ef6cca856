"""Text service logs, loss logs and the two-way sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_LINE = r"^\[([^\]]*)\] \[(PROMPT|ERROR)\] \[IP: ([^\]]*)\] (.*)"
LOSS_SCHEMAS = {
    "plain": "epoch INT, step INT, loss DOUBLE",
    "contrastive": "epoch INT, iter INT, loss DOUBLE, contrastive DOUBLE, ce DOUBLE, lr DOUBLE",
    "weighted": "epoch INT, iter INT, loss DOUBLE, contrastive DOUBLE, ce DOUBLE, lr DOUBLE, ce_weight DOUBLE",
    "global": "epoch INT, iter INT, loss DOUBLE, contrastive DOUBLE, lr DOUBLE, global_step BIGINT",
}


def render_log_line(ts: Column, kind: Column, ip: Column, message: Column) -> Column:
    return F.format_string(
        "[%s] [%s] [IP: %s] %s",
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), kind, ip, F.replace(message, F.lit("\n"), F.lit(" ")),
    )


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    body = F.col(line)
    return lines.filter(body.rlike(LOG_LINE)).select(
        F.to_timestamp(F.regexp_extract(body, LOG_LINE, 1), "yyyy-MM-dd HH:mm:ss").alias("logged_at"),
        F.regexp_extract(body, LOG_LINE, 2).alias("type"),
        F.regexp_extract(body, LOG_LINE, 3).alias("ip"),
        F.regexp_extract(body, LOG_LINE, 4).alias("message"),
    )


def read_loss_log(spark: SparkSession, path: str, layout: str = "plain", header: bool = False) -> DataFrame:
    return spark.read.schema(LOSS_SCHEMAS[layout]).option("header", header).csv(path)


def write_verdicts(df: DataFrame, path: str, reason: str = "drop_reason") -> None:
    """Clean and audit rows in one pass, separated by a ``verdict`` partition."""
    verdict = F.when(F.col(reason).isNull(), F.lit("clean")).otherwise(F.lit("audit"))
    df.withColumn("verdict", verdict).write.mode("errorifexists").partitionBy("verdict").parquet(path)

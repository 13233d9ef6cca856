"""JSON-lines sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators.ordering import bucket_offsets

TEXT_SCHEMA = "text STRING"
QA_LOG_SCHEMA = "input STRING, output STRING, meta STRUCT<timestamp: STRING, ip: STRING, engine: STRING>"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Splittable scan with a fixed schema: absent fields are null, extra fields are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, *columns: str) -> None:
    df.select(*(columns or df.columns)).write.mode("errorifexists").json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str, whole_file: bool = True) -> DataFrame:
    """Array files. ``whole_file=False`` reads splittable files with one array per line."""
    return spark.read.schema(schema).option("multiLine", whole_file).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line): absolute 1-based numbers over the files in name order, as needed by an error log.

    Lines are numbered inside their file split, which a task reads in order; only one row per split
    goes through the prefix sum.
    """
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select(F.col("value").alias("line"), where.alias("at"), F.monotonically_increasing_id().alias("id"))
    totals = lines.groupBy("at.file", "at.start").agg(F.count(F.lit(1)).alias("n"))
    offsets = bucket_offsets(totals, "file", "start")
    inside = F.row_number().over(Window.partitionBy("at").orderBy("id"))
    numbered = lines.withColumn("inside", inside).select("line", "at.file", "at.start", "inside")
    return numbered.join(offsets, ["file", "start"]).select((F.col("bucket_offset") + F.col("inside")).cast("bigint").alias("line_no"), "line")


def json_problem(line: Column) -> Column:
    """Null for a valid JSON line, otherwise the cause."""
    body = F.btrim(line, F.lit(" \t\r\n"))
    return F.when(F.coalesce(body, F.lit("")) == "", F.lit("blank line")).when(
        F.try_parse_json(body).isNull(), F.lit("invalid json")
    )


def quarantine(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``problem``; only the damaged line is set aside, its neighbours go on."""
    return df.withColumn("problem", json_problem(F.col(line)))


def drop_invalid_json(df: DataFrame, line: str = "line") -> DataFrame:
    return df.filter(json_problem(F.col(line)).isNull())


def qa_log_pairs(log: DataFrame) -> DataFrame:
    """Question/answer service log as instruction pairs."""
    return log.select(
        F.btrim("input", F.lit(" \t\r\n")).alias("instruction"),
        F.btrim("output", F.lit(" \t\r\n")).alias("output"),
        F.to_timestamp("meta.timestamp", "yyyy-MM-dd HH:mm:ss").alias("logged_at"),
        F.col("meta.ip").alias("ip"),
        F.col("meta.engine").alias("engine"),
    )

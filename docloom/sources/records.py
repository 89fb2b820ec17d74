"""Sources and sinks of records: query logs (JSON lines), feedback (CSV) and golden questions (JSON)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_dir

LOG = "timestamp string, question string, answer string, elapsed_seconds double, error string, is_refusal boolean, num_retrieved int, top_k int, trace_id string"
FEEDBACK = "timestamp string, question string, answer string, rating int, reason string, message_id string"
GOLDEN = "id string, question string, category string, expected_doc string, difficulty string, expected_answer_keywords array<string>, gold_evidence struct<answerability:string,answer_bearing_chunk_ids:array<string>>"


def write_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """Entries of a log; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def recent(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.col("timestamp").desc()).limit(n)


def write_feedback(rows: DataFrame, path: str) -> None:
    rows.withColumn("reason", F.substring("reason", 1, 100)).write.mode("append").option("header", "true").option("escape", "\"").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def read_feedback(spark: SparkSession, path: str, schema: str = FEEDBACK) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def read_golden(spark: SparkSession, path: str, category: str | None = None, difficulty: str | None = None, schema: str = GOLDEN) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    for column, value in (("category", category), ("difficulty", difficulty)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows


def _path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/docloom-{label}-{uuid.uuid4().hex}"


def log_round_trip(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = _path(spark, "log")
    entries = rows.withColumn("is_refusal", F.lit(False))
    write_log(entries, path)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    return read_log(spark, path, "key struct<conv_id:long,turn:long>, question string, is_refusal boolean")


def feedback_round_trip(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = _path(spark, "feedback")
    write_feedback(rows, path)
    return read_feedback(spark, path, rows.select("id", "question", "rating", "reason").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


def golden_round_trip(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = _path(spark, "golden")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)

"""Stored message histories: one JSON list per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowline.operators.messages import history_load, history_save
from sparrowline.session import table_exists

HISTORY_SCHEMA = "session_id string, history string"


def write_histories(messages: DataFrame, path: str) -> None:
    """Store the histories of ``(session_id, seq, role, content, timestamp)``."""
    history_save(messages).write.mode("overwrite").parquet(path)


def read_histories(spark: SparkSession, path: str, base: int) -> DataFrame:
    """Messages of the stored histories; none when nothing is stored."""
    if table_exists(spark, path):
        stored = spark.read.parquet(path)
    else:
        stored = spark.createDataFrame([], HISTORY_SCHEMA)
    return history_load(stored, base)

"""NDJSON: one JSON value per line, in files or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparrowline.operators.events import parse_event_lines


def write_ndjson(lines: DataFrame, path: str, line: str = "line", mode: str = "overwrite") -> None:
    """Write each line once; the newline at its end comes from the text format."""
    lines.select(F.regexp_replace(line, r"\n\z", "").alias("value")).write.mode(mode).text(path)


def write_rows_ndjson(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write every row as one JSON object."""
    write_ndjson(rows.select(F.to_json(F.struct(*rows.columns)).alias("line")), path, mode=mode)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """``(line, payload)`` of the lines that parse; the others are skipped."""
    return parse_event_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def stream_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream over the files that arrive at ``path``."""
    return parse_event_lines(spark.readStream.text(path).withColumnRenamed("value", "line"))


def stream_to_ndjson(lines: DataFrame, path: str, checkpoint: str, line: str = "line") -> StreamingQuery:
    """Append a stream's lines to NDJSON files at ``path`` and run until the
    input that is there has been handled."""
    values = lines.select(F.regexp_replace(line, r"\n\z", "").alias("value"))
    return (
        values.writeStream.format("text")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )

"""The streaming forms, each fed from the tables' files until they are used up."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import chat_inputs as inputs
from catalog import client, events
from catalog.tables import table
from sparrowline.operators.messages import read_client_events
from sparrowline.session import materialise, work_path
from sparrowline.sources.ndjson import read_ndjson, stream_ndjson, stream_to_ndjson, write_ndjson
from sparrowline.streaming.debounce import stream_debounce
from sparrowline.streaming.events import append_table, stream_events
from sparrowline.streaming.lines import stream_lines
from sparrowline.streaming.messages import read_messages, save_messages
from sparrowline.streaming.run import append_live, drain

# How long a key waits for more. All input is there, so its two triggers follow at once, and a
# trigger's rows are looked at before the timers that have run out.
IDLE_MS = 1000
# A stored stream's files hold at most so many rows and come in about so many triggers.
FILE_ROWS = 200_000
TRIGGERS = 8


def as_stream(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Store rows as files and open them as a stream, in the order they were written.

    Four files make a trigger, more where there are many: triggers cost time each, and a trigger
    is no wider than its files, so it takes one for each core where that leaves two triggers."""
    path = work_path(spark, name)
    rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    cores = spark.sparkContext.defaultParallelism
    per_trigger = max(4, min(cores, math.ceil(files / 2)), math.ceil(files / TRIGGERS))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def in_order(spark: SparkSession, name: str, *parts: DataFrame) -> DataFrame:
    """A stream with one trigger for each part, the parts one after the other."""
    path, files = work_path(spark, name), 4
    for part in parts:
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream in append mode to its end; the rows it gave out."""
    out = work_path(spark, name)
    append_table(stream, out, work_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_until_empty(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream until its input and its state are used up; the rows it gave out."""
    out = work_path(spark, name)
    drain(append_live(stream, out, work_path(spark, f"{name}-checkpoint")))
    return spark.read.schema(stream.schema).parquet(out)


def stream_reassemble(spark, sf_dir):
    """Half of the chunks come first. Of every fifth document those come once more with the
    others, and every seventh document's stream never says that it has ended."""
    chunks = client.document_chunks(spark, sf_dir)
    chunks = chunks.withColumn("is_last", F.col("is_last") & (F.col("session_id") % 7 != 0))
    chunks = materialise(chunks.withColumn("_later", F.xxhash64("session_id", "seq") % 2 != 0), "chunks-of-halves")
    first, later = chunks.filter("NOT _later").drop("_later"), chunks.filter("_later").drop("_later")
    again = first.filter("session_id % 5 = 0")
    stream = in_order(spark, "chunks", first, later.unionByName(again))
    return run_until_empty(spark, stream_lines(stream, idle_ms=IDLE_MS), "lines")


def stream_saves(spark, sf_dir):
    """Debounced saves of the users' activity, in order of time. Nothing comes after it: the
    last burst of a user ends as no more updates arrive."""
    activity = client.activity(spark, sf_dir)
    middle = activity.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    early = F.unix_micros("ts") <= middle
    stream = in_order(spark, "activity", activity.filter(early), activity.filter(~early))
    saved = stream_debounce(stream, client.GAP_MS, delay_ms=60_000, idle_ms=IDLE_MS)
    return run_until_empty(spark, saved, "saves").withColumn("ts", F.unix_micros("ts"))


def stream_messages(spark, sf_dir):
    lines = as_stream(spark, inputs.client_lines(spark, sf_dir).repartition("seq"), "client-lines")
    out = work_path(spark, "messages")
    save_messages(read_client_events(lines), out, work_path(spark, "messages-checkpoint")).awaitTermination()
    messages = read_messages(spark, out)
    return client.message_text(messages).join(messages.select("session_id", "latest"), "session_id")


def stream_serialize(spark, sf_dir):
    rows = inputs.model_events(spark, sf_dir).join(inputs.requests(spark, sf_dir).drop("message"), "request_id")
    return events.line_parts(run(spark, stream_events(as_stream(spark, rows, "model-events")), "sent"))


def stream_ndjson_roundtrip(spark, sf_dir):
    """NDJSON files in, NDJSON files out, both as streams."""
    source, target = work_path(spark, "ndjson-in"), work_path(spark, "ndjson-out")
    write_ndjson(table(spark, sf_dir, "events").select(F.col("props").alias("line")), source)
    stream_to_ndjson(stream_ndjson(spark, source), target, work_path(spark, "ndjson-checkpoint")).awaitTermination()
    return read_ndjson(spark, target).select(F.variant_get("payload", "$.k", "bigint").alias("k"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_reassemble_lines": stream_reassemble,
    "stream_debounce": stream_saves,
    "stream_fold": stream_messages,
    "stream_events": stream_serialize,
    "stream_ndjson": stream_ndjson_roundtrip,
}

ORACLES = {
    "stream_reassemble_lines": client.SQL_LINES,
    "stream_debounce": client.SQL_DEBOUNCED,
    "stream_fold": client.SQL_MESSAGES,
    "stream_events": events.ORACLES["serialize_event"],
    "stream_ndjson": "SELECT (props->>'$.k')::BIGINT AS k FROM events",
}

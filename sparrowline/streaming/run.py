"""Running streams that keep state by key: the state store, and streams that come to an end."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Several states and timers per key need the RocksDB store."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(setting, None) != _PROVIDER:
        spark.conf.set(setting, _PROVIDER)


def append_live(rows: DataFrame, path: str, checkpoint: str, every: str = "0 seconds") -> StreamingQuery:
    """Append a stream's rows to a Parquet table, trigger after trigger, until it is stopped."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start(path)
    )


def kept_rows(query: StreamingQuery) -> int | None:
    """Rows of state after the last trigger; ``None`` while there is input that was not yet seen."""
    progress = query.lastProgress
    if not progress or progress["numInputRows"] or query.status["isDataAvailable"]:
        return None
    return sum(op["numRowsTotal"] for op in progress["stateOperators"])


def drain(query: StreamingQuery, seconds: float = 600.0) -> None:
    """Wait until the input that is there is used up and all state has run out, then stop.

    For streams whose timers end every key: triggers go on without input until the last timer
    has run out. Raises what ended the stream, or ``TimeoutError`` once triggers have ended
    without input and with the same number of rows for ``seconds``; a trigger may take as long
    as its rows need.
    """
    seen, before, since = None, None, time.monotonic()
    try:
        while (rows := kept_rows(query)) != 0:
            if not query.isActive:
                raise query.exception() or RuntimeError("the stream was stopped")
            progress = query.lastProgress
            trigger = progress and progress["timestamp"]
            if rows is None or rows != before:
                before, since = rows, time.monotonic()
            elif trigger != seen and time.monotonic() - since > seconds:
                raise TimeoutError(f"state after {seconds} seconds without a change: {rows} rows")
            seen = trigger
            time.sleep(0.05)
    finally:
        query.stop()

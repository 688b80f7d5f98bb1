"""Live pass-through of chat events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparrowline.operators.events import serialize_events


def stream_events(events: DataFrame) -> DataFrame:
    """Each event cleaned and passed on as it arrives; there is no state.

    ``events`` has ``line`` and ``include``.
    """
    return serialize_events(events)


def append_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to a Parquet table until the input that is there
    has been handled."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )

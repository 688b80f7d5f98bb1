"""The client's side of a response: byte chunks to messages to histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.operators.messages import (
    SEQ,
    SESSION,
    append_error,
    fold_messages,
    history_save,
    read_client_events,
    reassemble_lines,
)


def receive_messages(chunks: DataFrame, sessions: DataFrame, session: str = SESSION) -> DataFrame:
    """Assistant messages of the sessions' byte streams, errors included.

    ``chunks`` has ``(session, seq, data)``; ``sessions`` has ``timestamp``, the
    time of the reply, and ``status``.
    """
    lines = reassemble_lines(chunks, session).withColumnRenamed("line_no", SEQ)
    events = read_client_events(lines.join(sessions.select(session, F.col("timestamp").alias("at")), session))
    replies = (
        fold_messages(events, session)
        .join(sessions.select(session, "timestamp"), session)
        .withColumn("role", F.lit("assistant"))
    )
    return append_error(replies, sessions, session)


def store_histories(user_messages: DataFrame, replies: DataFrame, session: str = SESSION) -> DataFrame:
    """One JSON history per session from ``(session, seq, role, content,
    timestamp)`` rows of both sides, and the replies' ``events``."""
    columns = [session, SEQ, "role", "content", "timestamp"]
    sides = user_messages.select(*columns).unionByName(replies.select(*columns, "events"), allowMissingColumns=True)
    return history_save(sides, session)

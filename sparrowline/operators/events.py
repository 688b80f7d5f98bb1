"""Cleaning, filtering and serialising of chat events.

Events are rows with a JSON ``line``; ``include`` holds the request's include
list (null for all). Steps without state work on streams as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.functions import chat, jsonval
from sparrowline.functions.binding import with_computed
from sparrowline.operators.ordered import concat_ordered, fold_ordered

REQUEST = "request_id"
SEQ = "seq"


def parse_event_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``payload``; lines that are not exactly one JSON value, or are null,
    are skipped."""
    # As jsonval.parse_strict does, in two steps without lambdas, which Spark compiles.
    listed = with_computed(lines, _listed=jsonval.listed(F.col(line)))
    parsed = with_computed(listed, payload=jsonval.only_value(F.col("_listed"), F.col(line))).drop("_listed")
    return parsed.filter(F.col("payload").isNotNull() & ~F.is_variant_null("payload"))


def normalise_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``payload`` and ``name``; only JSON objects are events."""
    # A line that does not start as an object is dropped before it is parsed.
    objects = parse_event_lines(lines.filter(F.col(line).rlike(r"\A\s*\{")), line)
    named = with_computed(objects, _name=jsonval.field(F.col("payload"), "$.event"))
    return with_computed(named, name=jsonval.typed_string(F.col("_name"))).drop("_name")


def add_include(events: DataFrame, requests: DataFrame, key: str = REQUEST, how: str = "left") -> DataFrame:
    """Bring each request's include list to its events. A request with very
    many events is split by Spark's skew join."""
    return events.join(requests.select(key, "include"), key, how)


def filter_events(events: DataFrame) -> DataFrame:
    """Keep the events that their include list admits, by ``name``; model token
    streams follow the rule for tokens."""
    include = F.col("include")
    streams = F.coalesce(F.col("name").isin(*chat.STREAM_EVENTS), F.lit(False))
    return events.filter(
        F.when(streams, chat.token_allowed(include)).otherwise(chat.event_allowed(F.col("name"), include))
    )


def extract_tokens(events: DataFrame) -> DataFrame:
    """Add ``token``: the text carried by the event's data."""
    return chat.with_token(events, F.col("payload"))


def drop_empty_tokens(tokens: DataFrame, token: str = "token") -> DataFrame:
    return tokens.filter(F.length(token) > 0)


def prune_payload(events: DataFrame, line: str = "line") -> DataFrame:
    """Replace ``line`` by the same JSON without empty entries at any depth."""
    return events.withColumn(line, jsonval.prune(F.col(line)))


def serialize_events(events: DataFrame, line: str = "line") -> DataFrame:
    """The line to send for every event that passes its include list.

    Model token streams become token events and vanish without text; other
    events lose their empty entries. The filter on names comes first, so only
    admitted events reach the pruning step.
    """
    streams = F.coalesce(F.col("name").isin(*chat.STREAM_EVENTS), F.lit(False))
    kept = filter_events(normalise_events(events, line)).withColumn("_stream", streams)
    kept = chat.with_token(kept, F.when(F.col("_stream"), F.col("payload")))
    kept = kept.filter(~F.col("_stream") | (F.length("token") > 0))
    pruned = jsonval.prune(F.when(~F.col("_stream"), F.col(line)))
    return kept.withColumn(
        line,
        F.when(F.col("_stream"), chat.event_line(chat.TOKEN, F.col("token"))).otherwise(chat.ensure_newline(pruned)),
    ).drop("_stream", "payload", "name", "token")


def coerce_lines(texts: DataFrame, text: str = "text", out: str = "line") -> DataFrame:
    """Turn raw stream output into event lines."""
    return texts.withColumn(out, chat.to_event_line(F.col(text)))


def token_stream(lines: DataFrame, line: str = "line") -> DataFrame:
    """The plain tokens of a line stream: non-empty string data of token events."""
    events = normalise_events(lines, line).filter(F.col("name") == chat.TOKEN)
    data = jsonval.string_or_null(jsonval.field(F.col("payload"), "$.data"))
    return drop_empty_tokens(with_computed(events, token=data)).drop("payload", "name")


def concat_tokens(tokens: DataFrame, keys: Sequence[str] = (REQUEST,), order: str = SEQ, token: str = "token") -> DataFrame:
    """One ``text`` per request: its tokens joined without separators."""
    return concat_ordered(tokens, list(keys), order, token, "text")


def event_envelope(requests: DataFrame, tokens: DataFrame, key: str = REQUEST, seq: str = SEQ) -> DataFrame:
    """A response made of plain tokens: start event, tokens, end event.

    ``requests`` has ``(key, message, include)``, ``tokens`` ``(key, seq, token)``
    with ``seq`` from 0. Each part is subject to the include list. The end event
    carries the joined tokens, or the message when no token was sent. Returns
    ``(key, ord, text)``; tokens stay raw.
    """
    include = F.col("include")
    asked = requests.select(key, "message", "include")

    def event(name: str, field: str, value: Column) -> Column:
        return chat.event_line(name, F.struct(value.alias(field)))

    start = asked.filter(chat.event_allowed(F.lit(chat.START_EVENT), include)).select(
        key, F.lit(0).cast("bigint").alias("ord"), event(chat.START_EVENT, "input", F.col("message")).alias("text")
    )
    # One row per request admits its tokens: the message texts stay out of it.
    admitted = asked.filter(chat.fallback_token_allowed(include)).select(key)
    sent = drop_empty_tokens(tokens.select(key, seq, "token")).join(admitted, key, "left_semi")
    body = sent.select(key, (F.col(seq) + 1).cast("bigint").alias("ord"), F.col("token").alias("text"))
    joined = fold_ordered(sent, [key], seq, texts={"_output": ("token", "")}, last="_seq")
    end = (
        asked.filter(chat.event_allowed(F.lit(chat.END_EVENT), include))
        .join(joined, key, "left")
        .select(
            key,
            F.coalesce(F.col("_seq") + 2, F.lit(1)).cast("bigint").alias("ord"),
            event(chat.END_EVENT, "output", F.coalesce("_output", "message")).alias("text"),
        )
    )
    return start.unionByName(body).unionByName(end)


def event_fallback(emitted: DataFrame, requests: DataFrame, tokens: DataFrame, key: str = REQUEST, seq: str = SEQ) -> DataFrame:
    """Model events where a request has any, else the token envelope.

    ``emitted`` has ``(key, seq, line)``; returns ``(key, ord, text)``.
    """
    answered = emitted.select(key).distinct()
    waiting = requests.join(answered, key, "left_anti")
    # The envelope reads the tokens of the requests it is given only.
    envelope = event_envelope(waiting, tokens, key, seq)
    return emitted.select(key, F.col(seq).cast("bigint").alias("ord"), F.col("line").alias("text")).unionByName(envelope)

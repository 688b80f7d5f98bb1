"""Responses to chat requests, as event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.functions import chat
from sparrowline.operators.events import (
    REQUEST,
    SEQ,
    add_include,
    coerce_lines,
    concat_tokens,
    event_fallback,
    serialize_events,
    token_stream,
)
from sparrowline.operators.ordered import concat_ordered
from sparrowline.operators.requests import parse_include, parse_mode, tag_route, validate_requests
from sparrowline.session import materialise

PLAIN_TEXT, NDJSON = "text/plain", "application/x-ndjson"


def accept_requests(bodies: DataFrame, route: str = "/chat") -> DataFrame:
    """Validated requests with include list, mode and route tag.

    ``bodies`` has ``(request_id, body, include_arg)`` and, where modes are asked for, ``stream_arg``.
    """
    if "stream_arg" not in bodies.columns:
        bodies = bodies.withColumn("stream_arg", F.lit(None).cast("string"))
    return tag_route(parse_mode(parse_include(validate_requests(bodies))), route)


def respond(requests: DataFrame, events: DataFrame, tokens: DataFrame, key: str = REQUEST) -> DataFrame:
    """``(key, ord, line)`` for every accepted request: its model events, or its
    tokens in start and end events where no model event got through.

    ``events`` has ``(key, seq, line)``, ``tokens`` ``(key, seq, token)``.
    """
    # Both are needed several times: the requests for each part of an envelope,
    # the lines to send also to tell which requests have any.
    asked = materialise(requests.filter("ok").select(key, "message", "include"), "asked")
    included = add_include(events.select(key, SEQ, "line"), asked, key, how="inner")
    sent = materialise(serialize_events(included).select(key, SEQ, "line"), "sent")
    return coerce_lines(event_fallback(sent, asked, tokens, key)).drop("text")


def respond_tokens(responses: DataFrame, key: str = REQUEST) -> DataFrame:
    """The plain text of every response: token mode."""
    return concat_tokens(token_stream(responses), [key], "ord")


def deliver(responses: DataFrame, requests: DataFrame, key: str = REQUEST) -> DataFrame:
    """``(key, kind, text)``: the whole body sent for each accepted request, by its mode.

    Mode ``tokens`` sends the tokens as plain text, any other mode the event lines. A
    request whose response has neither gets an empty body.
    """
    modes = requests.filter("ok").select(key, (F.col("mode") == chat.TOKEN_MODE).alias("_plain"))
    sent = responses.join(modes, key)
    plain = respond_tokens(sent.filter("_plain"), key)
    lines = concat_ordered(sent.filter(~F.col("_plain")), [key], "ord", "line", "text")
    kind = F.when(F.col("_plain"), PLAIN_TEXT).otherwise(NDJSON)
    bodies = modes.join(plain.unionByName(lines), key, "left")
    return bodies.select(key, kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))

"""Column expressions over chat events held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.functions import jsonval
from sparrowline.functions.binding import let, with_computed
from sparrowline.functions.text import strip

# Event names, include-list names and messages of the protocol.
TOKEN = "token"
STREAM_EVENTS = ("on_chat_model_stream", "on_chat_token_stream")
ALL_EVENTS = ("all", "all_events")
START_EVENT = "on_chat_model_start"
END_EVENT = "on_chat_model_end"
UNNAMED_EVENT = "event"
INVALID_REQUEST = "Invalid request data"
EVENT_MODE, TOKEN_MODE = "events", "tokens"
CLIENT_ERROR = "Error contacting server."


def names(*values: str) -> Column:
    return F.array(*[F.lit(value) for value in values])


def filled(text: Column) -> Column:
    """Null in place of the empty string."""
    return F.nullif(text, F.lit(""))


# What a chunk and an event's data may hold, taken out in one cast; null if they are no objects.
_CHUNK = "struct<content:variant,text:variant,message:variant>"
_DATA = "struct<chunk:variant,token:variant>"
_TOKEN = "struct<text:variant,content:variant,value:variant>"
# Texts of values that may be false in a truth test; strings that look so are true.
_MAYBE_FALSY = r"\A(?:-?0|false\z|\[\]\z|\{\}\z|\z)"


def _if_truthy(text: Column, value: Column) -> Column:
    """``text``, which is the value's, if that is true in a truth test."""
    return F.when(~text.rlike(_MAYBE_FALSY) | jsonval.is_truthy(value), text)


def _truthy_text(value: Column) -> Column:
    """Text of a value that is true in a truth test; JSON is made only of those that may not be."""

    def text(value: Column) -> Column:
        return let(jsonval.plain_text(value), lambda t: _if_truthy(t, value))

    return F.when(value.isNotNull(), let(value, text))


def _filled_string(value: Column) -> Column:
    """A string that is not empty; null for any other value."""
    return let(jsonval.string_or_null(value), lambda text: F.when(text != "", text))


def _own_text(chunk: Column, parts: Column) -> Column:
    """Text of a chunk itself, whatever its ``message`` holds; null if none. ``parts`` is it as ``_CHUNK``."""
    of_object = F.coalesce(*[_truthy_text(parts[name]) for name in ("content", "text")])
    return F.when(parts.isNotNull(), of_object).when(chunk.isNotNull(), _filled_string(chunk))


def _message_text(message: Column) -> Column:
    """Text of a message, or of the first of the messages nested in it that has any.

    A message is nested no deeper than its name occurs in the schema.
    """
    name = "message"
    schema = F.schema_of_variant(message)
    names = (F.length(schema) - F.length(F.replace(schema, F.lit(name), F.lit("")))) / len(name)

    def state(value: Column) -> Column:
        def of_parts(parts: Column) -> Column:
            return F.struct(parts["message"].alias("inner"), _own_text(value, parts).alias("text"))

        return let(F.try_variant_get(value, "$", _CHUNK), of_parts)

    def step(found: Column, _: Column) -> Column:
        return F.when(found["text"].isNotNull() | found["inner"].isNull(), found).otherwise(let(found["inner"], state))

    return F.aggregate(F.sequence(F.lit(0), names.cast("int")), state(message), step, lambda found: found["text"])


def _chunk_text(chunk: Column) -> Column:
    """:func:`chunk_text`, null if there is none."""

    def nested(message: Column) -> Column:
        return F.when(message.isNotNull(), _message_text(message))

    def text(parts: Column) -> Column:
        return F.coalesce(_own_text(chunk, parts), let(parts["message"], nested))

    return let(F.try_variant_get(chunk, "$", _CHUNK), text)


def chunk_text(chunk: Column) -> Column:
    """Text carried by a model chunk: a string, or an object's ``content``, ``text`` or
    nested ``message``, whichever is first to hold something; messages may nest at will."""
    return F.coalesce(let(chunk, _chunk_text), F.lit(""))


def token_text(event: Column, path: str = "$.data") -> Column:
    """Token of a stream event's data, found at ``path``: its chunk's text, else
    its ``token``, given as a string or as an object with ``text``, ``content``
    or ``value``; the empty string if there is none."""

    def own_text(token: Column) -> Column:
        inner = [_filled_string(jsonval.field(token, f"$.{name}")) for name in ("text", "content", "value")]
        return F.when(token.isNotNull(), F.coalesce(jsonval.string_or_null(token), *inner))

    def text(data: Column) -> Column:
        chunk = let(data["chunk"], lambda chunk: F.when(chunk.isNotNull(), _chunk_text(chunk)))
        return F.coalesce(let(chunk, filled), let(data["token"], own_text))

    return F.coalesce(let(F.try_variant_get(event, path, _DATA), text), F.lit(""))


def with_token(events: DataFrame, event: Column) -> DataFrame:
    """Add ``token``: :func:`token_text` of every event.

    Every step is a column of its own, made where the steps before found nothing: Spark
    compiles steps without lambdas, and only nested messages need these.
    """
    col, kept = F.col, [name for name in events.columns if name != "token"]
    chunk, parts, token, inner = col("_data.chunk"), col("_parts"), col("_data.token"), col("_inner")
    found = with_computed(events, _data=F.try_variant_get(event, "$.data", _DATA))
    found = with_computed(found, _parts=F.when(chunk.isNotNull(), F.try_variant_get(chunk, "$", _CHUNK)))
    found = with_computed(
        found,
        _string=F.when(parts.isNull() & chunk.isNotNull(), jsonval.typed_string(chunk)),
        _content=F.when(parts.isNotNull(), jsonval.plain_text(col("_parts.content"))),
    )
    first = F.coalesce(filled(col("_string")), _if_truthy(col("_content"), col("_parts.content")))
    found = with_computed(found, _first=first)
    text = F.when(col("_first").isNull() & parts.isNotNull(), jsonval.plain_text(col("_parts.text")))
    found = with_computed(found, _text=text)
    found = with_computed(found, _own=F.coalesce("_first", _if_truthy(col("_text"), col("_parts.text"))))
    nested = F.when(col("_own").isNull() & col("_parts.message").isNotNull(), _message_text(col("_parts.message")))
    found = with_computed(found, _nested=nested)
    found = with_computed(found, _chunk=F.coalesce("_own", filled(col("_nested"))))
    asked = col("_chunk").isNull() & token.isNotNull()
    found = with_computed(found, _inner=F.when(asked, F.try_variant_get(token, "$", _TOKEN)))
    # An object is no string: it is looked at by its parts.
    own = F.when(asked & inner.isNull(), jsonval.typed_string(token))
    strings = [F.when(inner.isNotNull(), jsonval.typed_string(col(f"_inner.{name}"))) for name in ("text", "content", "value")]
    found = with_computed(found, _token=own, **{f"_in{i}": string for i, string in enumerate(strings)})
    filled_inner = [filled(col(f"_in{i}")) for i in range(len(strings))]
    return found.select(*kept, F.coalesce("_chunk", "_token", *filled_inner, F.lit("")).alias("token"))


def filter_active(include: Column) -> Column:
    """An absent or empty include list lets everything through."""
    return F.coalesce(F.size(include) > 0, F.lit(False))


def event_allowed(name: Column, include: Column) -> Column:
    """Rule for events other than token streams; unnamed events fail a filter."""
    return (
        ~filter_active(include)
        | F.arrays_overlap(include, names(*ALL_EVENTS))
        | F.coalesce(F.array_contains(include, name), F.lit(False))
    )


def token_allowed(include: Column) -> Column:
    """Rule for token-stream events that came from a model."""
    return ~filter_active(include) | F.arrays_overlap(include, names(*STREAM_EVENTS, TOKEN, *ALL_EVENTS))


def fallback_token_allowed(include: Column) -> Column:
    """Rule for plain tokens of the fallback; ``all`` does not admit them."""
    return ~filter_active(include) | F.arrays_overlap(include, names(*STREAM_EVENTS, TOKEN))


def parse_include(argument: Column) -> Column:
    """Sorted distinct names of a comma list, ``token`` added; null for none."""
    listed = F.filter(F.transform(F.split(F.coalesce(argument, F.lit("")), ","), lambda name: strip(name)), lambda name: name != "")
    return F.when(F.size(listed) > 0, F.sort_array(F.array_distinct(F.array_append(listed, F.lit(TOKEN)))))


def event_line(event: Column | str, data: Column) -> Column:
    """JSON line ``{"event": .., "data": ..}``."""
    event = F.lit(event) if isinstance(event, str) else event
    return F.concat(F.to_json(F.struct(event.alias("event"), data.alias("data"))), F.lit("\n"))


def ensure_newline(line: Column) -> Column:
    return F.when(line.endswith("\n"), line).otherwise(F.concat(line, F.lit("\n")))


def to_event_line(text: Column) -> Column:
    """Text that looks like an object passes as it is; anything else becomes a
    token event without its trailing newlines."""
    # A line already; only other texts are stripped.
    line = text.startswith("{") & text.endswith("}\n")
    object_like = let(strip(text), lambda bare: bare.startswith("{") & bare.endswith("}"))
    return (
        F.when(line, text)
        .when(object_like, ensure_newline(text))
        .otherwise(event_line(TOKEN, F.regexp_replace(text, r"\n+\z", "")))
    )


def data_json(event: Column) -> Column:
    """The event's data as compact JSON, ``null`` when absent; keys are sorted."""
    return F.coalesce(F.to_json(jsonval.field(event, "$.data")), F.lit("null"))


def summary(data: Column, text: Column) -> Column:
    """A string as it is, null as the empty string, else compact JSON. ``text``
    is the data when it is a string."""
    return F.coalesce(text, F.nullif(data, F.lit("null")), F.lit(""))


def event_name(value: Column) -> Column:
    """The event's name as a string, null when it is missing or of another type."""
    return jsonval.string_or_null(jsonval.field(value, "$.event"))

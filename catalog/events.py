"""Requests, event cleaning and event responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import chat_inputs as inputs
from catalog.chat_inputs import SQL_MODEL_EVENTS, SQL_REQUESTS, SQL_TOKENS, SQL_TURNS
from catalog.tables import sql_strip, table
from sparrowline.functions import chat, jsonval
from sparrowline.functions.binding import with_computed
from sparrowline.functions.text import REQUEST_SPACE, WORD_SPACE, char_class
from sparrowline.operators import events as ops
from sparrowline.operators import requests as request_ops
from sparrowline.plans import chat as plan
from sparrowline.session import materialise, work_path
from sparrowline.sources import ndjson

# Request bodies: each role's and event type's way to wrap a text. Only the
# first three hold a message.
BODY_FORMS = {
    "user": ('{"message":', "}"),
    "assistant": (' {"message":"  ', '\\n\\u00a0","extra":[1]} '),
    "system": ('{"message":"","message":', "}"),
    "click": ('{"text":', "}"),
    "view": ('{"message":', "}"),
    "error": ('{"message":"', ""),
    "purchase": ("null", ""),
    "signup": ('{"message":" \\t"}', ""),
}


def _body(kind, text):
    forms = [F.when(kind == name, F.concat(F.lit(a), text if b else F.lit(""), F.lit(b))) for name, (a, b) in BODY_FORMS.items()]
    return F.coalesce(*forms)


def bodies(spark, sf_dir) -> DataFrame:
    """Bodies with and without a message, from all turns and all events."""
    quoted = F.when(F.col("role") == "assistant", F.col("request_id")).otherwise(inputs.json_text(F.col("text")))
    good = inputs.turns(spark, sf_dir).select("request_id", _body(F.col("role"), quoted).alias("body"))
    number = F.col("value").cast("string")
    other = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.col("event_id")).alias("request_id"), _body(F.col("event_type"), number).alias("body")
    )
    return good.unionByName(other)


def validate_requests(spark, sf_dir):
    return request_ops.validate_requests(bodies(spark, sf_dir)).drop("body")


def include_arguments(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    argument = (
        F.when(kind == "click", F.lit(""))
        .when(kind == "view", F.lit(" , ,"))
        .when(kind == "error", kind)
        .otherwise(F.concat(F.lit(" "), kind, F.lit(",,zeta ,é,"), kind, F.lit("\n, token,")))
    )
    return table(spark, sf_dir, "events").select("event_id", argument.alias("include_arg"))


def parse_include(spark, sf_dir):
    parsed = request_ops.parse_include(include_arguments(spark, sf_dir))
    return parsed.select("event_id", F.array_join("include", "|").alias("include"))


def tag_route(spark, sf_dir):
    tagged = request_ops.tag_route(inputs.requests(spark, sf_dir))
    return tagged.select("request_id", F.col("metadata")["route"].alias("route"))


def events(spark, sf_dir) -> DataFrame:
    return ops.normalise_events(inputs.model_events(spark, sf_dir))


def with_include(spark, sf_dir, df: DataFrame) -> DataFrame:
    return ops.add_include(df, inputs.requests(spark, sf_dir))


def normalise_event(spark, sf_dir):
    return events(spark, sf_dir).select("request_id", "seq", "name")


def filter_events(spark, sf_dir):
    return ops.filter_events(with_include(spark, sf_dir, events(spark, sf_dir))).select("request_id", "seq", "name")


def chunk_to_text(spark, sf_dir):
    chunk = jsonval.field(F.col("payload"), "$.data.chunk")
    return events(spark, sf_dir).select("request_id", "seq", chat.chunk_text(chunk).alias("text"))


def extract_token(spark, sf_dir):
    return ops.extract_tokens(events(spark, sf_dir)).select("request_id", "seq", "token")


def drop_empty_tokens(spark, sf_dir):
    return ops.drop_empty_tokens(extract_token(spark, sf_dir))


def is_empty(spark, sf_dir):
    """Emptiness of the events' parts: missing, lists, strings and objects."""
    payload = F.col("payload")
    return events(spark, sf_dir).select(
        "request_id",
        "seq",
        jsonval.is_empty(jsonval.field(payload, "$.tags")).alias("tags_empty"),
        jsonval.is_empty(jsonval.field(payload, "$.data.chunk")).alias("chunk_empty"),
        jsonval.is_empty(jsonval.field(payload, "$.data.chunk.content")).alias("content_empty"),
        jsonval.is_empty(jsonval.field(payload, "$.data.meta.n")).alias("n_empty"),
        jsonval.is_empty(jsonval.field(payload, "$.data")).alias("data_empty"),
    )


def line_parts(lines: DataFrame) -> DataFrame:
    """Parts of event lines that hold a map, as text."""
    listed = with_computed(lines.select("request_id", "seq", "line"), _listed=jsonval.listed(F.col("line")))
    parsed = with_computed(listed, payload=jsonval.only_value(F.col("_listed"), F.col("line")))
    parts = with_computed(parsed, **{name: jsonval.field(F.col("payload"), f"$.{name}") for name in ("event", "tags", "data")})
    return parts.select("request_id", "seq", *[jsonval.plain_text(F.col(name)).alias(name) for name in ("event", "tags", "data")])


def prune_payload(spark, sf_dir):
    return line_parts(ops.prune_payload(events(spark, sf_dir).select("request_id", "seq", "line")))


def serialize_event(spark, sf_dir):
    return line_parts(ops.serialize_events(with_include(spark, sf_dir, inputs.model_events(spark, sf_dir))))


def raw_texts(spark, sf_dir) -> DataFrame:
    """Stream output as it may come: plain, with newlines, or looking like JSON."""
    text = F.col("text")
    raw = (
        F.when(F.col("role") == "user", text)
        .when(F.col("role") == "assistant", F.concat(text, F.lit("\n\n")))
        .otherwise(F.concat(F.lit(" {"), text, F.lit("} \n")))
    )
    return inputs.turns(spark, sf_dir).select("request_id", raw.alias("text"))


def ensure_newline(spark, sf_dir):
    return raw_texts(spark, sf_dir).select("request_id", chat.ensure_newline(F.col("text")).alias("line"))


def to_ndjson_line(spark, sf_dir):
    return ops.coerce_lines(raw_texts(spark, sf_dir)).select("request_id", "line")


def concat_tokens(spark, sf_dir):
    return ops.concat_tokens(inputs.tokens(spark, sf_dir))


def event_envelope(spark, sf_dir):
    return ops.event_envelope(inputs.requests(spark, sf_dir), inputs.tokens(spark, sf_dir))


def serialized(spark, sf_dir) -> DataFrame:
    return ops.serialize_events(with_include(spark, sf_dir, inputs.model_events(spark, sf_dir)))


def event_fallback(spark, sf_dir):
    """Requests whose model sent token streams, some of which the include lists drop, and
    each request once more, with a model that sent nothing: there the tokens take over."""
    streams = inputs.model_events(spark, sf_dir).filter(F.col("line").contains("_stream"))
    emitted = ops.serialize_events(with_include(spark, sf_dir, streams)).select("request_id", "seq", "line")
    emitted = materialise(emitted, "emitted")
    asked, tokens = inputs.requests(spark, sf_dir), inputs.tokens(spark, sf_dir)
    silent = F.concat("request_id", F.lit("-silent")).alias("request_id")
    asked = asked.unionByName(asked.select(silent, "message", "include"))
    tokens = tokens.unionByName(tokens.select(silent, "seq", "token"))
    answered = ops.event_fallback(emitted, asked, tokens)
    return answered.select("request_id", "ord", F.regexp_replace("text", r"\s+\z", "").alias("text"))


def token_stream(spark, sf_dir):
    lines = inputs.client_lines(spark, sf_dir).withColumnRenamed("session_id", "request_id")
    return ops.token_stream(lines).select("request_id", "seq", "token")


def ndjson_roundtrip(spark, sf_dir):
    """Events rows to NDJSON files and back, values parsed."""
    path = work_path(spark, "ndjson")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    ndjson.write_rows_ndjson(rows, path)
    payload = F.col("payload")
    return ndjson.read_ndjson(spark, path).select(
        F.variant_get(payload, "$.event_id", "bigint").alias("event_id"),
        F.variant_get(payload, "$.user_id", "bigint").alias("user_id"),
        F.variant_get(payload, "$.event_type", "string").alias("event_type"),
        F.variant_get(payload, "$.value", "double").alias("value"),
        F.variant_get(payload, "$.props", "string").alias("props"),
    )


# Arguments of the chat requests, by the length and by the last character of their ids.
INCLUDE_ARGS = (None, "on_chat_model_end", " , ", "all", "custom,,on_chat_model_start ")
STREAM_ARGS = (None, "tokens", "TOKENS", "events", "tokens ")
# The model sends nothing for requests whose ids end so: their words are sent in its place.
SILENT = ("0", "3", "7")


def chat_response(spark, sf_dir):
    """Bodies to response bodies: validation, include lists, modes, model events or tokens.

    A plain body is one row, a body of event lines one row per line."""
    lit = lambda values: [F.lit(value).cast("string") for value in values]
    asked = bodies(spark, sf_dir).withColumns(
        {
            "include_arg": inputs.choose(F.length("request_id"), lit(INCLUDE_ARGS)),
            "stream_arg": inputs.choose(F.ascii(F.right("request_id", F.lit(1))), lit(STREAM_ARGS)),
        }
    )
    asked = materialise(plan.accept_requests(asked), "accepted")
    silent = F.right("request_id", F.lit(1)).isin(*SILENT)
    responses = plan.respond(asked, inputs.model_events(spark, sf_dir).filter(~silent), inputs.tokens(spark, sf_dir))
    sent = materialise(plan.deliver(responses, asked), "sent-bodies")
    lines = sent.filter(F.col("kind") == plan.NDJSON).select(
        "request_id", F.posexplode(F.split("text", "\n")).alias("seq", "line")
    )
    plain = sent.filter(F.col("kind") == plan.PLAIN_TEXT)
    rows = line_parts(lines.filter("line <> ''")).withColumn("kind", F.lit(plan.NDJSON))
    return rows.unionByName(
        plain.select("request_id", "kind", F.lit(0).alias("seq"), F.col("text").alias("data")), allowMissingColumns=True
    )


QUERIES = {
    "validate_requests": validate_requests,
    "parse_include": parse_include,
    "tag_route": tag_route,
    "normalise_event": normalise_event,
    "filter_events": filter_events,
    "chunk_to_text": chunk_to_text,
    "extract_token": extract_token,
    "drop_empty_tokens": drop_empty_tokens,
    "is_empty": is_empty,
    "prune_payload": prune_payload,
    "serialize_event": serialize_event,
    "ensure_newline": ensure_newline,
    "to_ndjson_line": to_ndjson_line,
    "concat_tokens": concat_tokens,
    "event_envelope": event_envelope,
    "event_fallback": event_fallback,
    "token_stream": token_stream,
    "ndjson_roundtrip": ndjson_roundtrip,
    "chat_response": chat_response,
}


def _sql_string(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_body(kind: str, text: str) -> str:
    forms = " ".join(
        f"WHEN '{name}' THEN {_sql_string(a)} || {text if b else _sql_string('')} || {_sql_string(b)}"
        for name, (a, b) in BODY_FORMS.items()
    )
    return f"CASE {kind} {forms} END"


_SPACE = char_class(WORD_SPACE)

_BODIES = f"""SELECT request_id, {_sql_body("role", "CASE role WHEN 'assistant' THEN request_id ELSE to_json(text)::VARCHAR END")} AS body
    FROM ({SQL_TURNS})
    UNION ALL SELECT 'e' || event_id, {_sql_body("event_type", "value::VARCHAR")} FROM events"""

# The last of repeated keys wins, as in the parsers the bodies are meant for.
_MESSAGES = f"""SELECT request_id, message, message IS NOT NULL AS ok,
        CASE WHEN message IS NULL THEN '{chat.INVALID_REQUEST}' END AS error
    FROM (SELECT request_id, nullif({sql_strip("raw", REQUEST_SPACE)}, '') AS message
          FROM (SELECT request_id,
                       CASE WHEN json_valid(body) AND json_type(body, '$.message') = 'VARCHAR'
                            THEN coalesce(nullif(json_extract_string(replace(body, '"message":"",', ''), '$.message'), ''), '') END AS raw
                FROM ({_BODIES})))"""


def sql_json_text(value: str) -> str:
    """DuckDB: a JSON string's content, other values as JSON text, null stays."""
    return f"CASE json_type({value}) WHEN 'VARCHAR' THEN {value}->>'$' WHEN 'NULL' THEN NULL ELSE {value}::VARCHAR END"


def sql_chunk_text(chunk: str, depth: int = 6) -> str:
    """DuckDB: text of a model chunk; without ``coalesce`` to the empty string.

    ``depth`` is more than the derived lines nest, which is five deep."""
    options = [f"CASE json_type({chunk}) WHEN 'VARCHAR' THEN nullif({chunk}->>'$', '') END"]
    for name in ("content", "text"):
        value = f"({chunk}->'$.{name}')"
        options.append(
            f"CASE WHEN {value}::VARCHAR NOT IN {jsonval.FALSY_JSON} THEN {sql_json_text(value)} END"
        )
    if depth:
        options.append(sql_chunk_text(f"({chunk}->'$.message')", depth - 1))
    return f"coalesce({', '.join(options)})"


def sql_token(data: str) -> str:
    token = f"({data}->'$.token')"
    inner = ", ".join(
        f"CASE json_type({token}->'$.{name}') WHEN 'VARCHAR' THEN nullif({token}->>'$.{name}', '') END"
        for name in ("text", "content", "value")
    )
    return f"""coalesce({sql_chunk_text(f"({data}->'$.chunk')")},
        CASE json_type({token}) WHEN 'VARCHAR' THEN {token}->>'$' END, {inner}, '')"""


_LINES = f"SELECT request_id, seq, line::JSON AS j FROM ({SQL_MODEL_EVENTS}) WHERE json_valid(line)"
_NAME = "CASE json_type(j->'$.event') WHEN 'VARCHAR' THEN j->>'$.event' END"
SQL_EVENTS = f"SELECT request_id, seq, j, {_NAME} AS name FROM ({_LINES}) WHERE json_type(j) = 'OBJECT'"

_ALL = list(chat.ALL_EVENTS)
_STREAMS = list(chat.STREAM_EVENTS)


def sql_allowed(name: str, include: str = "include") -> str:
    return f"({include} IS NULL OR list_has_any({include}, {_ALL}) OR coalesce(list_contains({include}, {name}), false))"


SQL_TOKENS_ADMITTED = f"(include IS NULL OR list_has_any(include, {[*_STREAMS, chat.TOKEN]}))"

def sql_filtered(events: str, requests: str) -> str:
    return f"""SELECT request_id, seq, j, name FROM ({events}) JOIN ({requests}) USING (request_id)
    WHERE CASE WHEN name IN {chat.STREAM_EVENTS} THEN include IS NULL OR list_has_any(include, {[*_STREAMS, chat.TOKEN, *_ALL]})
               ELSE {sql_allowed("name")} END"""

# What pruning leaves of the derived lines, per kind of event.
_PRUNED_DATA = f"""CASE WHEN name = 'on_chat_model_start'
         THEN json_object('input', j->'$.data.input', 'meta', json_object('f', false, 'n', 0))::VARCHAR
    WHEN name = 'on_chat_model_end' THEN json_object('output', j->'$.data.output')::VARCHAR
    WHEN name IS NULL THEN '{{"x":"é","z":[1]}}'
    WHEN seq % 6 = 1 THEN json_object('chunk', j->'$.data.chunk')::VARCHAR
    WHEN seq % 6 = 2 THEN json_object('chunk', json_object('content', j->'$.data.chunk.content'))::VARCHAR
    WHEN seq % 6 = 3 THEN json_object('chunk', json_object('message', j->'$.data.chunk.message'))::VARCHAR
    WHEN seq % 6 = 4 THEN json_object('token', j->'$.data.token')::VARCHAR
    WHEN seq % 6 = 5 THEN json_object('token', json_object('value', j->'$.data.token.value'))::VARCHAR
    ELSE json_object('note', j->'$.data.note')::VARCHAR END"""
_EVENT_TEXT = "coalesce(name, '5')"


def sql_serialized(filtered: str) -> str:
    return f"""SELECT request_id, seq, 'token' AS event, NULL::VARCHAR AS tags, token AS data
    FROM (SELECT request_id, seq, {sql_token("(j->'$.data')")} AS token FROM ({filtered}) WHERE name IN {chat.STREAM_EVENTS})
    WHERE token <> ''
    UNION ALL SELECT request_id, seq, {_EVENT_TEXT}, NULL, {_PRUNED_DATA}
    FROM ({filtered}) WHERE coalesce(name NOT IN {chat.STREAM_EVENTS}, true)"""


_FILTERED = sql_filtered(SQL_EVENTS, SQL_REQUESTS)
_SERIALIZED = sql_serialized(_FILTERED)

_RAW = f"""SELECT request_id, CASE role WHEN 'user' THEN text WHEN 'assistant' THEN text || chr(10) || chr(10)
    ELSE chr(8195) || '{{' || text || '}}' || chr(160) || chr(10) END AS text FROM ({SQL_TURNS})"""

_CONCAT = f"SELECT request_id, string_agg(token, '' ORDER BY seq) AS text FROM ({SQL_TOKENS}) GROUP BY request_id"


def sql_envelope(requests: str, tokens: str = SQL_TOKENS) -> str:
    def line(name: str, field: str, value: str) -> str:
        return f"json_object('event', '{name}', 'data', json_object('{field}', {value}))::VARCHAR || chr(10)"

    sent = f"SELECT t.* FROM ({tokens}) t JOIN ({requests}) USING (request_id) WHERE {SQL_TOKENS_ADMITTED}"
    joined = f"""SELECT request_id, string_agg(token, '' ORDER BY seq) AS output, max(seq) AS last
        FROM ({sent}) GROUP BY request_id"""
    return f"""SELECT request_id, 0::BIGINT AS ord, {line(chat.START_EVENT, "input", "message")} AS text
        FROM ({requests}) WHERE {sql_allowed(f"'{chat.START_EVENT}'")}
        UNION ALL SELECT request_id, seq::BIGINT + 1, token FROM ({sent})
        UNION ALL SELECT request_id, coalesce(last + 2, 1)::BIGINT,
            {line(chat.END_EVENT, "output", "coalesce(output, message)")}
        FROM ({requests}) LEFT JOIN ({joined}) USING (request_id) WHERE {sql_allowed(f"'{chat.END_EVENT}'")}"""


def _sql_argument(number: str, values: tuple) -> str:
    return inputs.sql_choose(number, ["NULL" if value is None else _sql_string(value) for value in values])


_NAMES = f"list_filter(list_transform(string_split(coalesce(arg, ''), ','), lambda s: {sql_strip('s')}), lambda s: s <> '')"
_SENT = f"""WITH asked AS (
        SELECT request_id, message, CASE WHEN len(names) > 0 THEN list_append(names, '{chat.TOKEN}') END AS include,
               coalesce(lower(mode), '') = 'tokens' AS plain
        FROM (SELECT request_id, message, mode, {_NAMES} AS names
              FROM (SELECT request_id, message, {_sql_argument("length(request_id)", INCLUDE_ARGS)} AS arg,
                           {_sql_argument("ascii(right(request_id, 1))", STREAM_ARGS)} AS mode
                    FROM ({_MESSAGES}) WHERE ok))),
    happened AS (SELECT * FROM ({SQL_EVENTS}) WHERE right(request_id, 1) NOT IN {SILENT}),
    emitted AS ({sql_serialized(sql_filtered("SELECT * FROM happened", "SELECT * FROM asked"))}),
    waiting AS (SELECT * FROM asked WHERE request_id NOT IN (SELECT request_id FROM emitted)),
    instead AS (SELECT *, regexp_matches(text, '^\\{{"event":"[a-z_]*","data":\\{{') AS whole
        FROM ({sql_envelope("SELECT * FROM waiting")})),
    lines AS (
        SELECT request_id, seq::BIGINT AS ord, event, data FROM emitted
        UNION ALL SELECT request_id, ord, CASE WHEN whole THEN text::JSON->>'$.event' ELSE 'token' END,
            CASE WHEN whole THEN (text::JSON->'$.data')::VARCHAR ELSE text END FROM instead),
    texts AS (SELECT request_id, string_agg(data, '' ORDER BY ord) AS text FROM lines WHERE event = 'token' GROUP BY request_id)
    SELECT request_id, 'application/x-ndjson' AS kind, (row_number() OVER (PARTITION BY request_id ORDER BY ord) - 1)::INTEGER AS seq,
        event, NULL::VARCHAR AS tags, data
    FROM lines JOIN asked USING (request_id) WHERE NOT plain
    UNION ALL SELECT request_id, 'text/plain', 0, NULL, NULL, coalesce(text, '')
    FROM asked LEFT JOIN texts USING (request_id) WHERE plain"""

_EMITTED_STREAMS = f"SELECT * FROM ({_SERIALIZED}) WHERE event = 'token'"

ORACLES = {
    "validate_requests": _MESSAGES,
    "parse_include": f"""SELECT event_id, CASE WHEN len(names) > 0
            THEN array_to_string(list_sort(list_distinct(list_append(names, '{chat.TOKEN}'))), '|') END AS include
        FROM (SELECT event_id, list_filter(list_transform(string_split(arg, ','), lambda s: {sql_strip("s")}), lambda s: s <> '') AS names
              FROM (SELECT event_id, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN ' , ,' WHEN 'error' THEN event_type
                    ELSE ' ' || event_type || ',,zeta ,é,' || event_type || chr(10) || ', token,' END AS arg FROM events))""",
    "tag_route": f"SELECT request_id, '/chat' AS route FROM ({SQL_TURNS})",
    "normalise_event": f"SELECT request_id, seq, name FROM ({SQL_EVENTS})",
    "filter_events": f"SELECT request_id, seq, name FROM ({_FILTERED})",
    "chunk_to_text": f"""SELECT request_id, seq, coalesce({sql_chunk_text("(j->'$.data.chunk')")}, '') AS text FROM ({SQL_EVENTS})""",
    "extract_token": f"""SELECT request_id, seq, {sql_token("(j->'$.data')")} AS token FROM ({SQL_EVENTS})""",
    "drop_empty_tokens": f"""SELECT * FROM (SELECT request_id, seq, {sql_token("(j->'$.data')")} AS token FROM ({SQL_EVENTS}))
        WHERE token <> ''""",
    "is_empty": "SELECT request_id, seq, "
    + ", ".join(
        f"coalesce((j->'{path}')::VARCHAR IN {jsonval.EMPTY_JSON}, true) AS {name}_empty"
        for name, path in (
            ("tags", "$.tags"),
            ("chunk", "$.data.chunk"),
            ("content", "$.data.chunk.content"),
            ("n", "$.data.meta.n"),
            ("data", "$.data"),
        )
    )
    + f" FROM ({SQL_EVENTS})",
    "prune_payload": f"SELECT request_id, seq, {_EVENT_TEXT} AS event, NULL::VARCHAR AS tags, {_PRUNED_DATA} AS data FROM ({SQL_EVENTS})",
    "serialize_event": _SERIALIZED,
    "ensure_newline": f"""SELECT request_id, CASE WHEN ends_with(text, chr(10)) THEN text ELSE text || chr(10) END AS line
        FROM ({_RAW})""",
    "to_ndjson_line": f"""SELECT request_id, CASE
            WHEN regexp_matches(text, '\\A[{_SPACE}]*\\{{') AND regexp_matches(text, '\\}}[{_SPACE}]*\\z') THEN text
            ELSE json_object('event', '{chat.TOKEN}', 'data', rtrim(text, chr(10)))::VARCHAR || chr(10) END AS line
        FROM ({_RAW})""",
    "concat_tokens": _CONCAT,
    "event_envelope": sql_envelope(SQL_REQUESTS),
    "event_fallback": f"""WITH emitted AS ({_EMITTED_STREAMS}),
        asked AS ({SQL_REQUESTS}),
        silent AS (SELECT request_id || '-silent' AS request_id, message, include FROM asked),
        waiting AS (SELECT * FROM (SELECT * FROM asked UNION ALL SELECT * FROM silent)
            WHERE request_id NOT IN (SELECT request_id FROM emitted)),
        sent AS ({SQL_TOKENS})
        SELECT request_id, seq::BIGINT AS ord, json_object('event', 'token', 'data', data)::VARCHAR AS text FROM emitted
        UNION ALL SELECT request_id, ord, rtrim(text, chr(10)) FROM ({sql_envelope("SELECT * FROM waiting", "SELECT * FROM sent UNION ALL SELECT request_id || '-silent', seq, token FROM sent")})""",
    "token_stream": f"""SELECT request_id, seq, j->>'$.data' AS token
        FROM (SELECT session_id AS request_id, seq, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM ({inputs.SQL_CLIENT_LINES}))
        WHERE j->>'$.event' = '{chat.TOKEN}' AND json_type(j->'$.data') = 'VARCHAR' AND j->>'$.data' <> ''""",
    "ndjson_roundtrip": "SELECT event_id, user_id, event_type, value, props FROM events",
    "chat_response": _SENT,
}

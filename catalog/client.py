"""The client side: lines, messages, histories, saves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import chat_inputs as inputs
from catalog.chat_inputs import SQL_CLIENT_LINES, SQL_REQUESTS, SQL_TOKENS, SQL_TURNS
from catalog.events import sql_envelope
from catalog.tables import sql_strip, table
from sparrowline.functions import chat
from sparrowline.functions.binding import let
from sparrowline.functions.text import CLIENT_SPACE
from sparrowline.operators import events as event_ops
from sparrowline.operators import messages as ops
from sparrowline.operators.ordered import concat_ordered
from sparrowline.plans import client as plan
from sparrowline.session import materialise

CHUNK_BYTES = 37
GAP_MS = 3_600_000
HISTORY_BASE = 1_700_000_000_000


def byte_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(session_id, seq, data)``: texts cut every 37 bytes, also inside
    characters. The last chunk is marked."""
    count = F.ceil(F.octet_length(F.col(text)) / CHUNK_BYTES).cast("int")
    starts = F.sequence(F.lit(0), count - 1)
    pieces = let(
        F.encode(F.col(text), "UTF-8"),
        lambda data: F.transform(starts, lambda i: F.substring(data, i * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES))),
    )
    cut = df.filter(F.length(text) > 0).select(
        F.col(key).alias("session_id"), (count - 1).alias("_last"), F.posexplode(pieces).alias("seq", "data")
    )
    return cut.select("session_id", "seq", "data", (F.col("seq") == F.col("_last")).alias("is_last"))


def document_chunks(spark, sf_dir) -> DataFrame:
    return byte_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


def reassemble_lines(spark, sf_dir):
    return ops.reassemble_lines(materialise(document_chunks(spark, sf_dir), "chunks"))


def client_events(spark, sf_dir) -> DataFrame:
    return ops.read_client_events(inputs.client_lines(spark, sf_dir))


def parse_event_lines(spark, sf_dir):
    return event_ops.parse_event_lines(inputs.client_lines(spark, sf_dir)).select("session_id", "seq")


def event_defaults(spark, sf_dir):
    return ops.event_defaults(inputs.client_lines(spark, sf_dir)).select("session_id", "seq", "name", "data")


def event_summary(spark, sf_dir):
    return client_events(spark, sf_dir).select("session_id", "seq", "summary")


def message_text(messages: DataFrame) -> DataFrame:
    """Messages with their events as text."""
    shown = F.transform("events", lambda e: F.concat_ws("=", e["name"], e["data"], e["at"].cast("string")))
    return messages.select("session_id", "content", F.array_join(shown, "|").alias("events"))


def fold_messages(spark, sf_dir):
    return message_text(ops.fold_messages(client_events(spark, sf_dir)))


def finished_sessions(spark, sf_dir) -> DataFrame:
    return inputs.turns(spark, sf_dir).filter("role = 'user'").select(F.col("request_id").alias("session_id"))


def latest_event(spark, sf_dir):
    return ops.latest_event(client_events(spark, sf_dir), finished=finished_sessions(spark, sf_dir))


def message_upsert(spark, sf_dir):
    """Turns as messages, their words as updates: assistant turns match, user
    turns have another timestamp and may be added, system turns never are."""
    turns = inputs.turns(spark, sf_dir)
    stamp = F.col("turn") * 1000
    messages = turns.select(
        F.col("conv_id").alias("session_id"), "role", stamp.alias("timestamp"), F.col("turn").alias("pos"), F.col("text").alias("content")
    )
    words = inputs.tokens(spark, sf_dir).join(turns.select("request_id", "conv_id", "turn", "role"), "request_id")
    updates = words.select(
        F.col("conv_id").alias("session_id"),
        "role",
        F.when(F.col("role") == "assistant", stamp).otherwise(stamp + 500).alias("timestamp"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("token").alias("content"),
        ((F.col("role") == "user") & (F.length("token") > 9)).alias("ensure_create"),
    )
    return ops.message_upsert(messages, updates)


def append_error(spark, sf_dir):
    """User turns failed, system turns were aborted."""
    messages = ops.fold_messages(client_events(spark, sf_dir)).select(
        "session_id", F.lit("assistant").alias("role"), "content", F.lit(0).cast("bigint").alias("timestamp")
    )
    return ops.append_error(messages, session_status(spark, sf_dir))


def session_status(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("role") == "user", "error").when(F.col("role") == "system", "aborted").otherwise("done")
    return inputs.turns(spark, sf_dir).select(
        F.col("request_id").alias("session_id"), status.alias("status"), (F.col("turn") * 1000).alias("timestamp")
    )


def stored_histories(spark, sf_dir) -> DataFrame:
    """One stored text per conversation. Items lack a timestamp, have fields of their own or hold
    other things than lists as events; some texts are broken or hold a null."""
    def item(text):
        return F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","content":'), inputs.json_text(F.col("text")), F.lit(text))

    stamp = F.concat(F.lit(',"timestamp":'), (F.col("turn") + 5).cast("string"))
    form = (
        F.when(F.col("role") == "user", F.concat(item(',"pinned":[1,{"x":null}],"id":"m'), F.col("turn").cast("string"), F.lit('"}')))
        .when(F.col("role") == "assistant", F.concat(item(""), stamp, F.lit(',"events":[{"name":"x"},2]}')))
        .otherwise(F.concat(item(""), stamp, F.lit(',"events":"none"}')))
    )
    items = inputs.turns(spark, sf_dir).select("conv_id", "turn", form.alias("item"))
    joined = concat_ordered(items, ["conv_id"], "turn", "item", "items", separator=",")
    sizes = items.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    end = F.when(F.col("n") == 7, ",null]").when(F.col("n") == 5, "] x").otherwise("]")
    return joined.join(sizes, "conv_id").select(
        F.col("conv_id").alias("session_id"), F.concat(F.lit("["), "items", end).alias("history")
    )


def history_load(spark, sf_dir):
    loaded = ops.history_load(stored_histories(spark, sf_dir), HISTORY_BASE)
    return loaded.withColumn("events", F.size("events"))


def history_defaults(spark, sf_dir):
    """Histories whose messages have neither timestamp nor events."""
    messages = turn_messages(spark, sf_dir)
    stored = ops.history_save(messages, fields=("role", "content"))
    return ops.history_load(stored, HISTORY_BASE).select("session_id", "pos", "timestamp", F.size("events").alias("events"))


def turn_messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        "role",
        F.col("text").alias("content"),
        (F.col("turn") * 1000).alias("timestamp"),
    )


def history_save(spark, sf_dir):
    return ops.history_save(turn_messages(spark, sf_dir))


def activity(spark, sf_dir) -> DataFrame:
    """The events table as states of its users."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("state"),
    )


def debounce_latest(spark, sf_dir):
    return ops.debounce_latest(activity(spark, sf_dir), GAP_MS).withColumn("ts", F.unix_micros("ts"))


def response_bytes(spark, sf_dir) -> DataFrame:
    """Event lines of every request's response, cut into chunks of 37 bytes."""
    everything = inputs.requests(spark, sf_dir).withColumn("include", F.lit(None).cast("array<string>"))
    lines = event_ops.coerce_lines(event_ops.event_envelope(everything, inputs.tokens(spark, sf_dir)))
    streams = concat_ordered(lines, ["request_id"], "ord", "line", "stream")
    return byte_chunks(streams, "request_id", "stream")


def chat_roundtrip(spark, sf_dir):
    """Tokens to event lines to bytes in chunks and back to messages."""
    chunks = materialise(response_bytes(spark, sf_dir), "chunks")
    received = plan.receive_messages(chunks, session_status(spark, sf_dir).replace("error", "done", "status"))
    return received.select("session_id", "role", "content", F.size("events").alias("events"), "timestamp")


QUERIES = {
    "reassemble_lines": reassemble_lines,
    "parse_event_lines": parse_event_lines,
    "event_defaults": event_defaults,
    "event_summary": event_summary,
    "fold_messages": fold_messages,
    "latest_event": latest_event,
    "message_upsert": message_upsert,
    "append_error": append_error,
    "history_load": history_load,
    "history_defaults": history_defaults,
    "history_save": history_save,
    "debounce_latest": debounce_latest,
    "chat_roundtrip": chat_roundtrip,
}

_PARSED = f"""SELECT session_id, seq, "at", line::JSON AS j FROM ({SQL_CLIENT_LINES})
    WHERE json_valid(line) AND json_type(line::JSON) <> 'NULL'"""
_NAME = f"CASE json_type(j->'$.event') WHEN 'VARCHAR' THEN j->>'$.event' ELSE '{chat.UNNAMED_EVENT}' END"
_DATA = "coalesce((j->'$.data')::VARCHAR, 'null')"
_SUMMARY = f"""CASE json_type(j->'$.data') WHEN 'VARCHAR' THEN j->>'$.data'
    ELSE CASE WHEN {_DATA} = 'null' THEN '' ELSE {_DATA} END END"""
SQL_CLIENT_EVENTS = f"""SELECT session_id, seq, "at", name, data, summary,
        CASE WHEN name = '{chat.TOKEN}' AND json_type(j->'$.data') = 'VARCHAR' THEN nullif(j->>'$.data', '') END AS token
    FROM (SELECT *, {_NAME} AS name, {_DATA} AS data, {_SUMMARY} AS summary FROM ({_PARSED}))"""

SQL_MESSAGES = f"""SELECT session_id, string_agg(coalesce(token, ''), '' ORDER BY seq) AS content,
        coalesce(string_agg(name || '=' || data || '=' || "at", '|' ORDER BY seq) FILTER (name <> '{chat.TOKEN}'), '') AS events,
        coalesce(arg_max(name || ': ' || summary, seq) FILTER (name <> '{chat.TOKEN}'), '') AS latest
    FROM ({SQL_CLIENT_EVENTS}) WHERE token IS NOT NULL OR name <> '{chat.TOKEN}' GROUP BY session_id"""

_UPDATES = f"""SELECT conv_id AS session_id, role, CASE role WHEN 'assistant' THEN turn * 1000 ELSE turn * 1000 + 500 END AS timestamp,
        seq::BIGINT AS seq, token AS content, role = 'user' AND length(token) > 9 AS ensure_create
    FROM ({SQL_TOKENS}) JOIN ({SQL_TURNS}) USING (request_id)"""

_HISTORY_ITEMS = """SELECT conv_id AS session_id, turn, role, text AS content,
        CASE role WHEN 'user' THEN NULL ELSE turn + 5 END AS stamp,
        CASE role WHEN 'assistant' THEN 2 ELSE 0 END AS events,
        count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"""

SQL_DEBOUNCED = f"""SELECT user_id AS session_id, epoch_us(ts) AS ts, event_id AS state
    FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS later FROM events)
    WHERE later IS NULL OR later - ts > INTERVAL {GAP_MS} MILLISECONDS"""

SQL_LINES = f"""SELECT session_id, line_no, line
    FROM (SELECT doc_id AS session_id, (i - 1)::BIGINT AS line_no, {sql_strip("parts[i]", CLIENT_SPACE)} AS line
          FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
                FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))
    WHERE line <> ''"""

ORACLES = {
    "reassemble_lines": SQL_LINES,
    "parse_event_lines": f"SELECT session_id, seq FROM ({_PARSED})",
    "event_defaults": f"SELECT session_id, seq, name, data FROM ({SQL_CLIENT_EVENTS}) WHERE name <> '{chat.TOKEN}'",
    "event_summary": f"SELECT session_id, seq, summary FROM ({SQL_CLIENT_EVENTS})",
    "fold_messages": f"SELECT session_id, content, events FROM ({SQL_MESSAGES})",
    "latest_event": f"""SELECT session_id, CASE WHEN role = 'user' THEN '' ELSE coalesce(latest, '') END AS latest
        FROM (SELECT session_id, arg_max(name || ': ' || summary, seq) FILTER (name <> '{chat.TOKEN}') AS latest
              FROM ({SQL_CLIENT_EVENTS}) GROUP BY session_id)
        JOIN ({SQL_TURNS}) ON session_id = request_id""",
    "message_upsert": f"""WITH last AS (SELECT session_id, role, timestamp, arg_max(content, seq) AS content,
            min(seq) FILTER (ensure_create) AS added FROM ({_UPDATES}) GROUP BY ALL),
        base AS (SELECT conv_id AS session_id, role, turn * 1000 AS timestamp, turn AS pos, text AS content FROM conversations)
        SELECT session_id, role, timestamp, pos, CASE WHEN pos IS NULL THEN added END AS added,
            coalesce(last.content, base.content) AS content
        FROM base FULL JOIN last USING (session_id, role, timestamp) WHERE pos IS NOT NULL OR added IS NOT NULL""",
    "append_error": f"""SELECT session_id, 'assistant' AS role, content, 0::BIGINT AS timestamp FROM ({SQL_MESSAGES})
        UNION ALL SELECT request_id, 'assistant', '{chat.CLIENT_ERROR}', turn * 1000 FROM ({SQL_TURNS}) WHERE role = 'user'""",
    "history_load": f"""SELECT session_id, turn::INTEGER AS pos, role, content,
            coalesce(stamp, {HISTORY_BASE} + turn * 1000) AS timestamp, events::INTEGER AS events,
            CASE role WHEN 'user' THEN '{{"id":"m' || turn || '","pinned":[1,{{"x":null}}]}}' END AS extra
        FROM ({_HISTORY_ITEMS}) WHERE n NOT IN (5, 7)""",
    "history_defaults": f"""SELECT conv_id AS session_id, turn::INTEGER AS pos, {HISTORY_BASE} + turn * 1000 AS timestamp,
            0::INTEGER AS events FROM conversations""",
    "history_save": """SELECT conv_id AS session_id, '[' || string_agg(
            json_object('role', role, 'content', text, 'timestamp', turn * 1000)::VARCHAR, ',' ORDER BY turn) || ']' AS history
        FROM conversations GROUP BY conv_id""",
    "debounce_latest": SQL_DEBOUNCED,
    "chat_roundtrip": f"""SELECT request_id AS session_id, 'assistant' AS role, string_agg(token, '' ORDER BY seq) AS content,
            2::INTEGER AS events, any_value(turn) * 1000 AS timestamp
        FROM ({SQL_TOKENS}) JOIN ({SQL_TURNS}) USING (request_id) GROUP BY request_id""",
}

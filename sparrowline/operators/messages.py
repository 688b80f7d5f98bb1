"""The client side: lines from byte chunks, messages from events, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowline.functions import chat, jsonval
from sparrowline.functions.binding import let, with_computed
from sparrowline.functions.text import CLIENT_SPACE, strip
from sparrowline.operators.events import parse_event_lines
from sparrowline.operators.ordered import concat_in_blocks, concat_ordered, fold_ordered, running_total_in_blocks

SESSION = "session_id"
SEQ = "seq"
# Fields of a stored message that have a column.
_FIELDS = ("role", "content", "timestamp", "events")


def reassemble_lines(chunks: DataFrame, session: str = SESSION, seq: str = SEQ, data: str = "data") -> DataFrame:
    """Lines of each session's byte stream, from chunks cut anywhere.

    Returns ``(session, line_no, line)``: trimmed, without empty lines. Bytes are
    joined before they are decoded, so a chunk may end inside a character; this
    goes by way of ISO-8859-1, which has one character per byte. A line's number
    is the count of newlines before it. Chunks are shuffled once, by block; only
    lines that cross from block to block are shuffled again.
    """
    parts = F.split(F.decode(F.col(data), "ISO-8859-1"), "\n", -1)
    cut = chunks.select(session, seq, parts.alias("_parts")).withColumn(
        "_breaks", (F.size("_parts") - 1).cast("bigint")
    )
    blocks = ("_block", "_block_base", "_block_total")
    segments = (
        running_total_in_blocks(cut, [session], seq, "_breaks", "_base")
        .select(session, seq, *blocks, "_base", F.posexplode("_parts").alias("_pos", "_part"))
        .withColumn("line_no", F.col("_base") + F.col("_pos"))
    )
    first = F.col("_block_base")
    last = first + F.col("_block_total")
    lines = concat_in_blocks(segments, [session], "line_no", seq, "_part", "_line", first, last)
    text = F.make_valid_utf8(F.encode(F.col("_line"), "ISO-8859-1").cast("string"))
    read = with_computed(lines, line=strip(text, CLIENT_SPACE)).select(session, "line_no", "line")
    return read.filter(F.length("line") > 0)


def read_client_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``name``, ``data``, ``summary`` and ``token`` to every line that parses.

    ``token`` is the text of a token event. Other lines are events: a name that
    is not a string reads ``event``, absent data reads null. Values that are no
    objects count as events without name and data. Token events without text
    stay, with a null token. ``data`` is JSON text with its keys in the line's order;
    where a key repeats, the last one counts, and keys are sorted.
    """
    named = with_computed(
        parse_event_lines(lines, line),
        name=F.coalesce(chat.event_name(F.col("payload")), F.lit(chat.UNNAMED_EVENT)),
        _json=chat.data_json(F.col("payload")),
    )
    first = F.substring("_json", 1, 1)
    # VARIANT sorts the keys of objects, so nested data is taken from the line, but only
    # where no key repeats: the line's first ``data`` is then what the payload holds.
    nested = let(
        F.when(first.isin("{", "["), F.get_json_object(F.col(line), "$.data")),
        lambda text: F.when(
            (F.length(text) == F.length("_json")) & (F.to_json(F.try_parse_json(text)) == F.col("_json")), text
        ),
    )
    string = F.when(first == '"', F.try_variant_get(F.col("payload"), "$.data", "string"))
    read = with_computed(named, data=F.coalesce(nested, F.col("_json")), _text=string)
    return (
        read.withColumn("summary", chat.summary(F.col("data"), F.col("_text")))
        .withColumn("token", F.when(~other_event(), chat.filled(F.col("_text"))))
        .drop("payload", "_json", "_text")
    )


def other_event(name: str = "name") -> Column:
    """Condition: the row is an event, not a token."""
    return F.col(name) != chat.TOKEN


def fold_messages(events: DataFrame, session: str = SESSION, seq: str = SEQ, at: str = "at") -> DataFrame:
    """One assistant message per session: its tokens joined as ``content``, its
    other events in order as ``events``. A session without either has none.

    ``events`` comes from :func:`read_client_events`.
    """
    used = events.filter(F.col("token").isNotNull() | other_event())
    event = F.when(
        other_event(), F.struct("name", "data", F.col(at).cast("bigint").alias("at"))
    )
    return fold_ordered(
        used.withColumn("_text", F.coalesce("token", F.lit(""))),
        [session],
        seq,
        texts={"content": ("_text", "")},
        lists={"events": event},
    )


def latest_event(
    events: DataFrame, session: str = SESSION, seq: str = SEQ, finished: DataFrame | None = None
) -> DataFrame:
    """``name: summary`` of each session's last event that is not a token; empty
    where there is none, and for sessions listed in ``finished``."""
    text = F.when(other_event(), F.concat("name", F.lit(": "), F.col("summary")))
    order = F.when(other_event(), F.col(seq))
    latest = events.groupBy(session).agg(F.coalesce(F.max_by(text, order), F.lit("")).alias("latest"))
    if finished is None:
        return latest
    over = finished.select(session, F.lit(True).alias("_over")).distinct()
    return latest.join(over, session, "left").select(
        session, F.when(F.col("_over"), F.lit("")).otherwise(F.col("latest")).alias("latest")
    )


def message_upsert(
    messages: DataFrame, updates: DataFrame, session: str = SESSION, seq: str = SEQ, values: Sequence[str] = ("content",)
) -> DataFrame:
    """Apply updates to messages, matched by session, role and timestamp.

    A match is replaced by its last update. An update without a match adds a
    message only if one of the message's updates has ``ensure_create``.
    ``messages`` has ``pos``, its place in the history; added messages have the
    ``seq`` that made them in ``added`` instead.
    """
    keys = [session, "role", "timestamp"]
    state = F.struct(*values)
    # One row per message and side before the join, so a message with very many
    # updates is reduced where its rows lie.
    last = updates.groupBy(*keys).agg(
        F.max_by(state, F.col(seq)).alias("_new"), F.min(F.when(F.col("ensure_create"), F.col(seq))).alias("_added")
    )
    # Of several stored messages with one key, only the first is updated.
    first = F.min("pos").over(Window.partitionBy(*keys)).alias("_first")
    base = messages.select(*keys, "pos", state.alias("_old"), first)
    merged = base.join(last, keys, "full_outer").filter(F.col("_old").isNotNull() | F.col("_added").isNotNull())
    later = F.col("_old").isNotNull() & (F.col("pos") > F.col("_first"))
    current = F.when(later, F.col("_old")).otherwise(F.coalesce("_new", "_old"))
    return merged.select(
        *keys,
        "pos",
        F.when(F.col("_old").isNull(), F.col("_added")).alias("added"),
        *[current[name].alias(name) for name in values],
    )


def append_error(messages: DataFrame, sessions: DataFrame, session: str = SESSION) -> DataFrame:
    """Add the error message for failed sessions. ``sessions`` has ``status`` and
    ``timestamp``; an aborted session keeps what it has."""
    failed = sessions.filter(F.col("status") == "error").select(
        session,
        F.lit("assistant").alias("role"),
        F.lit(chat.CLIENT_ERROR).alias("content"),
        F.col("timestamp"),
    )
    return messages.unionByName(failed, allowMissingColumns=True)


def event_defaults(events: DataFrame) -> DataFrame:
    """Alias of the defaulting step: named events with data or null."""
    return read_client_events(events).filter(other_event())


def history_load(histories: DataFrame, base: int, session: str = SESSION, history: str = "history") -> DataFrame:
    """Messages of stored JSON histories, with defaults filled in.

    A history that is absent, not JSON, not a list, or holds a null gives no
    rows. A message without timestamp gets ``base`` plus one second per place;
    events that are no list become an empty one. Fields a message has besides these four
    are kept as JSON text in ``extra``, null if there are none.
    """
    items = F.try_variant_get(jsonval.parse_strict(F.col(history)), "$", "array<variant>")
    sound = let(
        items,
        lambda found: F.when(~F.exists(found, lambda item: item.isNull() | F.is_variant_null(item)), found),
    )
    placed = histories.select(session, F.posexplode(sound).alias("pos", "_item"))
    item = F.col("_item")
    return placed.select(
        session,
        "pos",
        jsonval.as_text(jsonval.field(item, "$.role")).alias("role"),
        jsonval.as_text(jsonval.field(item, "$.content")).alias("content"),
        F.coalesce(F.try_variant_get(item, "$.timestamp", "bigint"), F.lit(base) + F.col("pos") * F.lit(1000)).alias(
            "timestamp"
        ),
        F.coalesce(F.try_variant_get(item, "$.events", "array<variant>"), F.expr("cast(array() as array<variant>)")).alias(
            "events"
        ),
        let(_other_fields(item), lambda extra: F.when(F.size(extra) > 0, F.to_json(extra))).alias("extra"),
    )


def _other_fields(item: Column) -> Column:
    """The fields of a stored message that have no column of their own."""
    return F.map_filter(F.try_variant_get(item, "$", "map<string,variant>"), lambda name, _: ~name.isin(*_FIELDS))


def _stored_events(messages: DataFrame) -> Column:
    """``events`` with their data as values in place of JSON text."""
    events = F.col("events")
    if isinstance(messages.schema["events"].dataType.elementType, T.StructType):
        events = F.transform(
            events, lambda e: F.struct(e["name"].alias("name"), F.try_parse_json(e["data"]).alias("data"), e["at"].alias("at"))
        )
    return events.alias("events")


def history_save(
    messages: DataFrame, session: str = SESSION, seq: str = SEQ, fields: Sequence[str] | None = None
) -> DataFrame:
    """One JSON list of messages per session, in order. Messages become JSON
    where they lie; a session without messages has no row.

    The fields are ``role``, ``content``, ``timestamp`` and, where there is such a
    column, ``events``, as :func:`fold_messages` or :func:`history_load` gives them; those
    in a column ``extra`` follow. Absent values are left out.
    """
    if fields is None:
        fields = [c for c in _FIELDS if c != "events" or c in messages.columns]
    values = [_stored_events(messages) if field == "events" else F.col(field) for field in fields]
    json = F.to_json(F.struct(*values))
    if "extra" in messages.columns:
        # Both are objects: the second one's fields go on where the first one ends.
        comma = F.when(F.length(json) > 2, F.lit(",")).otherwise(F.lit(""))
        both = F.concat(F.substring(json, F.lit(1), F.length(json) - 1), comma, F.substring("extra", 2, 1 << 30))
        json = F.when(F.col("extra").isNull() | (F.col("extra") == "{}"), json).otherwise(both)
    as_json = messages.select(session, seq, json.alias("_json"))
    joined = concat_ordered(as_json, [session], seq, "_json", "_list", separator=",")
    return joined.select(session, F.concat(F.lit("["), "_list", F.lit("]")).alias("history"))


def debounce_latest(
    updates: DataFrame, gap_ms: int = 300, key: str = SESSION, ts: str = "ts", seq: str = SEQ, state: str = "state"
) -> DataFrame:
    """The states that get saved: the last one before each pause longer than
    ``gap_ms``. Returns ``(key, ts, state)`` with the time of the last update.

    An update is the last of its burst when nothing follows within the gap.
    Time is cut into slots no shorter than the gap, so a successor lies in the
    same slot or is the first of the next one: a key with very many updates is
    spread over its slots.
    """
    slot_us = max(gap_ms * 1000, 3_600_000_000)
    gap_us = gap_ms * 1000
    per_time = (
        updates.groupBy(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
        .agg(F.max_by(state, seq).alias(state))
        .withColumn("_slot", F.floor(F.col("_us") / slot_us))
    )
    firsts = per_time.groupBy(key, (F.col("_slot") - 1).alias("_slot")).agg(F.min("_us").alias("_later"))
    inside = F.lead("_us").over(Window.partitionBy(key, "_slot").orderBy("_us"))
    following = F.coalesce("_inside", "_later")
    return (
        per_time.withColumn("_inside", inside)
        .join(firsts, [key, "_slot"], "left")
        .filter(following.isNull() | (following - F.col("_us") > gap_us))
        .select(key, F.timestamp_micros("_us").alias(ts), state)
    )

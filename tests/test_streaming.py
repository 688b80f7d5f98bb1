"""Streams fed file by file give what the batch forms give."""

import datetime
import json
import random
import time
from types import SimpleNamespace

import pytest

from sparrowline.operators import messages as ops
from sparrowline.operators.messages import read_client_events
from sparrowline.streaming.debounce import stream_debounce
from sparrowline.streaming.events import append_table, stream_events
from sparrowline.streaming.lines import stream_lines
from sparrowline.streaming import lines, messages
from sparrowline.streaming.messages import read_messages, save_messages, upsert_live
from sparrowline.streaming.run import append_live, drain, kept_rows


def feed(spark, tmp_path, schema, *batches):
    """A stream with one trigger per batch of rows."""
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def stored_rows(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    append_table(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


CHUNK = "session_id string, seq bigint, data binary, is_last boolean"


def drained(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    drain(append_live(stream, out, str(tmp_path / "checkpoint")), 120)
    return spark.read.schema(stream.schema).parquet(out)


def state_rows(spark, tmp_path, name):
    """What the state reader finds of a state after the stream was stopped."""
    reader = spark.read.format("statestore").option("stateVarName", name)
    return reader.load(str(tmp_path / "checkpoint")).count()


def cut(text, size=3):
    return [text[i : i + size] for i in range(0, len(text), size)]


def test_lines_of_replayed_late_and_unended_sessions(spark, tmp_path):
    pieces = cut("one é\n\n two\nthree \U0001f600\nend".encode())
    rows = [("a", i, bytearray(p), i == len(pieces) - 1) for i, p in enumerate(pieces)]
    unended = [("b", 0, bytearray(b"x\ny"), False)]
    gap = [("c", 0, bytearray(b"u\nv"), False), ("c", 2, bytearray(b"\nlost"), True)]
    replays = rows[:4] + unended + rows[-2:]
    stream = feed(spark, tmp_path, CHUNK, rows[5:7] + rows[1:2], rows[0:1] + unended + gap, rows[7:] + rows[5:6], rows[2:5], replays)
    found = drained(spark, stream_lines(stream, idle_ms=4000), tmp_path)
    lines = sorted((r.session_id, r.line_no, r.line) for r in found.collect())
    assert lines == [
        ("a", 0, "one é"),
        ("a", 2, "two"),
        ("a", 3, "three \U0001f600"),
        ("a", 4, "end"),
        ("b", 0, "x"),
        ("b", 1, "y"),
        ("c", 0, "u"),
        ("c", 1, "v"),
    ]
    assert state_rows(spark, tmp_path, "place") == 0
    assert state_rows(spark, tmp_path, "early") == 0


def test_debounce_equals_batch_without_a_closing_row(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    offsets = [0, 100, 400, 701, 1_500, 1_600, 9_000]
    rows = [("s", t0 + datetime.timedelta(milliseconds=ms), i, f"v{i}") for i, ms in enumerate(offsets)]
    rows += [("t", t0, 0, "early"), ("t", t0, 1, "later place"), ("u", t0, 0, None)]
    schema = "session_id string, ts timestamp, seq bigint, state string"
    # The third row comes after the fourth, within the delay.
    stream = feed(spark, tmp_path, schema, rows[:2] + rows[3:4], rows[2:3] + rows[7:], rows[4:5], rows[5:7])
    saved = drained(spark, stream_debounce(stream, delay_ms=500, idle_ms=4000), tmp_path)
    batch = ops.debounce_latest(spark.createDataFrame(rows, schema))
    key = lambda r: (r.session_id, r.ts)
    assert sorted(saved.collect(), key=key) == sorted(batch.select(*saved.columns).collect(), key=key)
    assert state_rows(spark, tmp_path, "open") == 0


LINE = "session_id string, seq bigint, line string, at bigint"


def events_of(spark, rows):
    return read_client_events(spark.createDataFrame(rows, LINE))


def test_messages_grow_by_what_arrives(spark, tmp_path):
    values = [{"event": "start"}, {"event": "token", "data": "Hi"}, {"event": "token", "data": " you"}, {"event": "end", "data": {"n": 1}}]
    rows = [("s", i, json.dumps(v), i) for i, v in enumerate(values)] + [("t", 0, json.dumps(values[1]), 0)]
    # The third event comes last, and one line comes twice.
    stream = feed(spark, tmp_path, LINE, rows[:2], rows[3:4] + rows[1:2], rows[4:], rows[2:3])
    out = str(tmp_path / "messages")
    save_messages(read_client_events(stream), out, str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(f"{out}/events").groupBy("batch").count().orderBy("batch").select("count").collect() == [(2,), (2,), (1,), (1,)]
    now = {r.session_id: r for r in read_messages(spark, out).collect()}
    batch = {r.session_id: r for r in ops.fold_messages(events_of(spark, rows)).collect()}
    assert now.keys() == batch.keys()
    for name in now:
        assert (now[name].content, now[name].events) == (batch[name].content, batch[name].events)
    assert (now["s"].latest, now["t"].latest) == ('end: {"n":1}', "")


def test_a_trigger_run_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "messages")
    rows = [("s", i, json.dumps({"event": "token", "data": f"t{i} "}), i) for i in range(8)]

    def store(number, part):
        path = f"{out}/events/batch={number}"
        messages._store(messages.as_pieces(events_of(spark, part)), path, "session_id")

    for number in range(4):
        store(number, rows[2 * number : 2 * number + 2])
    before = read_messages(spark, out).collect()
    store(3, rows[6:])
    assert read_messages(spark, out).collect() == before
    messages.compact_messages(spark, out, 1)
    messages.compact_messages(spark, out, 3)
    # Folded triggers that are run again are not read any more.
    store(2, rows[4:6])
    assert read_messages(spark, out).collect() == before
    assert before[0].content == "".join(f"t{i} " for i in range(8))
    folded = spark.read.parquet(f"{out}/pieces/upto=3")
    assert folded.select("first", "last").collect() == [(0, 7)]


def test_live_messages_take_their_place_in_a_history(spark, tmp_path):
    out = str(tmp_path / "messages")
    rows = [(s, i, json.dumps({"event": "token", "data": d}), i) for s in "ab" for i, d in enumerate(["so ", "far"])]
    messages._store(messages.as_pieces(events_of(spark, rows)), f"{out}/events/batch=0", "session_id")
    kind = "array<struct<name:string,data:string,at:bigint>>"
    schema = f"session_id string, role string, timestamp bigint, pos bigint, content string, events {kind}"
    history = spark.createDataFrame([("a", "user", 1, 0, "q", []), ("a", "assistant", 2, 1, "so", [])], schema)
    replies = spark.createDataFrame([("a", 2), ("b", 9)], "session_id string, timestamp bigint")
    merged = upsert_live(history, read_messages(spark, out), replies).collect()
    assert sorted((r.session_id, r.role, r.timestamp, r.content) for r in merged) == [
        ("a", "assistant", 2, "so far"),
        ("a", "user", 1, "q"),
        ("b", "assistant", 9, "so far"),
    ]


def test_a_restart_repeats_nothing(spark, tmp_path):
    schema = "request_id string, line string, include array<string>"
    rows = [("r", json.dumps({"event": "on_chat_model_stream", "data": {"chunk": "a"}}), None)]
    stream = feed(spark, tmp_path, schema, rows)
    assert stored_rows(spark, stream_events(stream), tmp_path).count() == 1
    again = stored_rows(spark, stream_events(stream), tmp_path).collect()
    assert [json.loads(r.line) for r in again] == [{"event": "token", "data": "a"}]


class Ending:
    """A stream whose state has ``rows[i]`` rows after its trigger ``i``; triggers take ``every`` seconds."""

    isActive = True
    status = {"isDataAvailable": False}

    def __init__(self, rows, every):
        self.rows, self.every, self.start, self.stopped = rows, every, time.monotonic(), False

    @property
    def lastProgress(self):
        number = int((time.monotonic() - self.start) / self.every)
        rows = self.rows[min(number, len(self.rows) - 1)]
        return {"timestamp": str(number), "numInputRows": 0, "stateOperators": [{"numRowsTotal": rows}]}

    def stop(self):
        self.stopped = True


def test_a_stream_may_take_longer_than_the_wait_while_its_state_goes():
    query = Ending([6, 5, 4, 3, 2, 1, 0], 0.25)
    drain(query, 0.8)
    assert query.stopped


def test_a_stream_whose_state_stays_is_given_up():
    query = Ending([6, 5], 0.1)
    with pytest.raises(TimeoutError):
        drain(query, 0.5)
    assert query.stopped


def test_sessions_share_their_state(spark, tmp_path):
    rows = [(f"s{i}", 0, bytearray(b"a\nb"), False) for i in range(3000)] + [(None, 0, bytearray(b"c\n"), False)]
    stream = feed(spark, tmp_path, CHUNK, rows)
    query = append_live(stream_lines(stream, idle_ms=600_000), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    until = time.monotonic() + 120
    while kept_rows(query) is None and time.monotonic() < until:
        time.sleep(0.1)
    query.stop()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(found) == 3001 and {(r.line_no, r.line) for r in found if r.session_id} == {(0, "a")}
    assert [(r.line_no, r.line) for r in found if r.session_id is None] == [(0, "c")]
    assert 0 < state_rows(spark, tmp_path, "place") <= lines.GROUPS


class Held:
    """State of one group of sessions, and its timers, in memory."""

    def __init__(self):
        self.value, self.map, self.timers, self.now = None, {}, set(), 0

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.value, update=lambda v: self.set(v), clear=lambda: self.set(None))

    def getMapState(self, name, key, schema):
        return SimpleNamespace(getValue=self.map.__getitem__, updateValue=self.map.__setitem__, removeKey=self.map.__delitem__)

    def set(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_lines_of_sessions_in_any_order_of_chunks():
    draw = random.Random(30)
    for _ in range(150):
        held, got, wanted, rows = Held(), [], [], []
        processor = lines._Lines("string", 100)
        processor.init(held)
        for name in ["a", "b", None, "d"][: draw.randint(1, 4)]:
            text = "".join(draw.choice("xy\né") for _ in range(draw.randint(1, 40)))
            pieces, gap, ended = cut(text.encode(), 4), draw.random() < 0.3, draw.random() < 0.7
            lost = draw.randrange(len(pieces)) if gap else len(pieces)
            rows += [(name, i, p, ended and i == len(pieces) - 1) for i, p in enumerate(pieces) if i != lost]
            rows += [draw.choice(rows) for _ in range(3) if rows]
            heard = b"".join(pieces[:lost]).decode("utf-8", "replace")
            wanted += [(name, i, x) for i, x in enumerate(heard.split("\n")) if x]
        draw.shuffle(rows)
        while rows:
            n = draw.randint(1, 8)
            packed = dict(zip(lines._COLUMNS, map(list, zip(*rows[:n], strict=True)), strict=True))
            got += processor.handleInputRows((0,), iter([packed]), held)
            rows, held.now = rows[n:], held.now + 1
            assert len(held.timers) == 1
        while held.timers:
            held.now = min(held.timers)
            held.timers.clear()
            got += processor.handleExpiredTimer((0,), held, None)
        key = lambda x: (str(x[0]), x[1])
        assert sorted((line for found in got for line in zip(*found, strict=True)), key=key) == sorted(wanted, key=key)
        assert held.value is None and not held.map

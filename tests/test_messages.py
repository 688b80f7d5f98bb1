"""The client side: worked examples, the whole round trip, and hot groups."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from sparrowline.operators import messages as ops
from sparrowline.operators.ordered import concat_ordered, concat_parts, fold_ordered, running_total
from sparrowline.plans import client as plan
from sparrowline.sources import history


def chunked(spark, data, size, session="s"):
    pieces = [data[i : i + size] for i in range(0, len(data), size)]
    rows = [(session, i, bytearray(piece)) for i, piece in enumerate(pieces)]
    return spark.createDataFrame(rows, "session_id string, seq bigint, data binary")


def client_lines(spark, *values):
    rows = [("s", i, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False), 100 + i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "session_id string, seq bigint, line string, at bigint")


@pytest.mark.parametrize("size", [1, 2, 3, 37, 10_000])
def test_lines_from_chunks(spark, size):
    data = "﻿ one é\n\n \t\n\U0001f600 two\r\n three \nlast".encode()
    rows = ops.reassemble_lines(chunked(spark, data, size)).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == [(0, "one é"), (3, "\U0001f600 two"), (4, "three"), (5, "last")]


def test_broken_bytes_become_replacement_characters(spark):
    rows = ops.reassemble_lines(chunked(spark, b"a\xffb\nc\xe2\x82", 2)).orderBy("line_no").collect()
    assert [r.line for r in rows] == ["a�b", "c�"]


def test_fold(spark):
    lines = client_lines(
        spark,
        {"event": "on_chat_model_start", "data": {"b": 1, "a": "é"}},
        {"event": "token", "data": "Blue"},
        {"event": "token", "data": 5},
        "5",
        "null",
        "{",
        '{"event":"token","data":"x"} y',
        {"event": "token", "data": " heron"},
        {"event": 7},
        {"event": "on_chat_model_end", "data": "done"},
    )
    events = ops.read_client_events(lines)
    row = ops.fold_messages(events).first()
    assert row.content == "Blue heron"
    assert [(e.name, e.data, e.at) for e in row.events] == [
        ("on_chat_model_start", '{"b":1,"a":"é"}', 100),
        ("event", "null", 103),
        ("event", "null", 108),
        ("on_chat_model_end", '"done"', 109),
    ]
    assert ops.latest_event(events).first().latest == "on_chat_model_end: done"
    assert ops.latest_event(events.filter("seq < 4")).first().latest == "event: "
    assert ops.latest_event(events.filter("seq = 1")).first().latest == ""
    over = spark.createDataFrame([("s",)], "session_id string")
    assert ops.latest_event(events, finished=over).first().latest == ""


def test_no_message_without_tokens_and_events(spark):
    events = ops.read_client_events(client_lines(spark, {"event": "token", "data": ""}, {"event": "token", "data": None}, "{"))
    assert ops.fold_messages(events).count() == 0


def test_upsert(spark):
    messages = spark.createDataFrame(
        [("s", "user", 1, 0, "u"), ("s", "assistant", 2, 1, "old")], "session_id string, role string, timestamp bigint, pos bigint, content string"
    )
    updates = spark.createDataFrame(
        [("s", "assistant", 2, 0, "a", False), ("s", "assistant", 2, 1, "ab", False), ("s", "assistant", 3, 0, "n", False),
         ("s", "assistant", 4, 5, "x", True), ("s", "assistant", 4, 6, "xy", False)],
        "session_id string, role string, timestamp bigint, seq bigint, content string, ensure_create boolean",
    )
    rows = ops.message_upsert(messages, updates).orderBy("timestamp").collect()
    assert [(r.timestamp, r.pos, r.added, r.content) for r in rows] == [(1, 0, None, "u"), (2, 1, None, "ab"), (4, None, 5, "xy")]


def test_errors_are_appended(spark):
    messages = spark.createDataFrame([("b", "assistant", "part", 1)], "session_id string, role string, content string, timestamp bigint")
    sessions = spark.createDataFrame([("a", "error", 9), ("b", "aborted", 9), ("c", "done", 9)], "session_id string, status string, timestamp bigint")
    rows = ops.append_error(messages, sessions).orderBy("session_id").collect()
    assert [(r.session_id, r.content) for r in rows] == [("a", "Error contacting server."), ("b", "part")]


def test_history_defaults(spark):
    texts = [
        ("a", '[{"role":"user","content":"x","timestamp":7},{"role":"assistant","content":"y","events":[1]},{"content":"z","events":"q"}]'),
        ("b", "[1,"), ("c", None), ("d", '{"role":"user"}'), ("e", "[null]"), ("f", "[]"), ("g", '[{"timestamp":null}] x'),
    ]
    rows = ops.history_load(spark.createDataFrame(texts, "session_id string, history string"), 100).orderBy("pos").collect()
    assert [(r.session_id, r.pos, r.role, r.content, r.timestamp, len(r.events)) for r in rows] == [
        ("a", 0, "user", "x", 7, 0), ("a", 1, "assistant", "y", 1100, 1), ("a", 2, None, "z", 2100, 0),
    ]


def test_histories_are_stored(spark, tmp_path):
    path = str(tmp_path / "h")
    assert history.read_histories(spark, path, 0).count() == 0
    messages = spark.createDataFrame(
        [("s", 1, "assistant", 'q"é\n', 5), ("s", 0, "user", "p", 4)], "session_id string, seq bigint, role string, content string, timestamp bigint"
    )
    history.write_histories(messages, path)
    rows = history.read_histories(spark, path, 0).orderBy("pos").collect()
    assert [(r.role, r.content, r.timestamp) for r in rows] == [("user", "p", 4), ("assistant", 'q"é\n', 5)]


def test_debounce_keeps_the_last_state_of_each_burst(spark):
    t0 = datetime.datetime(2024, 1, 1, 0, 59, 59, 900_000)
    offsets = [0, 100, 400, 701, 701, 5_000]
    rows = [("s", t0 + datetime.timedelta(milliseconds=ms), i, f"v{i}") for i, ms in enumerate(offsets)]
    updates = spark.createDataFrame(rows, "session_id string, ts timestamp, seq bigint, state string")
    saved = ops.debounce_latest(updates).orderBy("ts").collect()
    assert [r.state for r in saved] == ["v2", "v4", "v5"]
    assert [r.state for r in ops.debounce_latest(updates, 10_000).collect()] == ["v5"]


def test_round_trip(spark):
    """Tokens in event lines, cut every 37 bytes, give the tokens' text again."""
    tokens = [f"tök{i} " for i in range(50)] + ["\n", '"', "\U0001f600"]
    events = [{"event": "on_chat_model_start", "data": {"input": "x"}}]
    events += [{"event": "token", "data": token} for token in tokens]
    data = "".join(json.dumps(e, ensure_ascii=False) + "\n" for e in events).encode()
    sessions = spark.createDataFrame([("s", 8, "done"), ("t", 9, "error")], "session_id string, timestamp bigint, status string")
    rows = plan.receive_messages(chunked(spark, data, 37), sessions).orderBy("session_id").collect()
    assert rows[0].content == "".join(tokens) and len(rows[0].events) == 1 and rows[0].timestamp == 8
    assert rows[1].content == "Error contacting server."
    replies = plan.receive_messages(chunked(spark, data, 37), sessions).withColumn("seq", F.lit(1))
    user = spark.createDataFrame([("s", 0, "user", "q", 7)], "session_id string, seq int, role string, content string, timestamp bigint")
    saved = {r.session_id: json.loads(r.history) for r in plan.store_histories(user, replies).collect()}
    assert [m["role"] for m in saved["s"]] == ["user", "assistant"]
    assert saved["s"][1]["content"] == "".join(tokens)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; order values have gaps."""
    rows = [("hot", i * 3, i % 7, f"{i},") for i in range(2000)] + [("cold", 5, 1, "x"), ("cold", 4, None, None)]
    return spark.createDataFrame(rows, "k string, o bigint, v bigint, t string").repartition(6)


def test_running_total_over_blocks(skewed):
    rows = running_total(skewed.filter("v is not null"), ["k"], "o", "v", "total", block=100).filter("k = 'hot'").orderBy("o").collect()
    total = 0
    for row in rows:
        assert row.total == total
        total += row.v


def test_ordered_folds_over_blocks(skewed):
    text = "".join(f"{i}," for i in range(2000))
    joined = {r.k: r.x for r in concat_ordered(skewed, ["k"], "o", "t", "x", block=50).collect()}
    assert joined == {"hot": text, "cold": "x"}
    parts = concat_parts(skewed, ["k"], "o", "t", "x", block=50).filter("k = 'hot'").orderBy("part").collect()
    assert len(parts) == 120 and "".join(r.x for r in parts) == text
    folded = fold_ordered(skewed, ["k"], "o", lists={"vs": F.col("v")}, last="end", block=50)
    rows = {r.k: r for r in folded.collect()}
    assert rows["hot"].vs == [i % 7 for i in range(2000)] and rows["hot"].end == 5997
    assert rows["cold"].vs == [1]


def test_lines_over_many_blocks(spark, monkeypatch):
    """Lines inside blocks, across two, and across many give the same rows."""
    from sparrowline.operators import ordered

    text = "".join(("é" * (i % 97) + "\n") if i % 11 else "long " * 60 for i in range(300))
    data = text.encode()
    expected = [(n, line.strip()) for n, line in enumerate(text.split("\n")) if line.strip()]
    original = ordered.running_total_in_blocks
    monkeypatch.setattr(ops, "running_total_in_blocks", lambda *args: original(*args, block=8))
    rows = ops.reassemble_lines(chunked(spark, data, 5)).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == expected


def test_only_the_first_of_equal_messages_is_updated(spark):
    messages_ = spark.createDataFrame(
        [("s", "assistant", "t", 0, "old"), ("s", "assistant", "t", 3, "old")], "session_id string, role string, timestamp string, pos int, content string"
    )
    updates = spark.createDataFrame(
        [("s", "assistant", "t", 1, False, "new")],
        "session_id string, role string, timestamp string, seq int, ensure_create boolean, content string",
    )
    got = ops.message_upsert(messages_, updates, values=["content"])
    assert {(r.pos, r.content) for r in got.collect()} == {(0, "new"), (3, "old")}


def test_the_last_of_repeated_keys_counts(spark):
    lines = client_lines(
        spark,
        '{"event":"n","data":{"a":1},"data":{"b":2}}',
        '{"event":"n","data":{"z":1,"a":1,"a":2}}',
        '{"event":"n","data":{"z":1,"a":[2,{"y":1,"x":2}]}}',
    )
    rows = ops.read_client_events(lines).orderBy("seq").collect()
    assert [r.data for r in rows] == ['{"b":2}', '{"a":2,"z":1}', '{"z":1,"a":[2,{"y":1,"x":2}]}']
    assert [r.summary for r in rows] == [r.data for r in rows]


def test_histories_keep_events(spark):
    lines = client_lines(spark, {"event": "note", "data": {"b": [1], "a": "x"}}, {"event": "token", "data": "Hi"}, {"event": "end"})
    replies = ops.fold_messages(ops.read_client_events(lines)).selectExpr(
        "session_id", "1L seq", "'assistant' role", "content", "5L timestamp", "events"
    )
    user = spark.createDataFrame([("s", 0, "user", "p", 4)], "session_id string, seq bigint, role string, content string, timestamp bigint")
    saved = plan.store_histories(user, replies)
    first, second = json.loads(saved.first().history)
    assert first == {"role": "user", "content": "p", "timestamp": 4}
    assert [(e["name"], e.get("data"), e["at"]) for e in second["events"]] == [("note", {"b": [1], "a": "x"}, 100), ("end", None, 102)]
    loaded = ops.history_load(saved, 0).withColumn("seq", F.col("pos"))
    again = json.loads(ops.history_save(loaded).first().history)
    assert again[0]["events"] == [] and again[1] == second


def test_unknown_fields_of_stored_messages_are_kept(spark):
    stored = [
        {"role": "user", "content": "q", "timestamp": 5, "events": [], "pinned": True, "note": {"a": [1, None]}},
        {"role": "assistant", "content": "r", "timestamp": 6, "events": []},
        {"pinned": None},
    ]
    histories = spark.createDataFrame([("s", json.dumps(stored))], "session_id string, history string")
    loaded = ops.history_load(histories, 100)
    assert [json.loads(r.extra) if r.extra else None for r in loaded.orderBy("pos").collect()] == [
        {"pinned": True, "note": {"a": [1, None]}},
        None,
        {"pinned": None},
    ]
    saved = json.loads(ops.history_save(loaded.withColumn("seq", F.col("pos"))).first().history)
    assert saved[:2] == stored[:2]
    assert saved[2] == {"timestamp": 2100, "events": [], "pinned": None}

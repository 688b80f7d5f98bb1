"""Worked examples of the event operators, with their expected rows."""

import json

import pytest
from pyspark.sql import functions as F

from sparrowline.functions import chat, jsonval
from sparrowline.operators import events as ops
from sparrowline.operators import requests as request_ops
from sparrowline.plans import chat as plan
from sparrowline.sources import ndjson

START = {"event": "on_chat_model_start", "data": {"input": "hi"}}
STREAM = {"event": "on_chat_model_stream", "data": {"chunk": {"content": "hello", "text": "hello"}}}
END = {"event": "on_chat_model_end", "data": {"output": "hello"}}
TOKEN = {"event": "token", "data": "hello"}


def lines(spark, *values, include=None, request="r"):
    rows = [(request, i, v if isinstance(v, str) else json.dumps(v), include) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "request_id string, seq bigint, line string, include array<string>")


def sent(spark, *values, include=None):
    result = ops.serialize_events(lines(spark, *values, include=include)).orderBy("seq").collect()
    assert all(r.line.endswith("\n") for r in result)
    return [json.loads(r.line) for r in result]


def one(spark, column, **values):
    schema = ", ".join(f"{name} string" for name in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "body, message",
    [
        ('{"message":"hello"}', "hello"),
        ('{"message":" x "}', "x"),
        ('{"message":"a","other":[1]}', "a"),
        ('{"message":"a","message":"b"}', "b"),
        ('{"message":""}', None),
        ('{"message":"  "}', None),
        ('{"message":5}', None),
        ('{"message":null}', None),
        ('{"foo":"bar"}', None),
        ('{"message":"a"} x', None),
        ("5", None),
        ("null", None),
        ("", None),
        (None, None),
        ('["message"]', None),
    ],
)
def test_requests(spark, body, message):
    row = request_ops.validate_requests(spark.createDataFrame([(body,)], "body string")).first()
    assert (row.message, row.ok) == (message, message is not None)
    assert row.error == (None if row.ok else "Invalid request data")


@pytest.mark.parametrize(
    "argument, names",
    [(" a ,,b", ["a", "b", "token"]), ("", None), (None, None), (" , ", None), ("token", ["token"]), ("é,z,z", ["token", "z", "é"])],
)
def test_include_lists(spark, argument, names):
    df = spark.createDataFrame([(argument,)], "include_arg string")
    assert request_ops.parse_include(df).first().include == names


def test_route_tag(spark):
    assert request_ops.tag_route(spark.range(1)).first().metadata == {"route": "/chat"}


@pytest.mark.parametrize(
    "line, value",
    [
        ('{"a":1}', '{"a":1}'),
        (' {"a":1} ', '{"a":1}'),
        ('{"a":1,"a":2}', '{"a":2}'),
        ("5", "5"),
        ("null", "null"),
        ('{"a":1} x', None),
        ('{"a":1}}', None),
        ("[1]]", None),
        ("1]", None),
        ("1}", None),
        ("1,2", None),
        ('1,"w":2', None),
        ('1,""] ', None),
        ('{"a":', None),
        ("", None),
        (None, None),
    ],
)
def test_strict_parsing(spark, line, value):
    assert one(spark, F.to_json(jsonval.parse_strict(F.col("line"))), line=line) == value


@pytest.mark.parametrize(
    "chunk, text",
    [
        ("null", ""),
        ('"hi"', "hi"),
        ('""', ""),
        ('{"content":"a","text":"b"}', "a"),
        ('{"content":"","text":"b"}', "b"),
        ('{"content":0,"text":false,"message":"m"}', "m"),
        ('{"message":{"message":{"content":"deep"}}}', "deep"),
        ('{"message":' * 40 + '{"text":"deeper"}' + "}" * 40, "deeper"),
        ('{"message":' * 5 + '"end"' + "}" * 5, "end"),
        ('{"message":{"content":"","message":{"note":"\\"message\\"","message":null}}}', ""),
        ('{"content":[{"x":1}]}', '[{"x":1}]'),
        ('{"content":7}', "7"),
        ('{"content":[],"text":{}}', ""),
        ("5", ""),
        ('["a"]', ""),
    ],
)
def test_chunk_text(spark, chunk, text):
    assert one(spark, chat.chunk_text(F.parse_json(F.col("c"))), c=chunk) == text


@pytest.mark.parametrize(
    "data, token",
    [
        ('{"chunk":"a","token":"b"}', "a"),
        ('{"chunk":"","token":"b"}', "b"),
        ('{"token":{"text":"","content":5,"value":"v"}}', "v"),
        ('{"token":5}', ""),
        ("[1]", ""),
        ('"text"', ""),
    ],
)
def test_token_text(spark, data, token):
    assert one(spark, chat.token_text(F.parse_json(F.concat(F.lit('{"data":'), "d", F.lit("}")))), d=data) == token


def test_tokens_of_whole_tables_are_those_of_single_events(spark):
    values = ["null", '""', '"0"', '"[]"', "0", "-0.0", "0e0", "1.5", "false", "true", "[]", "[1]", "{}"]
    values += ['{"text":"t"}', '{"content":"false"}', '{"content":0.0,"text":"-0"}', '{"value":"v"}', '{"message":{"message":"m"}}']
    texts = [f'{{"data":{{"chunk":{a},"token":{b}}}}}' for a in values for b in values]
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "seq int, line string")
    both = ops.extract_tokens(ops.normalise_events(rows)).withColumn("single", chat.token_text(F.col("payload"))).collect()
    assert len(both) == len(texts) and all(row.token == row.single for row in both)
    assert {row.line: row.token for row in both}['{"data":{"chunk":{"content":0.0,"text":"-0"},"token":0}}'] == "-0"


def test_events_are_read_without_lambdas(spark):
    """Spark interprets lambdas, and all that shares their step; nested messages need one."""
    plan_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    events = ops.normalise_events(lines(spark, START, STREAM).select("request_id", "seq", "line"))
    assert not [step for step in plan_of(events) if "lambda" in step]
    steps = [step for step in plan_of(ops.extract_tokens(events)) if "lambda" in step]
    assert len(steps) == 1 and "_nested" in steps[0]
    bodies = spark.createDataFrame([('{"message":"x"}',)], "body string")
    assert not [step for step in plan_of(request_ops.validate_requests(bodies)) if "lambda" in step]


@pytest.mark.parametrize(
    "value, empty",
    [("null", True), ('""', True), ("[]", True), ("{}", True), ("0", False), ("false", False), ('" "', False), ("[null]", False)],
)
def test_emptiness(spark, value, empty):
    assert one(spark, jsonval.is_empty(F.parse_json(F.col("v"))), v=value) is empty


@pytest.mark.parametrize(
    "value, pruned",
    [
        ('{"event":"x","data":{"a":{"b":""},"n":0,"f":false,"l":["",null,1]}}', {"event": "x", "data": {"n": 0, "f": False, "l": [1]}}),
        ('{"event":"x","data":{"a":{"b":""}}}', {"event": "x"}),
        ('{"a":[[],[[]],[{"b":null}]]}', {}),
        ("[]", []),
        ('{"a":"null"}', {"a": "null"}),
        ('{"z":1,"é":"\\ud83d\\ude00"}', {"z": 1, "é": "\U0001f600"}),
    ],
)
def test_pruning(spark, value, pruned):
    df = spark.createDataFrame([(value,)], "line string")
    assert json.loads(ops.prune_payload(df).first().line) == pruned


def test_model_events_pass_and_tokens_are_renamed(spark):
    assert sent(spark, START, STREAM, END) == [START, TOKEN, END]


def test_include_lists_filter_events(spark):
    assert sent(spark, START, STREAM, END, include=["token"]) == [TOKEN]
    assert sent(spark, START, STREAM, END, include=["on_chat_model_end"]) == [END]
    assert sent(spark, START, STREAM, END, include=["on_chat_model_end", "token"]) == [TOKEN, END]
    assert sent(spark, START, STREAM, END, include=["all"]) == [START, TOKEN, END]
    assert sent(spark, START, STREAM, END, include=[]) == [START, TOKEN, END]
    assert sent(spark, {"event": 5, "data": 1}, include=["5"]) == []
    assert sent(spark, {"event": 5, "data": 1}, include=["all_events"]) == [{"event": 5, "data": 1}]


def test_what_is_no_event_is_dropped(spark):
    empty = {"event": "on_chat_token_stream", "data": {"chunk": ""}}
    assert sent(spark, "[1]", '"x"', "5", "null", '{"a":', '{"event":"x"} y', empty) == []
    assert sent(spark, {}) == [{}]


@pytest.mark.parametrize(
    "text, line",
    [
        ("hello", '{"event":"token","data":"hello"}\n'),
        ("a\n", '{"event":"token","data":"a"}\n'),
        ("a\n\n b", '{"event":"token","data":"a\\n\\n b"}\n'),
        ("{x}", "{x}\n"),
        (" {x}\n", " {x}\n"),
        ("{x} \n ", "{x} \n \n"),
        ("{x} y", '{"event":"token","data":"{x} y"}\n'),
        ("", '{"event":"token","data":""}\n'),
    ],
)
def test_line_coercion(spark, text, line):
    assert one(spark, chat.to_event_line(F.col("t")), t=text) == line


def envelope(spark, message, tokens, include=None):
    requests = spark.createDataFrame([("r", message, include)], "request_id string, message string, include array<string>")
    words = spark.createDataFrame([("r", i, t) for i, t in enumerate(tokens)], "request_id string, seq bigint, token string")
    rows = ops.event_envelope(requests, words).orderBy("ord").collect()
    assert len({r.ord for r in rows}) == len(rows)
    return [json.loads(r.text) if r.text.startswith("{") else r.text for r in rows]


def test_fallback_envelope(spark):
    def start(text):
        return {"event": "on_chat_model_start", "data": {"input": text}}

    def end(text):
        return {"event": "on_chat_model_end", "data": {"output": text}}

    assert envelope(spark, "red kite", ["red", "kite"]) == [start("red kite"), "red", "kite", end("redkite")]
    assert envelope(spark, "owl", ["red", "", "kite"], ["token"]) == ["red", "kite"]
    assert envelope(spark, "owl", ["a", "b"], ["on_chat_model_end"]) == [end("owl")]
    assert envelope(spark, "owl", ["a", "b"], ["all"]) == [start("owl"), end("owl")]
    assert envelope(spark, "owl", []) == [start("owl"), end("owl")]
    assert envelope(spark, "owl", ["a"], ["other"]) == []


def test_fallback_only_where_nothing_was_sent(spark):
    requests = spark.createDataFrame([("a", "m", None), ("b", "n", None)], "request_id string, message string, include array<string>")
    words = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "request_id string, seq bigint, token string")
    emitted = lines(spark, END, request="a").select("request_id", "seq", "line")
    rows = ops.event_fallback(emitted, requests, words).orderBy("request_id", "ord").collect()
    assert [r.request_id for r in rows] == ["a", "b", "b", "b"]
    assert json.loads(rows[0].text) == END


def test_responses_over_the_route(spark):
    bodies = spark.createDataFrame(
        [("a", '{"message":"three geese"}', ""), ("b", '{"message":""}', ""), ("c", '{"message":"swan"}', "on_chat_model_end")],
        "request_id string, body string, include_arg string",
    )
    words = spark.createDataFrame(
        [("a", 0, "three"), ("a", 1, "geese"), ("b", 0, "no"), ("c", 0, "unused")], "request_id string, seq bigint, token string"
    )
    events = lines(spark, START, STREAM, END, request="c").select("request_id", "seq", "line")
    requests = plan.accept_requests(bodies)
    responses = plan.respond(requests, events, words)
    got = {}
    for row in responses.orderBy("ord").collect():
        got.setdefault(row.request_id, []).append(json.loads(row.line))
    assert got == {
        "a": [
            {"event": "on_chat_model_start", "data": {"input": "three geese"}},
            {"event": "token", "data": "three"},
            {"event": "token", "data": "geese"},
            {"event": "on_chat_model_end", "data": {"output": "threegeese"}},
        ],
        "c": [TOKEN, END],
    }
    assert {r.request_id: r.text for r in plan.respond_tokens(responses).collect()} == {"a": "threegeese", "c": "hello"}


def test_token_mode_skips_the_rest(spark):
    rows = lines(spark, TOKEN, {"event": "token", "data": ""}, {"event": "token", "data": 5}, START, "{", "[]")
    assert [r.token for r in ops.token_stream(rows).collect()] == ["hello"]


def test_ndjson_files(spark, tmp_path):
    path = str(tmp_path / "lines")
    ndjson.write_ndjson(lines(spark, '{"a":1}\n', '{"a":2}', "oops {"), path)
    read = ndjson.read_ndjson(spark, path).select(F.to_json("payload").alias("p")).collect()
    assert sorted(r.p for r in read) == ['{"a":1}', '{"a":2}']


def test_deep_and_spread_out_lines_are_pruned(spark):
    deep = '{"a":' * 900 + '{"x":null,"y":1}' + "}" * 900
    lines = [deep, '{\n  "event": "x",\n  "data": 1\n}', '{"a":{"b":[{},[[]],""]},"c":[0,false]}']
    frame = spark.createDataFrame([(line,) for line in lines], "line string")
    got = [r[0] for r in frame.select(jsonval.prune(F.col("line"))).collect()]
    assert got == ['{"a":' * 900 + '{"y":1}' + "}" * 900, '{"event":"x","data":1}', '{"c":[0,false]}']

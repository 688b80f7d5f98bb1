"""Chat inputs derived from the given tables, in Spark and in SQL.

Every turn of ``conversations`` stands for one request: its text is the message,
its words are the tokens a model would stream back. All rows are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import sql_words, table
from sparrowline.functions.text import words

# Model stream events around a token: text before and after it. The last form
# carries no token at all.
STREAM_FORMS = (
    ('{"event":"on_chat_model_stream","data":{"chunk":', "}}"),
    ('{"event":"on_chat_model_stream","data":{"chunk":{"content":', ',"id":null}}}'),
    (
        '{"event":"on_chat_token_stream","data":{"chunk":{"content":"","message":'
        '{"message":{"message":{"message":{"message":{"text":',
        "}}}}}}}}",
    ),
    ('{"event":"on_chat_token_stream","data":{"token":', "}}"),
    ('{"event":"on_chat_model_stream","data":{"chunk":"","token":{"text":"","value":', "}}}"),
    ('{"event":"on_chat_model_stream","data":{"chunk":{"content":[],"text":""},"note":', "}}"),
)
START_FORM = ('{"event":"on_chat_model_start","tags":[],"data":{"input":', ',"notes":[null,""],"meta":{"n":0,"f":false,"a":{"b":""}}}}')
END_FORM = ('{"event":"on_chat_model_end","data":{"output":', "}}")
# Lines of each role that are no regular events.
ODD_LINES = {
    "user": '{"event":5,"data":{"z":[1,{"y":""}],"x":"é"}}',
    "assistant": '{"event":"custom","data":1} tail',
    "system": '["no","object"]',
}

# Client lines around a token, by the token's place.
CLIENT_FORMS = (
    ('{"event":"token","data":', "}"),
    ('  {"event":"token","data":', '} '),
    ('{"event":"note","data":{"text":', ',"list":[1,2]}}'),
    ('{"data":', "}"),
    ("", ""),
    ('{"event":"token","data":{"text":', "}}"),
    ('{"event":"token","data":', "} oops"),
)

INCLUDES = (None, ["on_chat_model_end"], ["all"], ["token"], ["on_chat_model_start", "on_chat_token_stream"])


def json_text(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def choose(number: Column, options: list[Column]) -> Column:
    """The option whose place is ``number`` modulo their count."""
    return F.element_at(F.array(*options), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def wrap(form: tuple[str, str], text: Column) -> Column:
    return F.concat(F.lit(form[0]), json_text(text), F.lit(form[1]))


def wrap_by(number: Column, forms: tuple, text: Column) -> Column:
    """``text`` in the form whose place is ``number`` modulo their count."""
    before, after = (choose(number, [F.lit(form[i]) for form in forms]) for i in (0, 1))
    return F.concat(before, json_text(text), after)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("request_id", F.concat_ws("-", "conv_id", "turn"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    includes = [
        F.lit(None).cast("array<string>") if names is None else F.array(*map(F.lit, names)) for names in INCLUDES
    ]
    return turns(spark, sf_dir).select(
        "request_id", F.col("text").alias("message"), choose(F.col("turn"), includes).alias("include")
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("request_id", F.posexplode(words(F.col("text"))).alias("seq", "token"))


def model_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, seq, line)``: start, one stream event per word, end, and a
    line that is no regular event."""
    text = F.col("text")
    odd = F.create_map(*[F.lit(item) for pair in ODD_LINES.items() for item in pair])
    streams = F.transform(words(text), lambda w, i: wrap_by(i, STREAM_FORMS, w))
    lines = F.concat(
        F.array(wrap(START_FORM, text)), streams, F.array(wrap(END_FORM, text), odd[F.col("role")])
    )
    return turns(spark, sf_dir).select("request_id", F.posexplode(lines).alias("seq", "line"))


def client_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(session_id, seq, line, at)``: lines as the client receives them."""
    text = F.col("text")
    lines = F.transform(words(text), lambda w, i: wrap_by(i, CLIENT_FORMS, w))
    return (
        turns(spark, sf_dir)
        .select(F.col("request_id").alias("session_id"), F.posexplode(lines).alias("seq", "line"))
        .withColumn("at", F.col("seq").cast("bigint") * 10)
    )


# The same in SQL.


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_wrap(form: tuple[str, str], text: str) -> str:
    return f"{_sql_text(form[0])} || to_json({text})::VARCHAR || {_sql_text(form[1])}"


def sql_choose(number: str, options: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {option}" for i, option in enumerate(options))
    return f"CASE ({number}) % {len(options)} {cases} END"


SQL_TURNS = f"""SELECT *, conv_id || '-' || turn AS request_id, {sql_words("text")} AS words FROM conversations"""

SQL_TOKENS = f"""SELECT request_id, (i - 1)::INTEGER AS seq, words[i] AS token
    FROM (SELECT request_id, words, unnest(range(1, len(words) + 1)) AS i FROM ({SQL_TURNS}))"""

_SQL_INCLUDES = ["NULL::VARCHAR[]" if names is None else str(names) for names in INCLUDES]
SQL_REQUESTS = f"""SELECT request_id, text AS message, {sql_choose("turn", _SQL_INCLUDES)} AS include
    FROM ({SQL_TURNS})"""

_ODD = " ".join(f"WHEN {_sql_text(role)} THEN {_sql_text(line)}" for role, line in ODD_LINES.items())
SQL_MODEL_EVENTS = f"""SELECT request_id, 0::INTEGER AS seq, {sql_wrap(START_FORM, "text")} AS line FROM ({SQL_TURNS})
    UNION ALL SELECT request_id, seq + 1, {sql_choose("seq", [sql_wrap(form, "token") for form in STREAM_FORMS])}
    FROM ({SQL_TOKENS})
    UNION ALL SELECT request_id, (len(words) + 1)::INTEGER, {sql_wrap(END_FORM, "text")} FROM ({SQL_TURNS})
    UNION ALL SELECT request_id, (len(words) + 2)::INTEGER, CASE role {_ODD} END FROM ({SQL_TURNS})"""

SQL_CLIENT_LINES = f"""SELECT request_id AS session_id, seq,
    {sql_choose("seq", [sql_wrap(form, "token") for form in CLIENT_FORMS])} AS line, seq::BIGINT * 10 AS "at"
    FROM ({SQL_TOKENS})"""

"""Chat requests: validation, include lists and route tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.functions import chat, jsonval
from sparrowline.functions.binding import with_computed
from sparrowline.functions.text import REQUEST_SPACE, strip


def validate_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add ``ok``, ``message`` and ``error``. A body is accepted when it is a JSON
    object whose ``message`` is a string with more than white space in it."""
    # Bodies that cannot name the field, in letters or escaped, are not parsed.
    named = F.when(F.col(body).contains('"message"') | F.col(body).contains("\\"), F.col(body))
    # In steps without lambdas, which Spark compiles.
    listed = with_computed(requests.withColumn("_named", named), _listed=jsonval.listed(F.col("_named")))
    value = jsonval.field(jsonval.only_value(F.col("_listed"), F.col("_named")), "$.message")
    found = with_computed(listed, _message=value)
    text = with_computed(found, _text=strip(jsonval.typed_string(F.col("_message")), REQUEST_SPACE))
    checked = text.withColumn("message", chat.filled(F.col("_text"))).drop("_named", "_listed", "_message", "_text")
    return checked.withColumn("ok", F.col("message").isNotNull()).withColumn(
        "error", F.when(~F.col("ok"), F.lit(chat.INVALID_REQUEST))
    )


def parse_include(requests: DataFrame, argument: str = "include_arg", out: str = "include") -> DataFrame:
    """Add the include list read from a comma-separated argument."""
    return requests.withColumn(out, chat.parse_include(F.col(argument)))


def parse_mode(requests: DataFrame, argument: str = "stream_arg", out: str = "mode") -> DataFrame:
    """Add how the response is wanted: the argument in lower case, ``events`` if there is none."""
    return requests.withColumn(out, F.coalesce(F.lower(argument), F.lit(chat.EVENT_MODE)))


def tag_route(requests: DataFrame, route: str = "/chat") -> DataFrame:
    """Add ``metadata`` naming the route the request came by."""
    return requests.withColumn("metadata", F.create_map(F.lit("route"), F.lit(route)))

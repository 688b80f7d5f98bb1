"""Input tables of the registered queries, and SQL snippets shared by oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowline import prepare
from sparrowline.functions.text import WORD_SPACE, char_class
from sparrowline.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def sql_words(text: str) -> str:
    """DuckDB: array of the white-space separated words of ``text``."""
    return f"list_filter(string_split_regex({text}, '[{char_class(WORD_SPACE)}]+'), lambda w: w <> '')"


def sql_strip(text: str, space: str = WORD_SPACE) -> str:
    """DuckDB: ``text`` without outer white space."""
    return rf"regexp_replace({text}, '^[{char_class(space)}]+|[{char_class(space)}]+\z', '', 'g')"

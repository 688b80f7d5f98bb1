"""Answers from retrieved chunks: a map step per chunk, a reduce step per query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowline.functions.text import distinct_words, sentences
from sparrowline.session import materialise


def best_sentence(question: Column, chunk: Column) -> Column:
    """The chunk's sentence that shares most distinct words with the question,
    the earliest of equals; empty when none shares any."""
    asked = distinct_words(question)
    scored = F.transform(
        sentences(chunk),
        lambda s, i: F.struct(F.size(F.array_intersect(asked, distinct_words(s))).alias("n"), (-i).alias("i"), s.alias("s")),
    )
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["s"]).otherwise(F.lit(""))


def distinct_lines(question: Column, partials: Column) -> Column:
    """The distinct non-empty partial answers, one per line."""
    return F.array_join(F.array_distinct(F.filter(partials, lambda p: p != "")), "\n")


@dataclass(frozen=True)
class Generator:
    """How answers are made: ``map_fn(question, chunk)`` gives a partial answer,
    ``reduce_fn(question, partials)`` folds them. ``prompt_fn`` shapes the
    question first. All three work on columns."""

    map_fn: Callable[[Column, Column], Column] = best_sentence
    reduce_fn: Callable[[Column, Column], Column] = distinct_lines
    prompt_fn: Callable[[Column], Column] = lambda question: question


def from_model(
    load: Callable[[], tuple[Callable, Callable]], prompt_fn: Callable[[Column], Column] = lambda question: question
) -> Generator:
    """Wrap a model. ``load`` runs once per task and returns two functions:
    ``(questions, chunks) -> answers`` and ``(questions, lists of partials) ->
    answers``, each over pandas series."""

    @F.pandas_udf(T.StringType())
    def map_step(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        answer, _ = load()
        for questions, chunks in batches:
            yield answer(questions, chunks)

    @F.pandas_udf(T.StringType())
    def reduce_step(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        _, fold = load()
        for questions, partials in batches:
            yield fold(questions, partials)

    return Generator(map_step, reduce_step, prompt_fn)


def qa_map(retrieved: DataFrame, generator: Generator = Generator(), text: str = "question") -> DataFrame:
    """Add ``partial``: the generator's answer from each retrieved chunk."""
    return retrieved.withColumn("partial", generator.map_fn(generator.prompt_fn(F.col(text)), F.col("chunk")))


def qa_reduce(
    partials: DataFrame,
    generator: Generator = Generator(),
    query_id: str = "query_id",
    text: str = "question",
    budget: int | None = None,
) -> DataFrame:
    """One ``result`` per query from its partial answers, in rank order.

    Without a ``budget`` a query's partials, at most ``k``, are folded at once. With one,
    neighbouring partials of about ``budget`` characters together are folded, then what they
    gave, level by level until one answer is left: no step takes more, but for two partials
    that are longer together. A generator's fold sees each partial once per level.
    """
    if budget is None:
        return _fold(partials, generator, [query_id], text).select(query_id, "result")
    level = partials.select(query_id, text, F.col("rank").cast("bigint").alias("rank"), "partial")
    level = materialise(level.withColumn("_folded", F.lit(False)), "partials")
    # Each level leaves half of a query's partials at most. It is stored, so no answer is made twice.
    while level.groupBy(query_id).count().filter("count > 1").limit(1).count():
        level = materialise(_fold_level(level, generator, query_id, text, budget), "partials")
    done, alone = level.filter("_folded"), level.filter("NOT _folded")
    folded = _fold(alone, generator, [query_id], text).select(query_id, "result")
    return done.select(query_id, F.col("partial").alias("result")).unionByName(folded)


def _fold(partials: DataFrame, generator: Generator, keys: list[str], text: str) -> DataFrame:
    """``result`` of each group's partials in rank order, with the group's ``text``."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "partial")))
    gathered = partials.groupBy(*keys).agg(
        F.first(text).alias(text), F.transform(ranked, lambda pair: pair["partial"]).alias("_partials")
    )
    result = generator.reduce_fn(generator.prompt_fn(F.col(text)), F.col("_partials"))
    return gathered.select(*keys, text, result.alias("result"))


def _fold_level(level: DataFrame, generator: Generator, query_id: str, text: str, budget: int) -> DataFrame:
    """Packs of neighbours folded; a pack of one goes on as it is."""
    ordered = Window.partitionBy(query_id).orderBy("rank")
    before = F.coalesce(F.sum(F.length("partial")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # By size, but never fewer than two in a pack but for the last.
    pack = F.least(F.floor(before / budget), F.floor((F.row_number().over(ordered) - 1) / 2))
    packed = level.withColumn("_pack", pack.cast("bigint"))
    packed = packed.withColumn("_many", F.count("*").over(Window.partitionBy(query_id, "_pack")) > 1)
    folded = _fold(packed.filter("_many"), generator, [query_id, "_pack"], text)
    folded = folded.select(query_id, text, F.col("_pack").alias("rank"), F.col("result").alias("partial"), F.lit(True).alias("_folded"))
    alone = packed.filter("NOT _many").select(query_id, text, F.col("_pack").alias("rank"), "partial", "_folded")
    return folded.unionByName(alone)


def qa_answer(queries: DataFrame, results: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One ``answer`` per query; empty where there is no result."""
    return queries.select(query_id).join(results, query_id, "left").select(
        query_id, F.coalesce("result", F.lit("")).alias("answer")
    )

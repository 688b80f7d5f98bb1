"""Question answering over an index: retrieve, map, reduce, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparrowline.functions.embedders import Embedder
from sparrowline.operators.qa import Generator, qa_answer, qa_map, qa_reduce
from sparrowline.operators.search import TOP_K, rag_retrieve
from sparrowline.sources.index import StoredIndex


def answer_questions(
    queries: DataFrame,
    index: DataFrame | StoredIndex,
    embedder: Embedder,
    generator: Generator = Generator(),
    k: int = TOP_K,
    query_id: str = "query_id",
    text: str = "question",
) -> DataFrame:
    """One ``(query_id, answer)`` row per query."""
    retrieved = rag_retrieve(queries, index, embedder, k, query_id, text)
    return qa_answer(queries, qa_reduce(qa_map(retrieved, generator, text), generator, query_id, text), query_id)

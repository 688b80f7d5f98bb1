"""Nearest neighbours, retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.documents import DIM, SQL_CHUNKS, docs, sql_sparse
from catalog.tables import sql_strip, sql_words, table
from sparrowline.functions.embedders import hashed
from sparrowline.functions.text import SENTENCE
from sparrowline.operators import documents as doc_ops
from sparrowline.operators import cells, qa, search
from sparrowline.plans.retrieval import answer_questions
from sparrowline.session import materialise, work_path
from sparrowline.sources.index import StoredIndex, index_build, index_rows, open_index


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_rows(doc_ops.chunk_fixed(docs(spark, sf_dir)), hashed(DIM))


def stored_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The same index, written and opened; there are no raw texts to build it from."""
    path = work_path(spark, "index")
    index_build(doc_ops.chunk_fixed(docs(spark, sf_dir)), hashed(DIM), path)
    return open_index(spark, path, work_path(spark, "raw-text"), hashed(DIM))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _knn(spark, sf_dir, **options):
    index = vectors(spark, sf_dir)
    return search.knn_topk(
        index.withColumnRenamed("vec_id", "query_id"), index, query_id="query_id", keys=("vec_id",), **options
    )


def knn_topk(spark, sf_dir):
    return _knn(spark, sf_dir)


def knn_topk_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, metric="cosine")


def knn_topk_blocks(spark, sf_dir):
    """The way taken when the queries are too many to broadcast."""
    return _knn(spark, sf_dir, broadcast_bytes=0, block_bytes=100_000)


def knn_topk_cells(spark, sf_dir):
    """Vectors stored by cell; cells without one of the best rows are not read."""
    index, path = vectors(spark, sf_dir), work_path(spark, "cells")
    centroids = cells.fit_centroids(index, 16)
    table = materialise(cells.write_cells(index, path, ["vec_id"], centroids), "cell-table")
    return cells.search_cells(
        index.withColumnRenamed("vec_id", "query_id"), spark.read.parquet(path), table, query_id="query_id", keys=("vec_id",)
    )


def rag_retrieve(spark, sf_dir):
    return search.rag_retrieve(questions(spark, sf_dir), chunk_index(spark, sf_dir), hashed(DIM))


def retrieve_first(spark, sf_dir):
    return search.retrieve_first(questions(spark, sf_dir), chunk_index(spark, sf_dir), hashed(DIM))


def qa_map(spark, sf_dir):
    return qa.qa_map(rag_retrieve(spark, sf_dir)).select("query_id", "rank", "partial")


def qa_reduce(spark, sf_dir):
    return qa.qa_reduce(qa.qa_map(rag_retrieve(spark, sf_dir)))


def qa_answer(spark, sf_dir):
    """Answers for all questions when only those with a partial answer have a result."""
    partials = qa.qa_map(rag_retrieve(spark, sf_dir)).filter("partial <> ''")
    return qa.qa_answer(questions(spark, sf_dir), qa.qa_reduce(partials))


def rag_answer(spark, sf_dir):
    return answer_questions(questions(spark, sf_dir), chunk_index(spark, sf_dir), hashed(DIM))


def stored_retrieve(spark, sf_dir):
    return search.rag_retrieve(questions(spark, sf_dir), stored_index(spark, sf_dir), hashed(DIM))


def stored_answer(spark, sf_dir):
    return answer_questions(questions(spark, sf_dir), stored_index(spark, sf_dir), hashed(DIM))


QUERIES = {
    "stored_retrieve": stored_retrieve,
    "stored_answer": stored_answer,
    "knn_topk": knn_topk,
    "knn_topk_cosine": knn_topk_cosine,
    "knn_topk_blocks": knn_topk_blocks,
    "knn_topk_cells": knn_topk_cells,
    "rag_retrieve": rag_retrieve,
    "retrieve_first": retrieve_first,
    "qa_map": qa_map,
    "qa_reduce": qa_reduce,
    "qa_answer": qa_answer,
    "rag_answer": rag_answer,
}


def _sql_knn(distance: str) -> str:
    return f"""SELECT query_id, rank::INTEGER AS rank, vec_id, distance
        FROM (SELECT query_id, vec_id, distance,
                     row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
              FROM (SELECT q.vec_id AS query_id, i.vec_id, round({distance}, 9) AS distance
                    FROM embeddings q, embeddings i))
        WHERE rank <= 3"""


_A, _B = "q.embedding::DOUBLE[]", "i.embedding::DOUBLE[]"
_L2 = _sql_knn(f"list_sum(list_transform(list_zip({_A}, {_B}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))")
_COSINE = _sql_knn(f"list_cosine_distance({_A}, {_B})")

_RETRIEVED = f"""WITH chunks AS ({SQL_CHUNKS}),
    questions AS (SELECT item_id AS query_id, text AS question FROM benchmark),
    cv AS ({sql_sparse("SELECT * FROM chunks", "doc_id, pos", "chunk")}),
    qv AS ({sql_sparse("SELECT * FROM questions", "query_id", "question")}),
    cn AS (SELECT doc_id, pos, sum(weight * weight) AS n FROM cv GROUP BY ALL),
    qn AS (SELECT query_id, sum(weight * weight) AS n FROM qv GROUP BY ALL),
    dots AS (SELECT query_id, doc_id, pos, sum(qv.weight * cv.weight) AS dot
             FROM qv JOIN cv USING (bucket) GROUP BY ALL),
    measured AS (SELECT query_id, c.doc_id, c.pos, c.chunk,
                        round(qn.n + coalesce(cn.n, 0) - 2 * coalesce(dot, 0), 9) AS distance
                 FROM qn CROSS JOIN chunks c
                 LEFT JOIN cn USING (doc_id, pos) LEFT JOIN dots USING (query_id, doc_id, pos)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id, pos)::INTEGER AS rank
               FROM measured),
    retrieved AS (SELECT query_id, question, rank, doc_id, pos, distance, chunk
                  FROM ranked JOIN questions USING (query_id) WHERE rank <= 3)"""

_PARTIALS = f"""{_RETRIEVED},
    cut AS (SELECT query_id, rank, question,
                   list_filter(list_transform(regexp_extract_all(chunk, '{SENTENCE}'),
                                              lambda s: {sql_strip("s")}), lambda s: s <> '') AS parts
            FROM retrieved),
    sentences AS (SELECT query_id, rank, question, unnest(parts) AS s, unnest(range(len(parts))) AS i FROM cut),
    scored AS (SELECT *, len(list_intersect({sql_words("lower(question)")}, {sql_words("lower(s)")})) AS n
               FROM sentences),
    partials AS (SELECT query_id, rank, CASE WHEN n > 0 THEN s ELSE '' END AS partial
                 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY n DESC, i) AS best FROM scored)
                 WHERE best = 1),
    firsts AS (SELECT query_id, partial, min(rank) AS rank FROM partials WHERE partial <> '' GROUP BY ALL),
    results AS (SELECT query_id, string_agg(partial, chr(10) ORDER BY rank) AS result FROM firsts GROUP BY ALL)"""

_ANSWERS = f"{_PARTIALS} SELECT query_id, coalesce(result, '') AS answer FROM questions LEFT JOIN results USING (query_id)"

ORACLES = {
    "knn_topk": _L2,
    "knn_topk_cosine": _COSINE,
    "knn_topk_blocks": _L2,
    "knn_topk_cells": _L2,
    "rag_retrieve": f"{_RETRIEVED} SELECT * FROM retrieved",
    "retrieve_first": f"{_RETRIEVED} SELECT query_id, chunk AS content FROM retrieved WHERE rank = 1",
    "qa_map": f"{_PARTIALS} SELECT * FROM partials",
    "qa_reduce": f"""{_PARTIALS} SELECT query_id, coalesce(result, '') AS result
        FROM (SELECT DISTINCT query_id FROM partials) LEFT JOIN results USING (query_id)""",
    "qa_answer": _ANSWERS,
    "rag_answer": _ANSWERS,
}

ORACLES["stored_retrieve"] = ORACLES["rag_retrieve"]
ORACLES["stored_answer"] = ORACLES["rag_answer"]

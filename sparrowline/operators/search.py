"""Exact nearest neighbours for many queries at once.

Distances are worked out block against block by one matrix product, inside
tasks; a task hands on at most ``k`` rows per query, and a ranking window picks
the best ``k`` overall. No pair of query and row is ever written out.

Ranking rule: distances are rounded to nine places, and equal ones are ordered
by the row's key. Thus neither the order of summation nor the layout of the
data can change the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowline.functions.embedders import Embedder
from sparrowline.operators.embedding import check_index_model, embed_texts
from sparrowline.session import materialise

if TYPE_CHECKING:
    from sparrowline.sources.index import StoredIndex

TOP_K = 3
PLACES = 9
# Query vectors up to this size are sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Vectors of the searched side, as doubles, that one task holds when both sides are shuffled.
BLOCK_BYTES = 256 * 1024 * 1024
# Query vectors, as doubles, that one task holds then.
QUERY_BYTES = 256 * 1024 * 1024
# Cells of one distance matrix: bounds a task's memory for any block shape.
_CELLS = 4_000_000
# Rows of a scanned batch taken at once: bounds their copies as doubles.
_ROWS = 2048


def knn_topk(
    queries: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    metric: str = "l2",
    query_id: str = "query_id",
    keys: Sequence[str] = ("doc_id", "pos"),
    vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` nearest rows of ``index`` for every row of ``queries``.

    ``metric`` is ``l2`` (squared Euclidean) or ``cosine``. ``keys`` are the
    integer columns that identify an index row. Rows without a vector are
    skipped. Returns ``(query_id, rank, *keys, distance)``.

    Queries that fit in ``broadcast_bytes`` are broadcast and the index is
    scanned in place; more queries are dealt to tasks, and the index streams past them in
    blocks of up to ``block_bytes``.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    keys = list(keys)
    kinds = dict(index.dtypes)
    if other := [name for name in keys if kinds.get(name) not in ("tinyint", "smallint", "int", "bigint")]:
        raise ValueError(f"keys must be integer columns of the index: {other}")
    queries = queries.select(F.col(query_id).alias("_q"), F.col(vector).alias("_v")).filter(F.col("_v").isNotNull())
    index = index.select(*keys, F.col(vector).alias("_v")).filter(F.col("_v").isNotNull())
    schema = T.StructType(
        [T.StructField(query_id, queries.schema["_q"].dataType)]
        + [T.StructField(key, T.LongType()) for key in keys]
        + [T.StructField("distance", T.DoubleType())]
    )
    small = _take_bounded(queries, broadcast_bytes)
    if small is not None:
        found = _scan(small, index, k, metric, keys, schema)
    else:
        asked = queries.agg(F.count("*").alias("rows"), F.max(F.size("_v")).alias("n")).first()
        row_bytes = 8 * max(asked.n, 1)
        shares = max(1, math.ceil(asked.rows * row_bytes / QUERY_BYTES))
        step = max(1, block_bytes // row_bytes)
        found = _blocks(queries, index, k, metric, keys, schema, shares, step)
    restored = [F.col(key).cast(index.schema[key].dataType).alias(key) for key in keys]
    return rank_best(found, k, query_id, keys).select(query_id, "rank", *restored, "distance")


def rank_best(found: DataFrame, k: int, query_id: str, keys: Sequence[str]) -> DataFrame:
    """The best ``k`` rows of each query with their ``rank``."""
    best = Window.partitionBy(query_id).orderBy("distance", *keys)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _take_bounded(queries: DataFrame, limit: int) -> pa.Table | None:
    """The queries if they, their ids included, take at most ``limit`` bytes as doubles, else None.

    Never fetches more than the limit allows: the vectors' length and the longest id tell
    how many rows fit, and at most one row above that is asked for.
    """
    id_size = F.coalesce(F.octet_length(F.col("_q").cast("string")), F.lit(0))
    sizes = queries.agg(F.max(F.size("_v")).alias("n"), F.max(id_size).alias("id")).first()
    if sizes.n is None:
        return queries.limit(0).toArrow()
    allowed = limit // (8 * max(sizes.n, 1) + max(sizes.id, 8))
    taken = queries.limit(allowed + 1).toArrow()
    return taken if taken.num_rows <= allowed else None


def _scan(
    queries: pa.Table, index: DataFrame, k: int, metric: str, keys: list[str], schema: T.StructType
) -> DataFrame:
    names = schema.names
    ids = queries.column("_q").combine_chunks()
    shared = index.sparkSession.sparkContext.broadcast((ids, _matrix(queries.column("_v").combine_chunks(), metric)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = shared.value
        best = _Best(len(wanted), len(keys), k)
        for batch in batches:
            for start in range(0, batch.num_rows if len(wanted) else 0, _ROWS):
                _improve(best, wanted, *_block(batch.slice(start, _ROWS), keys, metric), metric)
        yield from _rows(best, ids, names)

    return index.mapInArrow(search, schema)


def _blocks(
    queries: DataFrame, index: DataFrame, k: int, metric: str, keys: list[str], schema: T.StructType, shares: int, step: int
) -> DataFrame:
    """Queries in shares, index rows in parts: each share meets each part once.

    A task holds its share of the queries with the best rows found so far, while its part of
    the index streams past, ``step`` rows at a time. There are no more pairs of share and part
    than cores, unless the queries need more shares to fit in memory, so what is shuffled is a
    fixed multiple of the input, and a task hands on ``k`` rows per query.
    """
    names = schema.names
    cores = index.sparkSession.sparkContext.defaultParallelism
    parts = max(1, cores // shares)

    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def dealt(count: int, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(count)).cast("int")

    asked = queries.withColumn("_s", dealt(shares, "_q", "_v")).select(
        numbers(parts).alias("_b"), "_s", F.lit(0).alias("_side"),
        *[F.lit(None).cast(index.schema[key].dataType).alias(key) for key in keys], "_q", "_v",
    )
    rows = index.withColumn("_b", dealt(parts, *keys)).select(
        "_b", numbers(shares).alias("_s"), F.lit(1).alias("_side"), *keys, F.lit(None).cast(schema[0].dataType).alias("_q"), "_v"
    )
    met = (
        asked.unionByName(rows)
        .repartitionById(parts * shares, (F.col("_b") * shares + F.col("_s")).cast("int"))
        .sortWithinPartitions("_b", "_s", "_side")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, held, wanted, best = None, [], [], None, None
        for batch in batches:
            for place, side, part in _runs(batch):
                if place != current:
                    if best is not None:
                        yield from _rows(best, ids, names)
                    current, ids, held, wanted, best = place, [], [], None, None
                if side == 0:
                    ids.append(part.column("_q"))
                    held.append(_matrix(part.column("_v"), metric))
                    continue
                if not ids:
                    continue
                if best is None:
                    if len({matrix.shape[1] for matrix in held}) > 1:
                        raise ValueError("vectors differ in length")
                    ids, wanted, held = pa.concat_arrays(ids), np.concatenate(held), []
                    best = _Best(len(wanted), len(keys), k)
                for start in range(0, part.num_rows, step):
                    _improve(best, wanted, *_block(part.slice(start, step), keys, metric), metric)
        if best is not None:
            yield from _rows(best, ids, names)

    return met.mapInArrow(search, schema)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """Stretches of a sorted batch that share part, share and side."""
    labels = np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in ("_b", "_s", "_side")], axis=1)
    edges = np.flatnonzero((labels[1:] != labels[:-1]).any(axis=1)) + 1
    for start, end in zip([0, *edges], [*edges, len(labels)], strict=True):
        b, s, side = labels[start].tolist()
        yield (b, s), side, batch.slice(start, end - start)


def _matrix(vectors: pa.Array, metric: str) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(vectors) and len(values) % len(vectors):
        raise ValueError("vectors differ in length")
    matrix = values.reshape(len(vectors), -1) if len(vectors) else values.reshape(0, 0)
    if metric == "cosine":
        norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        matrix = matrix / np.where(norms == 0, 1.0, norms)
    return matrix


def _block(batch: pa.RecordBatch, keys: list[str], metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and keys of a batch, ordered by key."""
    ids = np.stack([batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64) for key in keys], axis=1)
    order = np.lexsort(ids.T[::-1])
    return _matrix(batch.column("_v"), metric)[order], ids[order]


class _Best:
    """The best rows so far of each query; empty places are at infinity."""

    def __init__(self, queries: int, keys: int, k: int):
        self.k = k
        self.distance = np.full((queries, k), np.inf)
        self.ids = np.zeros((queries, k, keys), dtype=np.int64)


def _improve(
    best: _Best, wanted: np.ndarray, rows: np.ndarray, ids: np.ndarray, metric: str, among: np.ndarray | None = None
) -> None:
    """Bring a block of rows (ordered by key) into ``best``, for all queries or those ``among`` them."""
    if wanted.shape[1] != rows.shape[1]:
        raise ValueError(f"query vectors have {wanted.shape[1]} values, index vectors {rows.shape[1]}")
    rows, ids = _without_spare_copies(rows, ids, best.k)
    step = max(1, _CELLS // len(rows))
    for start in range(0, len(wanted) if among is None else len(among), step):
        part = slice(start, start + step)
        _improve_slice(best, part if among is None else among[part], wanted, rows, ids, metric)


def _without_spare_copies(rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Drop copies of a vector beyond the first ``k`` by key. They tie with
    those ``k`` for every query and lose, so the result stays the same."""
    if len(rows) <= k:
        return rows, ids
    rows = np.ascontiguousarray(rows + 0.0)
    bytewise = rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel()
    _, group, sizes = np.unique(bytewise, return_inverse=True, return_counts=True)
    if sizes.max() <= k:
        return rows, ids
    order = np.argsort(group, kind="stable")
    starts = np.cumsum(sizes) - sizes
    nth = np.empty(len(rows), dtype=np.int64)
    nth[order] = np.arange(len(rows)) - starts[group[order]]
    return rows[nth < k], ids[nth < k]


def _improve_slice(
    best: _Best, part: slice | np.ndarray, wanted: np.ndarray, rows: np.ndarray, ids: np.ndarray, metric: str
) -> None:
    wanted, k = wanted[part], best.k
    near, scale = wanted @ rows.T, 1.0
    if metric == "l2":
        asked, found = (wanted * wanted).sum(axis=1), (rows * rows).sum(axis=1)
        near *= -2.0
        near += found[None, :]
        near += asked[:, None]
        scale = max(asked.max(), found.max(), 1.0)
    else:
        np.subtract(1.0, near, out=near)
    # ``near`` may be off by rounding errors. Whatever could belong to the best
    # k is kept here and measured again below, pair by pair.
    slack = 2.0 * 10.0**-PLACES + max(1e-12, 1e-15 * wanted.shape[1]) * scale
    bound = best.distance[part, k - 1]
    hits = near <= bound[:, None] + slack
    # Once rows have been seen few come nearer, and the nearest of them need not be told apart first.
    if near.shape[1] > k and np.count_nonzero(hits) > k * len(wanted):
        bound = np.minimum(bound, np.partition(near, k - 1, axis=1)[:, k - 1])
        hits = near <= bound[:, None] + slack
    q, r = np.nonzero(hits)
    if not len(q):
        return
    distance = np.empty(len(q))
    step = max(1, _CELLS // wanted.shape[1])
    for start in range(0, len(q), step):
        a, b = wanted[q[start : start + step]], rows[r[start : start + step]]
        distance[start : start + step] = ((a - b) ** 2).sum(axis=1) if metric == "l2" else 1.0 - (a * b).sum(axis=1)
    # Queries without a hit stay as they are.
    hit, q = np.unique(q, return_inverse=True)
    part = hit + part.start if isinstance(part, slice) else part[hit]
    count = len(hit)
    everyone = np.concatenate([np.repeat(np.arange(count), k), q])
    distance = np.concatenate([best.distance[part].ravel(), np.round(distance, PLACES) + 0.0])
    candidates = np.concatenate([best.ids[part].reshape(count * k, -1), ids[r]])
    order = np.lexsort((*candidates.T[::-1], distance, everyone))
    everyone = everyone[order]
    place = np.arange(len(order)) - np.searchsorted(everyone, np.arange(count))[everyone]
    chosen = order[place < k]
    best.distance[part] = distance[chosen].reshape(count, k)
    best.ids[part] = candidates[chosen].reshape(count, k, -1)


def _rows(best: _Best, ids: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
    query, place = np.nonzero(np.isfinite(best.distance))
    if len(query):
        found = best.ids[query, place]
        columns = [ids.take(pa.array(query))]
        columns += [pa.array(found[:, i]) for i in range(found.shape[1])]
        columns.append(pa.array(best.distance[query, place]))
        yield pa.RecordBatch.from_arrays(columns, names=names)


def rag_retrieve(
    queries: DataFrame,
    index: DataFrame | StoredIndex,
    embedder: Embedder,
    k: int = TOP_K,
    query_id: str = "query_id",
    text: str = "question",
    metric: str = "l2",
) -> DataFrame:
    """The ``k`` best chunks of every text query:
    ``(query_id, question, rank, doc_id, pos, distance, chunk)``.

    The search reads vectors only. Its result, ``k`` short rows per query, is
    written out first, so that fetching the chunk texts is planned with its real
    size. A stored index leaves out cells of vectors that hold none of the best, and
    reads texts from the buckets of the found documents only; rows of a plain
    DataFrame are joined, as a broadcast below Spark's own threshold and by shuffle above.
    """
    stored = not isinstance(index, DataFrame)
    if stored:
        index.check_model(embedder)
    else:
        check_index_model(index, embedder)
    # Embedded once, though the search looks at the queries several times.
    asked = materialise(embed_texts(queries.select(query_id, text), embedder, text), "questions")
    if stored:
        best = index.search(asked, embedder, k, metric, query_id)
    else:
        best = knn_topk(asked, index, k, metric, query_id, ("doc_id", "pos"))
    best = materialise(best, "topk")
    texts = index.texts(best) if stored else index.select("doc_id", "pos", "chunk")
    return (
        best.join(texts, ["doc_id", "pos"])
        .join(asked.select(query_id, text), query_id)
        .select(query_id, text, "rank", "doc_id", "pos", "distance", "chunk")
    )


def retrieve_first(
    queries: DataFrame, index: DataFrame | StoredIndex, embedder: Embedder, query_id: str = "query_id", text: str = "question"
) -> DataFrame:
    """The best chunk of every query as ``content``; empty if there is none."""
    best = rag_retrieve(queries, index, embedder, 1, query_id, text).select(query_id, "chunk")
    return queries.select(query_id).join(best, query_id, "left").select(
        query_id, F.coalesce("chunk", F.lit("")).alias("content")
    )

"""Exact top-k inner product search by columnar branch and bound.

Candidates and queries are dealt into blocks, and every pair of blocks is one group
of bounded size. Inside, vectors lie by dimension: products are summed up one block
of dimensions at a time, and what the remaining dimensions can still add, by
Cauchy-Schwarz on their norms, bounds every score from both sides. Candidates whose
upper bound is below the k-th best lower bound are dropped and the rest compacted
before the next block of dimensions is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DIMENSIONS = 16
# Doubles hold every sum exactly while norms' products stay below this.
_EXACT = float(1 << 52)


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of every component (array<long>); null if one is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def best_in_block(columns: np.ndarray, rest: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int):
    """Ids and scores of the ``k`` best of a block for one query, ties to lesser ids.

    ``columns`` has a row per dimension, in the order in which they are read, and ``rest``
    the candidates' norms from each dimension on.
    """
    alive, size = np.flatnonzero(ids != own), len(query)
    score = np.zeros(len(alive), columns.dtype)
    left = np.sqrt(np.cumsum(query[::-1].astype(float) ** 2)[::-1])
    for at in range(0, size, _DIMENSIONS):
        part = slice(at, at + _DIMENSIONS)
        score = score + query[part] @ columns[part][:, alive]
        after = at + _DIMENSIONS
        if after < size and len(alive) > k:
            # A little more than the exact rest, for what the square roots round away.
            reach = rest[after][alive] * (left[after] * (1 + 1e-9)) + 1e-6
            least = np.partition(score - reach, len(alive) - k)[len(alive) - k]
            kept = score + reach >= least
            alive, score = alive[kept], score[kept]
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[order]], score[order]


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search_blocks(k: int):
    def run(group: pa.Table) -> pa.Table:
        asked = group.column("asked").to_numpy()
        ids = group.column("id").to_numpy()
        values = group.column("values").combine_chunks()
        matrix = values.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        queries, query_ids = matrix[asked], ids[asked]
        matrix, ids = matrix[~asked], ids[~asked]
        longest = lambda m: float((m.astype(float) ** 2).sum(axis=1).max()) ** 0.5 if len(m) else 0.0
        if longest(matrix) * longest(queries) < _EXACT:
            matrix, queries = matrix.astype(float), queries.astype(float)
        # Dimensions with the most mass first: bounds close sooner.
        order = np.argsort(-(matrix.astype(float) ** 2).sum(axis=0), kind="stable")
        columns = np.ascontiguousarray(matrix[:, order].T)
        rest = np.sqrt(np.cumsum(columns[::-1].astype(float) ** 2, axis=0)[::-1])
        out = [(np.zeros(0, np.int64),) * 3]
        for own, query in zip(query_ids, queries[:, order], strict=True):
            found, score = best_in_block(columns, rest, ids, query, own, k)
            out.append((np.full(len(found), own), found, score.astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_OUT)

    return run


def top_k(
    vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, k: int = 5,
    block_rows: int = 8192, query_rows: int = 2048,
) -> DataFrame:
    """For every row that ``is_query``, the ``k`` rows with the highest integer inner product.

    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the lesser id, and a
    query with fewer candidates has them all. Every row but those with the query's own id
    is a candidate. Vectors that are null or hold null or non-finite components take no
    part, nor do rows without an id; rows repeated with id and vector count once; vectors
    meet those of their own length only. Norms must stay below 2 ** 31 after scaling, for
    scores to fit a long. Other columns are not read; empty tables give an empty one.

    Every block of queries meets every block of candidates, so a group holds
    ``block_rows`` and ``query_rows`` rows whatever the table's size.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("values"), is_query.alias("asked"))
    rows = rows.filter("id IS NOT NULL AND values IS NOT NULL").distinct().withColumn("size", F.size("values"))
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("asked"), 1))).first()
    blocks, query_blocks = -(-n // block_rows) or 1, -(-asked // query_rows) or 1
    dealt = F.xxhash64("id", "values")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = rows.select(
        "id", "values", "size", F.lit(False).alias("asked"), F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"), every(query_blocks).alias("query_block")
    )
    queries = rows.filter("asked").select(
        "id", "values", "size", "asked", every(blocks).alias("block"), F.pmod(dealt, F.lit(query_blocks)).cast("int").alias("query_block")
    )
    queries = queries.select(candidates.columns)
    met = candidates.unionByName(queries).groupBy("size", "block", "query_block")
    found = met.applyInArrow(_search_blocks(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

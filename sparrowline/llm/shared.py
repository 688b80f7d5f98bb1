"""Input tables, and small steps that several operators use."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowline.session import prepare

# A word is a maximal run of characters other than space, \t, \n, \v, \f, \r:
# in Python, what ``bytes.split()`` gives.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text: Column) -> Column:
    """Lowercase hex digest of a string's UTF-8 bytes, or of binary data."""
    return F.sha2(text, 256)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch with ``schema`` from arrays or lists in its order."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, field.type) for c, field in zip(columns, schema, strict=True)],
        schema=schema,
    )


def slices(batch: pa.RecordBatch, column: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``most`` bytes in each part.

    One row is never cut: a part holds at least one.
    """
    begin, held = 0, 0
    for i, size in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if held and held + (size or 0) > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def release_memory() -> None:
    """Give back what a task no longer holds: Python workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)

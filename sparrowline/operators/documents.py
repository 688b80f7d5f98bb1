"""From pages to documents to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.functions.splitter import split_recursive
from sparrowline.functions.text import slices, words
from sparrowline.operators.ordered import concat_in_blocks, concat_ordered, running_total_in_blocks

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 100


def assemble_pages(
    pages: DataFrame, documents: DataFrame | None = None, key: str = "doc_id", page: str = "page", text: str = "text"
) -> DataFrame:
    """One ``(key, text)`` row per document: its pages joined by newlines.

    A page without text counts as an empty one. With ``documents`` given, a
    document without pages gets an empty text.
    """
    filled = pages.select(key, page, F.coalesce(F.col(text), F.lit("")).alias("_page_text"))
    joined = concat_ordered(filled, [key], page, "_page_text", "text", separator="\n")
    if documents is None:
        return joined
    return documents.select(key).join(joined, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def _explode(df: DataFrame, chunks: Column, text: str) -> DataFrame:
    others = [name for name in df.columns if name != text]
    return df.select(*others, F.posexplode(chunks).alias("pos", "chunk"))


def chunk_fixed(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE) -> DataFrame:
    """Consecutive slices of ``size`` characters; the last may be shorter."""
    return _explode(docs, slices(F.col(text), size), text)


def chunk_overlapping(
    docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Slices of ``size`` characters that start every ``size - overlap``."""
    return _explode(docs, slices(F.col(text), size, size - overlap), text)


def chunk_recursive(
    docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Chunks cut at blank lines, else newlines, else spaces, else characters."""
    return _explode(docs, split_recursive(size, overlap)(F.col(text)), text)


def chunk_pages(
    pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text", size: int = CHUNK_SIZE
) -> DataFrame:
    """The chunks of :func:`chunk_fixed` over :func:`assemble_pages`, without
    ever holding a document as one string.

    Each page knows where it starts in its document, so it can tell which part
    of which chunk it holds; the parts of a chunk are then joined. A document
    of any length is spread over many tasks.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # A newline stands between pages: every page but the first brings its own.
    first = F.col("_start") == 0
    sized = pages.select(key, page, body.alias("_body"), (F.length(body) + 1).cast("bigint").alias("_length"))
    located = running_total_in_blocks(sized, [key], page, "_length", "_start")
    blocks = ("_block", "_block_base", "_block_total")
    placed = located.select(
        key,
        page,
        *blocks,
        F.when(first, F.col("_body")).otherwise(F.concat(F.lit("\n"), F.col("_body"))).alias("_piece"),
        F.when(first, F.lit(0)).otherwise(F.col("_start") - 1).alias("_from"),
    )
    # The first cut falls where the running chunk is full, later ones every ``size``.
    lead = (F.lit(size) - F.pmod(F.col("_from"), F.lit(size))).cast("int")
    head = F.substring(F.col("_piece"), F.lit(1), lead)
    tail = F.substring(F.col("_piece"), lead + 1, F.length("_piece"))
    parts = placed.select(
        key,
        page,
        *blocks,
        F.expr(f"_from div {size}").alias("_first"),
        F.posexplode(F.concat(F.array(head), slices(tail, size))).alias("_n", "_part"),
    )
    parts = parts.filter(F.length("_part") > 0).withColumn("pos", (F.col("_first") + F.col("_n")).cast("int"))
    # Numbers of the chunks that hold the first and the last character of a block;
    # its text starts one before its base, with the newline.
    first_chunk = F.expr(f"_block_base div {size}")
    last_chunk = F.expr(f"(_block_base + _block_total - 2) div {size}")
    return concat_in_blocks(parts, [key], "pos", page, "_part", "chunk", first_chunk, last_chunk)


def wrap_chunks(chunks: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Add ``document``: the record form of a chunk, with ``page_content``."""
    return chunks.withColumn("document", F.struct(F.col(chunk).alias("page_content")))


def split_words(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per white-space separated word, with its position."""
    others = [name for name in df.columns if name != text]
    return df.select(*others, F.posexplode(words(F.col(text))).alias("pos", "token"))

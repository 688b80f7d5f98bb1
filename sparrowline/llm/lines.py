"""Line dedup: drop lines that many documents share.

Normalised lines are hashed and exploded with their positions, documents are
counted per hash, and lines whose hash is found in enough documents go. Only hashes
and positions are shuffled for that; texts move once, to meet the positions they
lose, and are put together again from the positions that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.functions.binding import with_computed

_SPACES = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without outer ASCII white space, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACES)), _UPPER, _LOWER)


def line_hash(line: Column, min_chars: int) -> Column:
    """128 bits of the line's key, or null if the key is shorter than ``min_chars``."""
    key = line_key(line)
    hashed = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))
    return F.when(F.char_length(key) >= min_chars, hashed)


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def shared_positions(docs: DataFrame, text: str, key: str, min_docs: int, min_chars: int) -> DataFrame:
    """Per document with lines to drop: ``_key``, ``_digest`` (of its text), ``_drop`` (positions).

    A line counts once per distinct ``key``: rows repeated under one key are one
    document, and all rows with a null key are one too. The digest tells apart
    different texts under one key.
    """
    hashes = F.transform(_lines(text), lambda line: line_hash(line, min_chars))
    held = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_digest"), F.posexplode(hashes))
    held = held.filter("col IS NOT NULL").withColumnRenamed("col", "_hash")
    held = held.groupBy("_hash", "_key", "_digest").agg(F.collect_list("pos").alias("_at"))
    # Both uses read the same columns of ``held``, so that its shuffle is done once.
    texts = F.sum(F.when(F.size("_at") > 0, 1)).alias("_texts")
    often = held.groupBy("_hash", "_key").agg(texts).groupBy("_hash").agg(F.count("_texts").alias("_n"))
    often = often.filter(F.col("_n") >= min_docs).select("_hash")
    dropped = held.join(often, "_hash", "left_semi")
    return dropped.groupBy("_key", "_digest").agg(F.flatten(F.collect_list("_at")).alias("_drop"))


def dedup_lines(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """``docs`` with shared lines taken out of ``text``, and ``n_lines``, ``n_dropped``.

    A line goes, everywhere, if its key (``line_key``) has at least ``min_chars``
    characters and is found in at least ``min_docs`` documents; other lines stay in
    their order. A null or empty text is one empty line and comes out empty;
    ``n_lines`` counts lines before dropping. Rows with a null key stay (all of them
    count as one document). Other columns are passed on; any named like an output
    column are replaced. An empty table gives an empty one.
    """
    passed = [name for name in docs.columns if name not in ("n_lines", "n_dropped", text)]
    drop = shared_positions(docs, text, key, min_docs, min_chars)
    same = docs[key].eqNullSafe(drop["_key"]) & F.xxhash64(docs[text]).eqNullSafe(drop["_digest"])
    rows = with_computed(docs.join(drop, same, "left").select(*passed, text, "_drop"), _cut=_lines(text))
    places = F.sequence(F.lit(0), F.size("_cut") - 1)
    left = F.transform(F.array_except(places, F.col("_drop")), lambda at: F.get(F.col("_cut"), at))
    rows = with_computed(rows, _left=F.when(F.col("_drop").isNull(), F.col("_cut")).otherwise(left))
    return rows.select(
        *passed,
        F.array_join("_left", "\n").alias(text),
        F.size("_cut").cast("long").alias("n_lines"),
        (F.size("_cut") - F.size("_left")).cast("long").alias("n_dropped"),
    )

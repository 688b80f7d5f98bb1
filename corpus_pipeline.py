"""From raw documents to a tokenised mix, one operator per stage.

Documents that fail the quality rules go; lines that many documents share are taken
out; of each group of near duplicates one document stays; sources are mixed to
target weights; texts become token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowline.llm import bpe, lines, mixing, quality, queries, shingles
from sparrowline.llm.shared import sha256, table
from sparrowline.session import materialise, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_passing(docs, queries.POLICY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text."""
    cleaned = lines.dedup_lines(docs, min_docs=queries.LINE_DOCS)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays; rows without an id stay.

    Of rows with one id and one text, one stays, the least by its other columns; other
    texts under that id stay too.
    """
    groups = shingles.join_shingles(docs, width=5, percent=80)
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    same = Window.partitionBy("doc_id", sha256(F.coalesce("text", F.lit("")))).orderBy(
        *[name for name in docs.columns if name not in ("doc_id", "text")]
    )
    first = docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").withColumn("_nth", F.row_number().over(same))
    return first.filter("_nth = 1").drop("_nth").unionByName(docs.filter("doc_id IS NULL"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(docs, mixing.cyclic(queries.MIX_CYCLE), max_epochs=queries.MIX_EPOCHS)
    return mixing.repeat_rows(mixed)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text again."""
    definition = bpe.load(public_tokenizers.path(queries.TOKENIZER))
    text = F.coalesce(F.col("text"), F.lit(""))
    both = bpe.round_trip(F.col("text"), definition).alias("both")
    ids = docs.select("doc_id", "source", sha256(text).alias("text_sha256"), both)
    whole = (sha256(F.col("both.decoded")) == F.col("text_sha256")).alias("round_trip")
    return ids.select("doc_id", "source", F.size("both.ids").cast("long").alias("n_tokens"), "both.ids", whole)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("BPE", tokens),
]

# Token ids are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one reads what the one before has written."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

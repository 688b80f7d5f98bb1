"""What the plans must look like to hold at scale."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import documents as docs_catalog
from catalog import search as search_catalog
from sparrowline.functions.embedders import hashed
from sparrowline.operators import documents, events, messages, search
from sparrowline.operators.embedding import embed_texts
from sparrowline.plans.index_build import build_index

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(name for name in QUERIES if not name.startswith("stream_")))
def test_no_query_uses_a_cross_join_or_a_single_task(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text


def test_chunking_and_embedding_are_narrow_and_read_two_columns(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    text = plan(embed_texts(documents.chunk_fixed(table.select("doc_id", "text")), hashed(16), "chunk"))
    assert "Exchange" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_unused_vectors_are_not_made(spark):
    index = search_catalog.chunk_index(spark, SF_DIR)
    assert "ArrowEvalPython" in plan(index)
    assert "EvalPython" not in plan(index.select("doc_id", "pos", "chunk"))
    assert "regexp_extract_all" not in plan(docs_catalog.docs(spark, SF_DIR).select("doc_id"))


def test_filters_reach_the_scan(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    text = plan(documents.chunk_fixed(table).filter(F.col("lang") == "en").select("doc_id", "chunk"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)" in text


def test_search_ranks_per_partition_before_it_shuffles(spark):
    vectors = search_catalog.vectors(spark, SF_DIR)
    found = search.knn_topk(vectors.withColumnRenamed("vec_id", "query_id"), vectors, keys=("vec_id",))
    text = plan(found)
    assert text.count("Exchange hashpartitioning") == 1
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([("r", 0, "{}")], "request_id string, seq int, line string")
    kept = events.filter_events(events.normalise_events(lines).withColumn("include", F.array(F.lit("all"))))
    assert plan(kept).count("parse_json") + plan(kept).count("parseJson") <= 1


def test_a_hot_session_is_spread_by_block(spark):
    chunks = spark.createDataFrame([("s", 0, bytearray(b"a\n"))], "session_id string, seq bigint, data binary")
    assert "hashpartitioning(session_id" in plan(messages.reassemble_lines(chunks))
    assert "_block" in plan(messages.reassemble_lines(chunks))


def test_an_index_is_stored_in_zstd(spark, tmp_path):
    rows = [(i, p, f"page {p} of text {i}") for i in range(50) for p in range(3)]
    pages = spark.createDataFrame(rows, "doc_id long, page long, text string")
    build_index(pages, hashed(16), str(tmp_path / "index"), str(tmp_path / "raw"))
    for stored in ("raw", "index/rows", "index/vectors"):
        files = [*(tmp_path / stored).rglob("*.parquet")]
        assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}

"""The registered queries, and the pipeline stage by stage against plain Python."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparrowline.llm import mixing, queries
from tests.compare import connect, spark_rows, sql_rows
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    names, got = spark_rows(queries.QUERIES[name](spark, SF_DIR))
    sql_names, wanted = sql_rows(con, queries.ORACLES[name])
    assert names == sql_names and got == wanted


def test_suffix_dedup_query_equals_brute_force(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    got = {r.doc_id: r for r in queries.op5_suffix_dedup(spark, SF_DIR).collect()}
    for (doc, text), spans in zip(rows, brute.repeats(rows, 100), strict=True):
        gone = sum(b - a for a, b in spans)
        assert (got[doc].n_bytes, got[doc].n_removed, got[doc].n_spans) == (len((text or "").encode()), gone, len(spans))


def test_queries_are_named_by_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def documents(spark):
    draw = random.Random(21)
    word = lambda: draw.choice("abcdefgh") + str(draw.randint(0, 900))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        lines = [text(draw.randint(20, 60)) for _ in range(4)] + (["Read  more about us"] if i % 3 == 0 else [])
        rows.append((i, "\n".join(lines), "en", draw.choice(["s0", "s0", "s0", "s1", None])))
    rows += [(100 + i, rows[i][1].replace(" ", " ", 1) + (" end" if i % 2 else ""), "en", "s1") for i in range(10)]
    rows += [(200, "too short", "en", "s0"), (201, None, None, None), (202, "# " * 80, "xx", "s2"), (203, "a b c " * 60, "en", "s0")]
    rows += [(rows[5][0], *rows[5][1:])]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages_follow_plain_python(spark, documents):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(documents, schema)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "BPE"]
    kept = docs
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = spark.createDataFrame(stage(spark, kept, SF_DIR).collect(), schema=stage(spark, kept, SF_DIR).schema)
        out[name] = kept.collect()
        if name != "BPE":
            assert kept.columns == docs.columns
    passed = [r for r in documents if r[0] < 200]
    assert sorted(r.doc_id for r in out["quality rules"]) == sorted(r[0] for r in passed)
    cleaned = brute.line_dedup([(r[0], r[1]) for r in passed], 10)
    assert sorted((r.doc_id, r.text) for r in out["line dedup"]) == sorted(cleaned)
    assert all(r.n_chars == len(r.text) for r in out["line dedup"])
    classes = brute.shingle_classes(cleaned, 5, 80)
    first = sorted({doc for doc, root in classes.items() if doc == root})
    assert sorted(r.doc_id for r in out["n-gram Jaccard join"]) == first and len(first) < len(passed)
    sizes = {}
    for row in out["n-gram Jaccard join"]:
        sizes[row.source] = sizes.get(row.source, 0) + len(brute.words(row.text))
    taken = {}
    for row in out["mixing sources"]:
        taken[row.source] = taken.get(row.source, 0) + len(brute.words(row.text))
    goals = mixing.mix_sources(spark.createDataFrame(out["n-gram Jaccard join"], schema), mixing.cyclic(queries.MIX_CYCLE)).collect()
    for source, target in {(r.source, r.target) for r in goals}:
        assert abs(taken[source] - target) <= max(len(brute.words(r.text)) for r in out["n-gram Jaccard join"] if r.source == source)
    own = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    texts = sorted((r.doc_id, own.encode(r.text, add_special_tokens=False).ids) for r in out["mixing sources"])
    assert sorted((r.doc_id, r.ids) for r in out["BPE"]) == texts
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out["BPE"])


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_the_pipeline_runs_over_a_table(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.round_trip for r in rows)

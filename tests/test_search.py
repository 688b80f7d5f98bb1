import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparrowline.functions.embedders import from_model, hashed
from sparrowline.functions.vectors import cosine_distance, squared_l2
from sparrowline.operators import qa
from sparrowline.operators.embedding import ModelMismatch
from sparrowline.operators.search import _Best, _improve, _take_bounded, knn_topk, rag_retrieve, retrieve_first
from sparrowline.plans.retrieval import answer_questions
from sparrowline.sources.index import StoredIndex, index_build, index_rows, open_index
from tests.test_plans import plan

WAYS = [{}, {"broadcast_bytes": 0, "block_bytes": 2400}, {"broadcast_bytes": 0}]


def frame(spark, matrix, key):
    rows = [(i, None if row is None else [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>").repartition(5)


def brute(queries, rows, k, metric):
    found = []
    for q, query in enumerate(queries):
        scored = []
        for i, row in enumerate(rows):
            if row is None:
                continue
            a, b = np.float32(query).astype(float), np.float32(row).astype(float)
            if metric == "l2":
                d = ((a - b) ** 2).sum()
            else:
                norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                d = 1.0 - ((a * b).sum() / norm if norm else 0.0)
            scored.append((round(d, 9) + 0.0, i))
        found += [(q, rank, i) for rank, (_, i) in enumerate(sorted(scored)[:k], 1)]
    return found


def search(spark, queries, rows, k=3, **options):
    result = knn_topk(frame(spark, queries, "query_id"), frame(spark, rows, "chunk_id"), k, keys=("chunk_id",), **options)
    return [(r.query_id, r["rank"], r.chunk_id) for r in result.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_equals_brute_force_with_many_copies(spark, way, metric):
    """A third of the rows are copies of one vector that many queries are near to."""
    rng = np.random.default_rng(7)
    rows = [list(row) for row in rng.integers(-2, 3, (300, 6)) / 2]
    hot = [0.5, 0.5, 0.0, 0.0, -0.5, 1.0]
    for i in range(0, 300, 3):
        rows[i] = hot
    rows[10] = None
    queries = [list(row) for row in rng.integers(-2, 3, (40, 6)) / 2] + [hot, [0.0] * 6]
    assert search(spark, queries, rows, 4, metric=metric, **way) == brute(queries, rows, 4, metric)


@pytest.mark.parametrize("way", WAYS)
def test_fewer_rows_than_k_and_no_rows(spark, way):
    assert search(spark, [[0, 0]], [[1, 0], None, [0, 2]], 3, **way) == [(0, 1, 0), (0, 2, 2)]
    assert search(spark, [[0, 0]], [None], 3, **way) == []
    assert search(spark, [None], [[1, 0]], 3, **way) == []


@pytest.mark.parametrize("way", WAYS)
def test_large_values_and_tiny_differences(spark, way):
    rows = [[1e4, 1.0], [1e4, 1.25], [1e4, 1.125], [-1e4, 0.0]]
    assert search(spark, [[1e4, 1.2]], rows, 2, **way) == [(0, 1, 1), (0, 2, 2)]


def test_vector_lengths_must_agree(spark):
    with pytest.raises(Exception, match="values"):
        search(spark, [[0, 0]], [[1, 0, 0]])


def test_string_query_ids_and_two_keys(spark):
    queries = spark.createDataFrame([("q", [0.0])], "query_id string, embedding array<float>")
    index = spark.createDataFrame([(2, 0, [1.0]), (1, 5, [1.0]), (1, 4, [1.0])], "doc_id bigint, pos int, embedding array<float>")
    for way in WAYS:
        result = knn_topk(queries, index, 2, keys=("doc_id", "pos"), **way).orderBy("rank").collect()
        assert [(r.query_id, r.doc_id, r.pos) for r in result] == [("q", 1, 4), ("q", 1, 5)]


def test_long_ids_count_in_what_is_broadcast(spark):
    rows = [("q" * 10_000 + str(i), [float(i)]) for i in range(20)]
    queries = spark.createDataFrame(rows, "_q string, _v array<double>")
    assert _take_bounded(queries, 100_000) is None
    assert _take_bounded(queries, 300_000).num_rows == 20


def test_distance_expressions(spark):
    row = spark.sql("select array(1f, 0f) a, array(0f, 2f) b, array(0f, 0f) z").select(
        squared_l2(F.col("a"), F.col("b")).alias("l2"),
        cosine_distance(F.col("a"), F.col("b")).alias("cos"),
        cosine_distance(F.col("a"), F.col("z")).alias("zero"),
    ).first()
    assert (row.l2, row.cos, row.zero) == (5.0, 1.0, 1.0)


def index_of(spark, *texts):
    rows = spark.createDataFrame([(i, 0, text) for i, text in enumerate(texts)], "doc_id bigint, pos int, chunk string")
    return index_rows(rows, hashed(64))


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id bigint, question string")


def test_first_text(spark):
    assert retrieve_first(ask(spark, "hello"), index_of(spark, "hello world"), hashed(64)).first().content == "hello world"
    empty = index_of(spark, "x").limit(0)
    assert retrieve_first(ask(spark, "hello"), empty, hashed(64)).first().content == ""


def test_answers_of_the_default_generator(spark):
    index = index_of(spark, "Cats sleep. Dogs bark loudly! Birds sing", "dogs bark\nfish swim", "nothing here")
    answers = answer_questions(ask(spark, "why do dogs bark", "zzz"), index, hashed(64)).orderBy("query_id").collect()
    assert [r.answer for r in answers][1] == ""
    assert set(answers[0].answer.split("\n")) == {"Dogs bark loudly!", "dogs bark"}


def test_generator_hook(spark):
    def load():
        def answer(questions, chunks):
            return questions + ":" + chunks

        def fold(questions, partials):
            return pd.Series(["+".join(parts) for parts in partials])

        return answer, fold

    generator = qa.from_model(load, prompt_fn=F.upper)
    index = index_of(spark, "one", "two")
    answer = answer_questions(ask(spark, "one"), index, hashed(64), generator, k=2).first().answer
    assert answer == "ONE:one+ONE:two"


@pytest.mark.parametrize("budget", [1, 300, 10**6])
def test_partials_folded_in_a_tree_give_what_they_give_at_once(spark, budget):
    """500 partials of one query, few of others; the default fold is associative."""
    draw = np.random.default_rng(1)
    rows = [(1, "q", i, f"part {draw.integers(80)}" if i % 5 else "") for i in range(500)]
    rows += [(2, "q", 7, "alone"), (3, "q", 0, ""), (4, "q", 1, "x"), (4, "q", 0, "y"), (5, "q", 0, "long " * 50), (5, "q", 2, "long")]
    partials = spark.createDataFrame(rows, "query_id bigint, question string, rank int, partial string").repartition(4)
    flat = {r.query_id: r.result for r in qa.qa_reduce(partials).collect()}
    tree = {r.query_id: r.result for r in qa.qa_reduce(partials, budget=budget).collect()}
    # Distinct lines: a fold of folds cuts the lines of its parts again.
    assert {q: list(dict.fromkeys(r.split("\n"))) for q, r in tree.items()} == {q: r.split("\n") for q, r in flat.items()}


def test_a_fold_in_a_tree_takes_no_more_than_its_budget(spark):
    def load():
        def fold(questions, partials):
            return pd.Series([f"<{len(parts)}:{max(map(len, parts))}>" if sum(map(len, parts)) <= 24 else "too much" for parts in partials])

        return (lambda questions, chunks: chunks), fold

    rows = [(1, "q", i, "1234") for i in range(100)]
    partials = spark.createDataFrame(rows, "query_id bigint, question string, rank int, partial string")
    assert "too much" not in qa.qa_reduce(partials, qa.from_model(load), budget=20).first().result


def test_keys_must_be_integers(spark):
    index = spark.createDataFrame([("0:1", [1.0])], "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    with pytest.raises(ValueError, match="chunk_id"):
        knn_topk(queries, index, keys=("chunk_id",))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Four updates of one index: every text once, some changed later."""
    path = str(tmp_path_factory.mktemp("stored") / "index")
    words = ["cat", "dog", "bird", "fish", "tree", "stone"]
    texts = [" ".join(words[(i * j) % 6] for j in range(1, 8)) + f" n{i}" for i in range(60)]
    for part in (texts[:30], texts[:40], [t + " again" if i % 9 == 0 else t for i, t in enumerate(texts)]):
        rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(part)], "doc_id bigint, pos int, chunk string")
        index_build(rows, hashed(32), path, bucket_bytes=400)
    return StoredIndex(spark, path)


ASKED = ["cat dog n3", "bird fish stone n41", "tree again", "nothing known", "n27"]


def retrieved(frame):
    return [tuple(r) for r in frame.orderBy("query_id", "rank").select("query_id", "rank", "doc_id", "pos", "distance", "chunk").collect()]


def test_a_stored_index_answers_as_its_rows_do(spark, stored):
    questions = ask(spark, *ASKED)
    for metric in ("l2", "cosine"):
        plain = rag_retrieve(questions, stored.rows(), hashed(32), metric=metric)
        assert retrieved(rag_retrieve(questions, stored, hashed(32), metric=metric)) == retrieved(plain)
    assert len(stored.versions) == 3
    first = retrieve_first(questions, stored, hashed(32)).collect()
    assert sorted(first) == sorted(retrieve_first(questions, stored.rows(), hashed(32)).collect())


def test_texts_are_read_from_named_buckets_and_documents(spark, stored):
    found = spark.createDataFrame([(3, 0), (41, 0), (3, 0), (9, 0), (99, 0)], "doc_id bigint, pos int")
    text = plan(stored.texts(found))
    scans = [line for line in text.split("\n") if "FileScan" in line or "Scan parquet" in line]
    assert any("bucket" in line and "In(doc_id" in line for line in scans), scans
    wanted = {r.doc_id: r.chunk for r in stored.rows().collect()}
    for named in (1000, 1):
        got = {(r.doc_id, r.chunk) for r in stored.texts(found, named_docs=named).collect()}
        assert got == {(i, wanted[i]) for i in (3, 41, 9)}


def test_a_stored_index_refuses_another_model(spark, stored):
    with pytest.raises(ModelMismatch):
        rag_retrieve(ask(spark, "x"), stored, hashed(16))


def test_an_empty_stored_index(spark, tmp_path):
    empty = open_index(spark, str(tmp_path / "index"), str(tmp_path / "none"), hashed(8))
    assert rag_retrieve(ask(spark, "x"), empty, hashed(8)).collect() == []
    assert retrieve_first(ask(spark, "x"), empty, hashed(8)).first().content == ""


def test_what_is_shuffled_does_not_grow_with_the_number_of_blocks(spark):
    """Rows that the exchange before the search takes in: copies of a side times its rows."""
    index = spark.range(2000).selectExpr("id vec_id", "array(float(id), float(id % 7)) embedding").cache()
    queries = index.withColumnRenamed("vec_id", "query_id")

    def shuffled(block_bytes):
        sent = {}
        original = type(index).mapInArrow
        def count(df, function, schema, *args):
            sent["rows"] = df.count()
            return original(df, function, schema, *args)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(type(index), "mapInArrow", count)
            found = knn_topk(queries, index, query_id="query_id", keys=("vec_id",), broadcast_bytes=0, block_bytes=block_bytes)
        assert found.count() == 6000
        return sent["rows"]

    assert shuffled(320) == shuffled(32_000) <= 2000 * (1 + spark.sparkContext.defaultParallelism)


def test_rows_of_which_none_comes_nearer_change_nothing():
    best, wanted = _Best(1, 1, 1), np.array([[0.0, 1.0]])
    for vector, key in (([0.0, 1.0], 1), ([9.0, 9.0], 2)):
        _improve(best, wanted, np.array([vector]), np.array([[key]]), "l2")
    assert (best.ids.item(), best.distance.item()) == (1, 0.0)


def test_a_scan_takes_a_bounded_number_of_rows_at_once(spark, monkeypatch):
    monkeypatch.setattr("sparrowline.operators.search._ROWS", 7)
    draw = np.random.default_rng(9)
    rows = [list(map(float, row)) for row in draw.normal(size=(100, 4))]
    asked = [list(map(float, row)) for row in draw.normal(size=(3, 4))]
    found = knn_topk(frame(spark, asked, "query_id"), frame(spark, rows, "chunk_id").coalesce(1), keys=("chunk_id",))
    assert [(r.query_id, r["rank"], r.chunk_id) for r in found.orderBy("query_id", "rank").collect()] == brute(asked, rows, 3, "l2")

import uuid
from collections import Counter
from hashlib import md5

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pytest

from sparrowline.functions.embedders import from_batches, from_model, hashed
from sparrowline.functions.splitter import split_text
from sparrowline.functions.text import WORD_SPACE, words
from sparrowline.operators import documents as ops
from sparrowline.operators.embedding import ModelMismatch, check_index_model, embed_once, embed_texts
from sparrowline.plans.index_build import build_index
from sparrowline.sources import documents as sources
from sparrowline.sources import files
from sparrowline.sources import index as index_source
from tests.test_plans import plan


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def chunks(df):
    return [(r.doc_id, r.pos, r.chunk) for r in df.orderBy("doc_id", "pos").collect()]


def test_fixed_chunks_at_the_edges(spark):
    emoji = "a" * 999 + "\U0001f600" + "b"
    found = chunks(ops.chunk_fixed(docs(spark, "", "x" * 1000, "x" * 1001, "y\n" * 1000, None, emoji)))
    assert [(d, p, len(c)) for d, p, c in found] == [
        (1, 0, 1000), (2, 0, 1000), (2, 1, 1), (3, 0, 1000), (3, 1, 1000), (5, 0, 1000), (5, 1, 1),
    ]
    assert found[-2][2] == emoji[:1000] and found[-1][2] == "b"


def test_overlapping_chunks(spark):
    text = "abcdefghij"
    found = chunks(ops.chunk_overlapping(docs(spark, text), size=4, overlap=1))
    assert [c for _, _, c in found] == [text[i : i + 4] for i in range(0, len(text), 3)]


def test_pages_are_joined_in_order(spark):
    pages = spark.createDataFrame(
        [(1, 2, "b"), (1, 0, "a"), (1, 1, None), (2, 0, None)], "doc_id bigint, page bigint, text string"
    )
    all_docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    joined = {r.doc_id: r.text for r in ops.assemble_pages(pages, all_docs).collect()}
    assert joined == {1: "a\n\nb", 2: "", 3: ""}


@pytest.mark.parametrize("block", [2, 7, 16384])
@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_chunks_of_pages_equal_chunks_of_documents(spark, monkeypatch, size, block):
    original = ops.running_total_in_blocks
    monkeypatch.setattr(ops, "running_total_in_blocks", lambda *args: original(*args, block=block))
    rows = [(1, i, "x" * (i % 5) + "\U0001f600é"[: i % 3]) for i in range(40)]
    rows += [(2, 0, None), (3, 0, ""), (3, 1, ""), (3, 2, "q"), (4, 7, "abc"), (4, 100_000, "def")]
    pages = spark.createDataFrame(rows, "doc_id bigint, page bigint, text string")
    assert chunks(ops.chunk_pages(pages, size=size)) == chunks(ops.chunk_fixed(ops.assemble_pages(pages), size=size))


def test_words(spark):
    found = ops.split_words(docs(spark, "foo bar", " a b c\x1cd\u0085 ", "")).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.token) for r in found] == [
        (0, 0, "foo"), (0, 1, "bar"), (1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"),
    ]


texts = st.text(alphabet=st.sampled_from("ab c\n\té\U0001f600"), max_size=300)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(2, 40), st.data())
def test_recursive_chunks_hold_the_text(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    found = split_text(text, size, overlap)
    assert all(1 <= len(chunk) <= size for chunk in found)
    assert all(chunk in text for chunk in found)
    # Every character that is not white space is in some chunk; without overlap,
    # in exactly one.
    kept, wanted = Counter("".join("".join(found).split())), Counter("".join(text.split()))
    assert wanted <= kept
    if overlap == 0:
        assert "".join("".join(found).split()) == "".join(text.split())


def test_recursive_chunks_prefer_paragraphs_and_overlap():
    assert split_text("aaa\n\nbbb\n\nccc", 8, 0) == ["aaa\n\nbbb", "ccc"]
    assert split_text("one two three four", 10, 5) == ["one two", "two three", "four"]
    assert split_text("", 10, 2) == []


def test_hashed_words_are_cut_outside_the_jvm_at_the_same_white_space(spark):
    texts = "".join(f"{word}{mark}" for word in ("one", "", "two") for mark in f"{WORD_SPACE}\u200b\ufeff\x00")
    rows = docs(spark, texts, WORD_SPACE, f" {WORD_SPACE}Three", "x" * 5000, *["pad"] * 2000)
    bags = rows.select(hashed(64).vector(ops.F.col("text")).alias("v"), words(ops.F.lower("text")).alias("words"))
    assert "split(" not in plan(bags.select("v"))
    for row in bags.collect():
        counts = np.zeros(64)
        for word in row.words:
            counts[int(md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
        wanted = counts / (np.sqrt((counts * counts).sum()) or 1.0)
        assert row.v == wanted.astype(np.float32).tolist()


def test_hashed_vectors_have_length_one(spark):
    rows = docs(spark, "a b a", "", None).select("doc_id", hashed(16).vector(ops.F.col("text")).alias("v")).collect()
    by_id = {r.doc_id: r.v for r in rows}
    assert sum(x * x for x in by_id[0]) == pytest.approx(1.0) and len(by_id[0]) == 16
    assert by_id[1] == [0.0] * 16
    assert by_id[2] is None


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("p1\fp2")
    (tmp_path / "b.txt").write_text("q1")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    pages = sources.scan_documents(spark, str(tmp_path), glob="*.txt").collect()
    assert sorted((r.path[-5:], r.page, r.text) for r in pages) == [("a.txt", 0, "p1"), ("a.txt", 1, "p2"), ("b.txt", 0, "q1")]


def test_custom_extractor_and_missing_pages(spark):
    files = spark.createDataFrame([("x", bytearray(b"ab"))], "path string, content binary")
    pages = sources.extract_pages(files, lambda data: [chr(b) if b != 97 else None for b in data]).collect()
    assert [(r.page, r.text) for r in pages] == [(0, None), (1, "b")]


def test_raw_text_is_replaced_and_may_be_missing(spark, tmp_path):
    path = str(tmp_path / "raw")
    assert sources.read_raw_text(spark, path).count() == 0
    sources.write_raw_text(docs(spark, "old", "older"), path)
    sources.write_raw_text(docs(spark, "new\nline\n"), path)
    assert [r.text for r in sources.read_raw_text(spark, path).collect()] == ["new\nline\n"]


def test_index_build_is_repeatable(spark, tmp_path):
    index, raw = str(tmp_path / "index"), str(tmp_path / "raw")
    first = spark.createDataFrame([(1, 0, "x" * 1500)], "doc_id bigint, page bigint, text string")
    more = first.unionByName(spark.createDataFrame([(2, 0, "hello")], first.schema))
    for pages, expected in ((first, 2), (first, 2), (more, 3)):
        build_index(pages, hashed(8), index, raw)
        assert index_source.read_index(spark, index).count() == expected
    build_index(more, hashed(8), index, raw, mode="overwrite")
    assert index_source.read_index(spark, index).count() == 3


def test_changed_documents_are_replaced_in_the_index(spark, tmp_path):
    index, raw = str(tmp_path / "index"), str(tmp_path / "raw")
    pages = [(1, 0, "a" * 25), (2, 0, "old text here"), (3, 0, "goes"), (4, 0, "same")]
    schema = "doc_id bigint, page bigint, text string"
    build_index(spark.createDataFrame(pages, schema), hashed(8), index, raw, size=10)
    pages = [(1, 0, "a" * 25), (2, 0, "NEW"), (3, 0, "")]
    for _ in range(2):
        build_index(spark.createDataFrame(pages, schema), hashed(8), index, raw, size=5)
        rows = index_source.read_index(spark, index).orderBy("doc_id", "pos").collect()
        assert [(r.doc_id, r.pos, r.chunk) for r in rows] == [(1, i, "aaaaa") for i in range(5)] + [(2, 0, "NEW"), (4, 0, "same")]
    build_index(spark.createDataFrame(pages, schema), hashed(16), index, raw, size=10)
    assert index_source.read_index(spark, index).groupBy("model").count().count() == 2


def chunked(spark, *texts):
    rows = [(i, pos, part) for i, text in enumerate(texts) for pos, part in enumerate(text.split("|")) if part]
    return spark.createDataFrame(rows, "doc_id bigint, pos int, chunk string")


def stored_chunks(spark, path):
    rows = index_source.read_index(spark, path).select("doc_id", "pos", "chunk").collect()
    return sorted((r.doc_id, r.pos, r.chunk) for r in rows)


def test_updates_are_versions_that_read_no_stored_text(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index_source.index_build(chunked(spark, "a|b", "c", "d"), hashed(8), path)
    plans = []
    changed = index_source._changed

    def watched(*args):
        found = changed(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(index_source, "_changed", watched)
    update = chunked(spark, "a|b", "C|more", "", "new")
    index_source.index_build(update, hashed(8), path, docs=spark.range(4).withColumnRenamed("id", "doc_id"))
    assert stored_chunks(spark, path) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "C"), (1, 1, "more"), (3, 0, "new")]
    scans = [line for line in plans[0].split("\n") if "FileScan" in line or "ReadSchema" in line]
    assert scans and not any("chunk" in line for line in scans)
    # Only the documents that changed were written.
    written = spark.read.parquet(f"{path}/rows/version=2")
    assert sorted(r.doc_id for r in written.select("doc_id").distinct().collect()) == [1, 3]
    # The same once more brings nothing.
    index_source.index_build(update, hashed(8), path, docs=spark.range(4).withColumnRenamed("id", "doc_id"))
    assert len(index_source.StoredIndex(spark, path).versions) == 2


def test_a_kill_before_the_switch_leaves_the_old_index(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index_source.index_build(chunked(spark, "a", "b"), hashed(8), path)
    before = stored_chunks(spark, path)

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(index_source, "_publish", killed)
        for mode in ("append", "overwrite"):
            with pytest.raises(KeyboardInterrupt):
                index_source.index_build(chunked(spark, "x", "b", "y"), hashed(8), path, mode)
            assert stored_chunks(spark, path) == before
    index_source.index_build(chunked(spark, "x", "b"), hashed(8), path)
    assert stored_chunks(spark, path) == [(0, 0, "x"), (1, 0, "b")]


def test_the_second_of_two_updates_at_once_fails(spark, tmp_path):
    path = str(tmp_path / "index")
    index_source.index_build(chunked(spark, "a"), hashed(8), path)
    versions = index_source.StoredIndex(spark, path).versions
    index_source._publish(spark, path, versions, 2)
    with pytest.raises(RuntimeError, match="another update"):
        index_source._publish(spark, path, versions, 2)


def test_compaction_keeps_rows_and_splits_buckets(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = [f"text {i}|" + "x" * 50 for i in range(20)]
    index_source.index_build(chunked(spark, *texts[:10]), hashed(8), path, bucket_bytes=10_000)
    for i in (3, 12, 20):
        index_source.index_build(chunked(spark, *texts[:i], *(t + "!" for t in texts[i:])), hashed(8), path, bucket_bytes=200)
    before = stored_chunks(spark, path)
    index = index_source.StoredIndex(spark, path)
    assert [v.buckets for v in index.versions][0] == 1 and len(index.versions) == 4
    index_source.compact_index(spark, path, bucket_bytes=200)
    assert stored_chunks(spark, path) == before == stored_chunks(spark, path)
    (version,) = index_source.StoredIndex(spark, path).versions
    assert version.buckets >= 4 and version.buckets & (version.buckets - 1) == 0
    index_source.index_build(chunked(spark, *texts), hashed(8), path)
    assert len(index_source.StoredIndex(spark, path).versions) == 1


def test_index_is_opened_or_built(spark, tmp_path):
    index, raw = str(tmp_path / "index"), str(tmp_path / "raw")
    sources.write_raw_text(docs(spark, "hello world"), raw)
    assert [r.chunk for r in index_source.index_open(spark, index, raw, hashed(8)).collect()] == ["hello world"]
    sources.write_raw_text(docs(spark, "changed"), raw)
    assert [r.chunk for r in index_source.index_open(spark, index, raw, hashed(8)).collect()] == ["hello world"]
    assert index_source.index_open(spark, str(tmp_path / "i2"), str(tmp_path / "none"), hashed(8)).count() == 0


def test_another_model_is_refused(spark):
    rows = index_source.index_rows(docs(spark, "a").selectExpr("doc_id", "0 pos", "text chunk"), hashed(8))
    assert check_index_model(rows, hashed(8)).count() == 1
    with pytest.raises(ModelMismatch):
        check_index_model(rows, hashed(16))


def test_model_hook(spark):
    def load():
        return lambda texts: texts.map(lambda t: [float(len(t)), 1.0])

    embedder = from_model("length", 2, load)
    assert docs(spark, "abc").select(embedder.vector(ops.F.col("text")).alias("v")).first().v == [3.0, 1.0]


def write_all(folder, **contents):
    folder.mkdir(exist_ok=True)
    for name, content in contents.items():
        (folder / f"{name}.txt").write_bytes(content)
    return str(folder)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1 << 20])
def test_pages_of_files_in_byte_ranges(spark, tmp_path, size):
    contents = {"a": "é one\ftwo\f\fthree".encode(), "b": b"", "c": b"\f", "d": b"x" * 50, "e": b"tail\f", "f": b"bad \xff\xfe"}
    path = write_all(tmp_path / "in", **contents)
    write_all(tmp_path / "in" / "_hidden", z=b"not read")
    found = files.read_pages(spark, path, range_bytes=size).collect()
    got = sorted((r.path.rsplit("/", 1)[1][0], r.page, r.text) for r in found)
    assert got == [(n, i, t) for n, c in contents.items() for i, t in enumerate(c.decode("utf-8", "replace").split("\f"))]


def test_large_files_are_split_and_small_ones_read_together(tmp_path):
    path = write_all(tmp_path / "in", big=b"x" * 1_000_000, **{f"s{i}": b"y" for i in range(40)})
    listed = files.list_files(path)
    ranges = [r for _, name, size in listed for r in files.ranges_of(name, size, 200_000)]
    shares = files.shares_of(iter(ranges), 200_000)
    assert sum(len(s.ranges) for s in shares) == len(ranges) == 45
    assert 5 <= len(shares) <= 5 + 40 // 3
    assert max(sum(r.high - r.low for r in s.ranges) for s in shares) <= 200_000


def test_files_with_an_extractor_and_a_glob(spark, tmp_path):
    path = write_all(tmp_path / "in", a=b"1,2", b=b"3")
    (tmp_path / "in" / "c.bin").write_bytes(b"9,9")
    pages = files.read_pages(spark, path, "*.txt", lambda content: content.decode().split(","))
    assert sorted((r.page, r.text) for r in pages.collect()) == [(0, "1"), (0, "3"), (1, "2")]
    assert files.read_pages(spark, write_all(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="FileNotFound"):
        files.read_pages(spark, str(tmp_path / "missing")).collect()


def test_files_written_and_read_as_a_stream(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / name) for name in ("files", "out", "checkpoint"))

    def add(*rows):
        files.write_files(spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in rows], "name string, content binary"), source)

    def run():
        query = files.stream_pages(spark, source).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.path.rsplit("/", 1)[1], r.start, r.text) for r in spark.read.parquet(out).collect())

    add(("a", b"one\ftwo"), ("none", None))
    first = [("a", 0, "one"), ("a", 4, "two")]
    assert run() == first
    add(("b", b"three"))
    assert run() == [*first, ("b", 0, "three")]
    assert run() == [*first, ("b", 0, "three")]


def counted(folder, dim=4):
    """An embedder that leaves a file for every call, with the texts' lengths."""

    def make():
        def predict(texts):
            (folder / uuid.uuid4().hex).write_text("\n".join(f"{len(t)}:{t}" for t in texts))
            return np.array([[len(t), t.count("a"), 1.0, 0.0] for t in texts], np.float32)

        return predict

    folder.mkdir()
    return from_batches("counted", dim, make, batch_size=3)


def calls(folder):
    return [path.read_text().split("\n") for path in folder.iterdir()]


def test_equal_chunks_are_embedded_once_and_updates_embed_new_ones(spark, tmp_path):
    embedder = counted(tmp_path / "calls")
    path, vectors = str(tmp_path / "index"), str(tmp_path / "vectors")
    first = chunked(spark, "a|b|aa", "a|a", "a|ccc")
    index_source.index_build(first, embedder, path, vectors=vectors)
    asked = [line for call in calls(tmp_path / "calls") for line in call]
    assert sorted(asked) == ["1:a", "1:b", "2:aa", "3:ccc"]
    assert all(len(call) <= 3 for call in calls(tmp_path / "calls"))
    index_source.index_build(chunked(spark, "a|b|aa", "a|a", "a|ccc|b", "new|a"), embedder, path, vectors=vectors)
    asked = [line for call in calls(tmp_path / "calls") for line in call]
    assert sorted(asked) == ["1:a", "1:b", "2:aa", "3:ccc", "3:new"]
    rows = index_source.read_index(spark, path).collect()
    assert {(r.chunk, tuple(r.embedding)) for r in rows} == {
        (t, (float(len(t)), float(t.count("a")), 1.0, 0.0)) for t in ("a", "b", "aa", "ccc", "new")
    }
    assert len(rows) == 10


def test_embedding_once_keeps_rows_columns_and_nulls(spark, tmp_path):
    rows = [(1, "x", "k"), (1, "x", "k"), (2, None, None), (3, "", "z")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    for _ in range(2):
        got = embed_once(frame, hashed(4), str(tmp_path / "store")).collect()
        plain = embed_texts(frame, hashed(4)).collect()
        assert Counter(map(str, got)) == Counter(map(str, plain))

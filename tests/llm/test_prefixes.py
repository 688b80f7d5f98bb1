"""Prefix tables and ids against the library of the rank files."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowline.llm import prefixes, queries

DOCS = "doc_id long, text string"
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "日本", "'s", "1", "22", "!", "\x1c", "\x85", "\xa0", "ing", "́", "😀"]
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return prefixes.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def bpe(ranks):
    return prefixes.PrefixBpe(ranks, PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    pairs = map(bytes.split, ranks.splitlines())
    merges = {base64.b64decode(a): int(b) for a, b in pairs}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def ids(packed):
    return memoryview(packed).cast("I").tolist()


def text(draw, most=30):
    return "".join(draw.choice(PARTS) for _ in range(draw.randint(0, most)))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(bpe, library, words):
    assert ids(bpe.encode(words)) == library.encode_ordinary(words)
    assert bpe.decode(bpe.encode(words)) == words.encode()


def test_every_character(bpe, library):
    for low in range(0, 0x110000, 0x800):
        some = " a".join(chr(c) for c in range(low, low + 0x800) if not 0xD800 <= c < 0xE000) + "  x"
        assert ids(bpe.encode(some)) == library.encode_ordinary(some)


def test_white_space_and_odd_parts(bpe, library):
    draw = random.Random(1)
    for _ in range(5000):
        some = text(draw)
        assert ids(bpe.encode(some)) == library.encode_ordinary(some)


@pytest.mark.parametrize("word", ["a" * 50_000, "ab" * 20_000, "日本語" * 4000, "qz1" * 9000, " " * 9000 + "x"])
def test_very_long_words(bpe, library, word):
    assert ids(bpe.encode(word)) == library.encode_ordinary(word)


def test_edits_keep_the_table_exact(bpe, library):
    draw = random.Random(4)
    for _ in range(400):
        some = text(draw, 40)
        table = prefixes.PrefixTable.of(bpe, some)
        for _ in range(3):
            low = draw.randint(0, len(some))
            high, put = draw.randint(low, len(some)), text(draw, 4)
            table.replace(low, high, put)
            some = some[:low] + put + some[high:]
            assert table.text == some
            assert table.ids() == library.encode_ordinary(some)
        assert table.packed() == prefixes.PrefixTable.of(bpe, some).packed()


def test_an_append_works_out_new_bytes_only(bpe, library):
    table = prefixes.PrefixTable.of(bpe, "x" * 30_000)
    table.append("yz")
    assert table.made == 2
    assert table.ids() == library.encode_ordinary("x" * 30_000 + "yz")


def test_an_edit_stays_near_its_place(bpe, library):
    words = "some words in a row " * 2000
    table = prefixes.PrefixTable.of(bpe, words)
    table.replace(20_001, 20_003, "QQ")
    assert table.made < 40
    assert table.ids() == library.encode_ordinary(words[:20_001] + "QQ" + words[20_003:])


def test_places_outside_the_text_are_refused(bpe):
    with pytest.raises(ValueError, match="no characters"):
        prefixes.PrefixTable.of(bpe, "abc").replace(2, 9, "")


def test_a_file_without_all_bytes_is_refused():
    with pytest.raises(ValueError, match="single byte"):
        prefixes.PrefixBpe(b"YQ== 0\n", PATTERN)


def test_columns(spark, ranks, library):
    rows = [(1, "Hello there, you"), (1, "Hello there, you"), (2, None), (3, ""), (None, "é <|endoftext|>"), (4, "long " * 90_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("d"))
    both = prefixes.round_trip(F.col("text"), ranks, PATTERN).alias("both")
    got = docs.select("text", "ids", both, prefixes.encode(F.col("text"), ranks, PATTERN).alias("e")).collect()
    assert len(got) == len(rows)
    for row in got:
        wanted = library.encode_ordinary(row.text or "")
        assert row.e == ids(bytes(row.both.ids)) == wanted
        assert bytes(row.both.decoded) == (row.text or "").encode()
        assert row["ids"] == 1
    assert docs.limit(0).select(both).count() == 0


def test_edited_columns(spark, ranks, library):
    rows = [(1, "one two three", 4, 7, "2"), (2, "tail", None, None, "s!"), (3, None, 0, 0, "new"), (4, "gone", 0, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, b int, e int, put string")
    docs = docs.withColumn("table", prefixes.prefix_table(F.col("text"), ranks, PATTERN))
    edited = prefixes.edit_text(F.col("text"), F.col("table"), F.col("b"), F.col("e"), F.col("put"), ranks, PATTERN)
    got = {r.doc_id: r.x for r in docs.select("doc_id", edited.alias("x")).collect()}
    assert {i: x.text for i, x in got.items()} == {1: "one 2 three", 2: "tails!", 3: "new", 4: ""}
    for x in got.values():
        assert x.ids == library.encode_ordinary(x.text)


def test_query_against_the_library(spark, library, tmp_path):
    draw = random.Random(8)
    rows = [(i, text(draw, 60)) for i in range(200)] + [(500, None), (501, ""), (None, "no id")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_prefix_bpe(spark, str(tmp_path)).collect()}
    for doc_id, some in rows:
        wanted = library.encode_ordinary(some or "")
        packed = b"".join(i.to_bytes(4, "little") for i in wanted)
        digests = (hashlib.sha256(packed).hexdigest(), hashlib.sha256((some or "").encode()).hexdigest())
        assert got[doc_id] == (len(wanted), *digests)


def test_valid_pairs_are_those_that_plain_merges_give(bpe):
    """Every byte pair, and pairs of frequent and of any tokens."""
    draw = random.Random(3)
    every, often = list(bpe.tokens), sorted(bpe.tokens)[:4000]
    pairs = [(draw.choice(some), draw.choice(some)) for some in (every, often) for _ in range(15_000)]
    pairs += [(i, j) for i in range(256) for j in range(0, 256, 3)]
    for left, right in pairs:
        both = [bpe.tokens[left], bpe.tokens[right]]
        assert bpe.valid[left << 32 | right] == (bpe.merged(both[0] + both[1]) == both)


def test_a_token_no_merge_makes_is_a_word_but_no_part():
    """``xyz`` has a rank, but neither ``xy`` nor ``yz`` has: it is found as a whole word only."""
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"xyz"]
    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    bpe = prefixes.PrefixBpe(lines, PATTERN)
    merges = {t: i for i, t in enumerate(tokens)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    for word in ("xyz", "axyz", "xyza", "abxyzab", "xyz xyz"):
        assert ids(bpe.encode(word)) == library.encode_ordinary(word)
        assert prefixes.PrefixTable.of(bpe, word).ids() == library.encode_ordinary(word)
    table = prefixes.PrefixTable.of(bpe, "xyz")
    table.append("a")
    assert table.ids() == library.encode_ordinary("xyza")

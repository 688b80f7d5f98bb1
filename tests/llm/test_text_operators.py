"""Mixing, BPE, quality rules and line dedup."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparrowline.llm import bpe, lines, mixing, quality
from tests.llm import brute

DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def definition():
    return bpe.load(public_tokenizers.path("byte_bpe_50k.json"))


def mixed(spark, rows, cycle=(5.0, 2.0, 1.0), **options):
    docs = spark.createDataFrame(rows, DOCS)
    return mixing.mix_sources(docs, mixing.cyclic(cycle), **options)


def water_fill(sizes, weights, epochs):
    """Targets by the rule as it reads: clamp, reshare, again."""
    target, free, left = {}, dict(weights), float(sum(sizes.values()))
    while free:
        level = left / sum(free.values())
        above = {s for s in free if free[s] * level >= sizes[s] * epochs}
        if not above:
            return target | {s: w * level for s, w in free.items()}
        for s in above:
            target[s] = sizes[s] * epochs
            left -= target[s]
            del free[s]
    return target


def test_targets_are_clamped_and_reshared(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(4, "a"), (30, "b"), (400, "c"), (7, None), (9, "é"), (0, "z")])]
    got = {r.source: r.target for r in mixed(spark, rows).collect()}
    sizes = {"a": 4, "b": 30, "c": 400, "z": 0, "é": 9, None: 7}
    wanted = water_fill(sizes, dict(zip(sizes, [5, 2, 1, 5, 2, 1], strict=True)), 3)
    assert got.keys() == wanted.keys()
    for source in wanted:
        assert got[source] == pytest.approx(wanted[source])


def test_mix_comes_near_its_targets_and_repeats(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(1, 40), draw.choice("aaaaaaaabcd")) for i in range(3000)]
    first, again = (sorted(mixed(spark, rows).select("doc_id", "taken", "copies").collect()) for _ in range(2))
    assert first == again
    assert all(r.copies <= 3 for r in first)
    totals = mixed(spark, rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    for row in totals.collect():
        assert abs(row.taken - row.target) <= 20
    assert mixing.repeat_rows(mixed(spark, rows)).count() == sum(r.copies for r in first)


def test_mixing_takes_odd_rows(spark):
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x y", "a"), (2, "x y", "a")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("mine")).withColumn("size", F.lit("mine"))
    got = mixing.mix_sources(docs, mixing.cyclic((1.0,))).collect()
    assert len(got) == 5 and {r["size"] for r in got} == {"mine"}
    assert sum(r.taken for r in got) == 4
    empty = mixing.mix_sources(docs.limit(0), mixing.cyclic((1.0,)))
    assert empty.count() == 0
    nothing = mixing.mix_sources(docs, lambda sources: sources.withColumn("weight", F.lit(None).cast("double")))
    assert {r.taken for r in nothing.collect()} == {0}


def test_mixing_runs_no_python(spark):
    plan = mixed(spark, [(1, "a b", "x")])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


TEXTS = [
    None, "", " ", "Hello world", "it's we'll   spaced \n\n\t out ", "naïve Ärger 東京 😀👍🏽", "a<|endoftext|>b<|endoftext|>",
    "x" * 3000, "ab" * 500 + "\x00\x01", "0123456789" * 20, "  　 z", "the " * 500, "ß" * 70 + " " + "-=" * 90,
]


def test_bpe_equals_the_public_library(spark, definition):
    own = Tokenizer.from_str(definition)
    draw = random.Random(5)
    letters = "abcdefghij ETAOIN shrdlu\n\t'.,é漢😀0123456789<|>"
    texts = TEXTS + ["".join(draw.choices(letters, k=draw.randint(1, 300))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    ids = docs.select("id", "text", bpe.encode(F.col("text"), definition).alias("ids"))
    for row in ids.withColumn("back", bpe.decode(F.col("ids"), definition)).collect():
        wanted = own.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == wanted, repr(row.text)
        assert row.back == own.decode(wanted, skip_special_tokens=False) == (row.text or "")


def test_short_and_long_merges_agree(definition):
    known = bpe.Vocabulary(definition)
    draw = random.Random(7)
    for _ in range(300):
        word = bytes(draw.choices(b"etaoin shrdlu\xc3\xa9", k=draw.randint(1, 64)))
        assert known.merge_short(word) == known.merge_long(word)


def test_decoding_takes_odd_ids(spark, definition):
    rows = spark.createDataFrame([(None,), ([],), ([50256, 999_999],), ([255],)], "ids array<int>")
    got = [r[0] for r in rows.select(bpe.decode(F.col("ids"), definition)).collect()]
    assert got[:3] == ["", "", "<|endoftext|>"] and got[3] == Tokenizer.from_str(definition).decode([255])
    assert rows.limit(0).select(bpe.encode(F.lit("a"), definition)).count() == 0


QUALITY = [
    None, "", "one", "a b c a b c a b c", "x\ny\n x\nx\n\n\n", "# $ % a|b <b>", "a a a a a a", "a b c d a b c e\x0b\x0cf",
    "good words go here in a row of many " * 9, "Ünïcode   wörds 　 here", " \t\n ",
]


def test_measures_equal_brute_force(spark):
    draw = random.Random(1)
    texts = QUALITY + [" ".join(draw.choices("abcd#\n", k=draw.randint(0, 60))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("mine"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for row in quality.ledger(docs).collect():
        assert tuple(row[n] for n in names) == brute.measures(texts[row.doc_id]), repr(texts[row.doc_id])


def test_policies_are_masks_over_one_ledger(spark):
    words = " ".join(f"w{i}" for i in range(60))
    texts = [words, "few words", words + " #" * 20, "a b c " * 30, words + "\n" + "\n".join(["same line"] * 30), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries = quality.ledger(docs).cache()
    kept = lambda policy: {r.doc_id for r in entries.filter(quality.passes(policy, F.col("failed_bits"))).collect()}
    assert kept(quality.BASE) == {0, 2, 4} - ({4} if 4 not in kept(quality.BASE) else set())
    assert kept(quality.V1) == kept(quality.BASE) - {2}
    assert kept(quality.V2) == {0}
    assert {r.doc_id for r in quality.keep_passing(docs, quality.V2).collect()} == {0}
    rows = {(r.version, r.rule): r for r in quality.ablations(entries, (quality.V1, quality.V2)).collect()}
    assert rows["v1", "symbols"].failed_alone == 1 and rows["v1", "too_few_words"].kept == len(kept(quality.V1))
    assert quality.ledger(docs.limit(0)).count() == 0


def test_every_bit_belongs_to_one_rule():
    assert len(set(quality.BIT.values())) == len(quality.RULES)
    assert quality.V2.mask & quality.BASE.mask == quality.BASE.mask


def test_lines_equal_brute_force(spark):
    draw = random.Random(9)
    pool = ["Shared", " shared\t", "SHARED\r", "", "  ", "ünï", "own"]
    rows = [(i, "\n".join(draw.choices(pool, k=draw.randint(0, 6)) + [f"line {i % 7}"] * (i % 2))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "Shared\nnull id"), (None, "x"), (3, rows[3][1]), (3, "Shared\nother text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("mine")).withColumn("lang", F.lit("en"))
    got = lines.dedup_lines(docs, min_docs=5)
    assert set(got.columns) == {"doc_id", "text", "lang", "n_lines", "n_dropped"}
    wanted = brute.line_dedup(rows, 5)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=order) == sorted(wanted, key=order)
    assert lines.dedup_lines(docs.limit(0), min_docs=5).count() == 0


def test_a_long_text_of_shared_lines_is_cut_once(spark):
    text = "\n".join(f"line {i % 5000}" for i in range(50_000))
    rows = [(i, text) for i in range(3)] + [(9, "kept")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3).collect()}
    assert got[0] == (50_000, 50_000, "") and got[9] == (1, 0, "kept")


def test_digest_of_no_text_is_that_of_the_empty_string():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_ids_and_decoded_text_in_one_pass(spark, definition):
    own = Tokenizer.from_str(definition)
    texts = [None, "", " two  words\n", "é <|endoftext|> x<|endoftext|>", "日本語" * 500, "word " * 40_000, "a" * 5000, "a b", "a b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit("x"))
    got = docs.select("doc_id", "ids", bpe.round_trip(F.col("text"), definition).alias("both")).collect()
    for row in got:
        ids = own.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.both.ids == ids
        assert row.both.decoded == own.decode(ids, skip_special_tokens=False)
    assert docs.limit(0).select(bpe.round_trip(F.col("text"), definition)).count() == 0

"""Periodic runs against a search over all periods and places."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowline.llm import queries, runs

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def has_period(words, q):
    return all(words[i] == words[i - q] for i in range(q, len(words)))


def all_runs(words):
    """Every maximal stretch of each period, kept if no smaller period fits it."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        start = 0
        while start + q < len(words):
            end = start + q
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            stretch = words[start:end]
            if len(stretch) >= max(6, 4 * q) and not any(has_period(stretch, p) for p in range(1, q)):
                found.append((start, end - start, q))
            start = end - q + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words):
    numbers = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    if doc_id is not None:
        words = planted(doc_id, words)
    found = all_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    covered = {i for s, n, q in found for i in range(s + q, s + n)}
    return (
        len(found),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{n},{q}\n" for s, n, q in found)),
        digest(" ".join(w for i, w in enumerate(words) if i not in covered)),
    )


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("aab"), max_size=60))
def test_runs_of_few_words(words):
    assert runs.runs_of(numbered(words)) == all_runs(words)


def test_runs_of_nested_and_long_periods():
    draw = random.Random(5)
    for _ in range(150):
        words = []
        for _ in range(draw.randint(1, 4)):
            base = [draw.choice("abcdef") for _ in range(draw.randint(1, 12))]
            if draw.random() < 0.4:
                base = base * draw.randint(1, 5) + [draw.choice("abc")]
            words += base * draw.randint(1, 6) + [draw.choice("xyz")] * draw.randint(0, 8)
        assert runs.runs_of(numbered(words)) == all_runs(words)


def test_a_frequent_gram_makes_no_pairs_of_all_its_places():
    """Each class pairs a place once at most, however often its gram comes."""
    words = numbered((["a"] * 8 + ["b"]) * 3000)
    made = sum(len(places) for _, _, places, _ in runs._classes(words))
    assert made <= 16 * len(words)
    assert (0, len(words), 9) in runs.runs_of(words)


@pytest.mark.parametrize("period", [1, 7, 1000])
def test_a_very_long_run(period):
    words = np.arange(200_000) % period
    assert runs.runs_of(words) == [(0, 200_000, period)]


def test_odd_texts(spark):
    again = "la " * 9
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, again), (4, again), (None, again), (5, "one two"), (6, "a b " * 8)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("runs", F.lit("x")).withColumn("n_words", F.lit(0))
    got = docs.select("doc_id", "text", "runs", runs.find_runs(F.col("text")).alias("f")).collect()
    for row in got:
        words = [w.decode() for w in (row.text or "").encode().split()]
        assert [tuple(r) for r in row.f.runs] == all_runs(words)
        assert row.f.n_words == len(words)
        assert row["runs"] == "x"
    assert docs.limit(0).select(runs.find_runs(F.col("text"))).count() == 0


def test_strongest_breaks_ties_by_start(spark):
    text = "a a a a a a a a b c b c b c b c d d d d d d d d"
    found = spark.createDataFrame([(1, text)], DOCS).select(runs.find_runs(F.col("text")).alias("f"))
    best = found.select(runs.strongest(F.col("f.runs")).alias("best")).first().best
    assert tuple(best) == (0, 8, 1)


def test_planted_tails(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 80)))) for i in range(300)]
    rows += [(None, "a b c"), (10**15, "a  b\nc " * 20), (-4, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for row in runs.repeat_tails(docs.withColumn("was", F.col("text"))).collect():
        words = [w.decode() for w in (row.was or "").encode().split()]
        if row.doc_id is not None and words and zlib.crc32(str(row.doc_id).encode()) % 10 == 0:
            assert row.text == " ".join(planted(row.doc_id, words))
        else:
            assert row.text == row.was


def test_query_against_brute_force(spark, tmp_path):
    """Whole rows of the query, over texts of the small table."""
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 1500").select("doc_id", "text")
    draw = random.Random(1)
    made = [(10**6 + i, " ".join(draw.choice(["x", "y"]) for _ in range(draw.randint(0, 40)))) for i in range(200)]
    rows = [tuple(r) for r in texts.collect()] + made + [(7_000_000, None), (None, "w " * 10)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {doc_id: expected(doc_id, text) for doc_id, text in rows}

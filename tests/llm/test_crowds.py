"""Large groups of near copies that do not all link: classes are exact, and no pairs are made of a group."""

import random

import numpy as np
import pytest

from sparrowline.llm import links, shingles
from tests.llm import brute


def crowd(seed, members, places=40, changed=5, n=120):
    """Copies of one text, each with its words changed at some of a few places, the same way as in others."""
    draw = random.Random(seed)
    rows = []
    for doc in range(members):
        text = [f"w{i}" for i in range(n)]
        for i in draw.sample(range(0, n, n // places), changed):
            text[i] = f"other{i}"
        rows.append((doc * 3 + 1, " ".join(text)))
    return rows


def test_pairs_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    made, plain = {}, links.materialise

    def counting(df, name):
        out = plain(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(links, "materialise", counting)
    rows = crowd(5, 160)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.join_shingles(docs, width=4, percent=85).collect()}
    assert got == brute.shingle_classes(rows, 4, 85)
    assert 1 < len(set(got.values())) < len(rows)
    assert made["links-pairs"] < 10 * len(rows)


@pytest.mark.parametrize("held", [1, 64])
def test_classes_of_a_group_in_many_blocks(spark, monkeypatch, held):
    monkeypatch.setattr(shingles, "_HUBS", held)
    monkeypatch.setattr(links, "_SHINGLES", held * 100)
    rows = crowd(7, 60) + [(doc + 1000, text.replace("w", "v")) for doc, text in crowd(8, 40, changed=4)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.join_shingles(docs, width=4, percent=85).collect()}
    assert got == brute.shingle_classes(rows, 4, 85)


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_sketches_of_similar_sets_are_near(percent):
    draw, cut, told = np.random.default_rng(percent), shingles.Fragments(percent), [0, 0]
    for _ in range(1500):
        a = draw.integers(0, 1 << 63, int(draw.integers(1, 700)), np.uint64)
        lost, more = (int(draw.integers(0, len(a) * (100 - percent) // 100 + 2)) for _ in range(2))
        b = np.unique(np.append(a[min(lost, len(a) - 1) :], draw.integers(0, 1 << 63, more, np.uint64)))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        similar = 100 * both >= percent * (len(a) + len(b) - both)
        near = cut.may_be_similar(len(a), cut.sketch(a), len(b), cut.sketch(b))
        assert near or not similar
        told[similar] += 1
    far = [np.unique(draw.integers(0, 1 << 63, 300, np.uint64)) for _ in range(2)]
    assert not cut.may_be_similar(300, cut.sketch(far[0]), 300, cut.sketch(far[1]))
    assert min(told) > 50
    assert cut.sketch(np.zeros(0, np.uint64)) == b""

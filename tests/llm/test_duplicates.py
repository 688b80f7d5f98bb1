"""Shingle join, suffix dedup and passage dedup."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowline.llm import links, passages, shingles, suffixes
from sparrowline.llm.components import connected_components
from tests.llm import brute

ODD = [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two  WORDS"), (905, "one"), (None, "two words"), (None, None)]


def edited(draw, base, share):
    return [w if draw.random() > share else f"e{draw.randint(0, 10**6)}" for w in base]


def near_copies(seed, groups=12, most=14):
    """Groups of copies from exact to barely similar, some sharing a passage."""
    draw = random.Random(seed)
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for group in range(groups):
        base = [f"g{group}w{draw.randint(0, 400)}" for _ in range(draw.choice([3, 6, 12, 40, 150, 400]))]
        if group % 3 == 0:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(draw.randint(1, most)):
            rows.append(" ".join(edited(draw, base, draw.choice([0, 0, 0.005, 0.01, 0.02, 0.03, 0.06]))))
    draw.shuffle(rows)
    return list(enumerate(rows)) + ODD + [(3, rows[3]), (4, "another text of the fourth id")]


@pytest.mark.parametrize(("width", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 50, 3), (3, 100, 4)])
def test_classes_equal_brute_force(spark, width, percent, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("mine")).withColumn("key", F.lit(1))
    got = shingles.join_shingles(docs, width=width, percent=percent).collect()
    wanted = brute.shingle_classes(rows, width, percent)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(wanted.items())
    assert all(r.component_id is None for r in got if r.doc_id is None)
    sizes = sorted(len(brute.shingle_set(text, width)) for _, text in rows)
    assert sorted(r.n_shingles for r in got) == sizes


def test_a_crowd_of_near_copies_is_not_paired_off(spark):
    """Copies whose links go every way: classes are exact, and hopeless members are thinned out."""
    draw = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(draw, base, draw.choice([0.002, 0.01, 0.02, 0.05])))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.join_shingles(docs, width=4, percent=85).collect()}
    assert got == brute.shingle_classes(rows, 4, 85)


def test_similar_sets_agree_on_a_fragment():
    draw = random.Random(2)
    for percent in (50, 80, 85, 95):
        cut = shingles.Fragments(percent)
        for _ in range(300):
            size = draw.choice([1, 2, 5, 7, 20, 60, 300])
            base = [draw.getrandbits(64) for _ in range(size)]
            lost = draw.randint(0, size)
            other = base[lost:] + [draw.getrandbits(64) for _ in range(draw.randint(0, lost))]
            x, y = set(base), set(other)
            if brute.similar(x, y, percent):
                keys = [set(cut.keys(np.unique(np.array(list(s), np.uint64)))[0].tolist()) for s in (x, y)]
                assert keys[0] & keys[1]


def test_empty_tables_have_no_classes(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shingles.join_shingles(empty).count() == 0
    assert passages.repeated_passages(empty).count() == 0
    assert suffixes.remove_repeats(empty).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    wanted = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert got == wanted


def repeating_texts(seed):
    draw = random.Random(seed)
    shared = ["".join(draw.choices("abcdefé \n", k=n)) for n in (60, 99, 100, 101, 150, 400)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(draw.randint(0, 5)):
            parts.append(draw.choice(shared) if draw.random() < 0.5 else "".join(draw.choices("uvwxyzü ", k=draw.randint(0, 200))))
        rows.append((i, "".join(parts)))
    return rows + [(70, "ab" * 300), (71, "a" * 500), (72, None), (73, ""), (74, "ab" * 70), (75, "短" * 80)]


@pytest.mark.parametrize(("seed", "many"), [(1, 8), (2, 2), (3, 1)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed, many):
    """``many`` at 1 and 2 sends most anchors the way of the crowded ones."""
    monkeypatch.setattr(suffixes, "_MANY", many)
    rows = repeating_texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("kept", F.lit(1)).withColumn("doc", F.lit(1))
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    for (doc, text), spans in zip(rows, brute.repeats(rows, 100), strict=True):
        data, row = (text or "").encode(), got[doc]
        assert [row.spans[i : i + 2] for i in range(0, len(row.spans), 2)] == spans
        gone = set().union(*[range(a, b) for a, b in spans])
        assert bytes(row.kept) == bytes(b for i, b in enumerate(data) if i not in gone)
        assert (row.n_bytes, row.n_removed) == (len(data), len(gone))


def test_long_texts_are_hashed_block_by_block(monkeypatch):
    data = np.frombuffer(random.Random(4).randbytes(5000), np.uint8)
    whole = suffixes.window_hashes(data, 100)
    monkeypatch.setattr(suffixes, "_BLOCK", 300)
    assert (suffixes.window_hashes(data, 100) == whole).all()


def test_repeated_rows_and_null_ids_have_a_place(spark):
    text = "".join(random.Random(6).choices("abcdefgh", k=300))
    rows = [(5, text), (5, text), (None, text), (2, text), (5, "x" + text)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in got)
    assert removed == [(False, 2, 300, 0), (False, 5, 300, 300), (False, 5, 300, 300), (False, 5, 301, 300), (True, 0, 300, 300)]


def test_multikey_order_sorts_and_marks():
    draw = np.random.default_rng(3)
    keys = draw.integers(0, 3, (500, 4)).astype(np.uint64)
    order, fresh = suffixes.multikey_order(keys)
    rows = [tuple(r) for r in keys[order].tolist()]
    assert rows == sorted(rows)
    assert fresh.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(len(rows))]


def sentence(draw, n):
    return " ".join(f"{draw.choice('abcdefgh')}{draw.randint(0, 3000)}" for _ in range(n))


def test_planted_passages_are_found_and_clean_texts_left(spark):
    draw = random.Random(11)
    planted = sentence(draw, 60)
    near = " ".join(w if i != 50 else "changed" for i, w in enumerate(planted.split()))
    rows = [(i, "\n".join(sentence(draw, draw.randint(3, 90)) for _ in range(6))) for i in range(40)]
    rows[7] = (7, rows[7][1] + "\n" + planted)
    rows[12] = (12, sentence(draw, 33) + " " + planted + " " + sentence(draw, 21))
    rows[20] = (20, sentence(draw, 5) + "\n" + near + "\n" + sentence(draw, 30))
    rows += [(50, rows[3][1]), (51, None), (52, ""), (53, "short"), (None, planted)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("mine"))
    found = passages.repeated_passages(docs)
    spans = {r.doc_id: r for r in passages.removed_spans(found).collect()}
    assert set(spans) == {12, 20, 50}
    assert spans[12].kept_doc_ids == [7] and 33 <= spans[12].first_word and spans[12].first_word + spans[12].n_words <= 93
    assert spans[50].kept_doc_ids == [3]
    assert {r.doc_id for r in found.filter("NOT removed").collect()} <= {3, 7, 12, 20}


def test_passages_are_as_similar_as_asked(spark):
    """Every removed paragraph reaches the kept one over verified steps; in pairs, it is one step."""
    draw = random.Random(13)
    base = [sentence(draw, 30) for _ in range(6)]
    rows = [(2 * i + j, " ".join(edited(draw, b.split(), 0.04 * j))) for i, b in enumerate(base) for j in (0, 1)]
    texts = dict(rows)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).filter("removed").collect()
    for row in found:
        assert brute.similar(brute.shingle_set(texts[row.doc_id], 5), brute.shingle_set(texts[row.kept_doc_id], 5), 80)
    alike = {2 * i + 1 for i in range(6) if brute.similar(*(brute.shingle_set(texts[2 * i + j], 5) for j in (0, 1)), 80)}
    assert {r.doc_id for r in found} <= alike and len(found) >= len(alike) - 1


def test_band_recall():
    assert passages.recall(0.8, 2, 1) == pytest.approx(0.96)
    assert links.shingles([b"a", b"b"], 4).tolist() != links.shingles([b"b", b"a"], 4).tolist()

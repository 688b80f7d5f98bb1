"""Token alignment against a plain count over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sparrowline.llm import alignment, bpe, prefixes, queries

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PARTS = ["a", "the", " ", "  ", "\n", "é", "日本", "'s", "12", "!", "ing", "́", "😀", "<s>", "<|endoftext|>", "<0x0A>", "word", "\x1c", "\x00", "ﬁ"]


@pytest.fixture(scope="module")
def files():
    return bpe.load(public_tokenizers.path("byte_bpe_50k.json")), prefixes.load(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def streams(files):
    return alignment.Streams(*files)


def plain_tokens(files):
    """Whole texts through both libraries: lists of (id, bytes)."""
    a, b = Tokenizer.from_str(files[0]), SentencePieceProcessor(model_proto=files[1])
    a.encode_special_tokens = True
    letters = bpe.byte_letters()

    def tokens(text):
        first = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        second = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            second.append((i, bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        return first, second

    return tokens


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(files, rows):
    tokens, seen = plain_tokens(files), []
    for _, text in rows:
        first, second = tokens(text) if text else ([], [])
        whole = b" " + (text or "").encode()
        if not text or any(b"".join(d for _, d in x) != whole for x in (first, second)):
            seen.append(None)
            continue
        a, b = spans(first), spans(second)
        links, low = [], 0
        for i, s, e in a:
            while b[low][2] <= s:
                low += 1
            for j, t, u in b[low:]:
                if t >= e:
                    break
                links.append((i, j))
        groups, ends = [], sorted({e for *_, e in a} & {e for *_, e in b})
        at, bt = 0, 0
        for end in ends:
            x, y = [], []
            while at < len(a) and a[at][2] <= end:
                x.append(str(a[at][0]))
                at += 1
            while bt < len(b) and b[bt][2] <= end:
                y.append(str(b[bt][0]))
                bt += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        seen.append((len(a), len(b), groups, links))
    counts = Counter(pair for x in seen if x for pair in x[3])
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for (doc_id, _), x in zip(rows, seen, strict=True):
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        n_best = sum(counts[p] == best[p[1]] for p in links)
        text = ";".join(groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), n_best, sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r[n] for n in ["doc_id", *NAMES]) for r in frame.collect()), key=str)


def odd_rows():
    draw = random.Random(6)
    rows = [(i, "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "▁ab cd"), (204, "  two"), (205, "x  y   z "), (None, "no id"), (None, None)]
    return rows + [(206, "same text"), (206, "same text"), (207, "a▁b " + "word " * 40)]


def test_odd_texts(spark, files):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumn("part", F.lit("p")).withColumn("row", F.lit(1)).withColumn("n_a", F.lit(2))
    assert got(alignment.align(docs, *files)) == brute(files, rows)


def test_pieces_merged_across_tasks_and_small_parts(spark, files):
    """Pieces of 30 characters, merged two by two, pairs numbered in parts of 50."""
    rows = odd_rows() + [(300, "long words and more of them, " * 300), (301, "日本語" * 400), (302, "x" * 3000 + " y")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert got(alignment.align(docs, *files, piece_chars=30, fan=2, part_links=50)) == brute(files, rows)


def test_an_empty_table_and_other_ids(spark, files):
    empty = spark.createDataFrame([], DOCS)
    assert alignment.align(empty, *files).collect() == []
    named = spark.createDataFrame([("x", "some text")], "key string, body string")
    row = alignment.align(named, *files, doc_id="key", text="body").first()
    assert (row.doc_id, row.n_a) == ("x", 2)


def same(left, right):
    return (
        left.cut == right.cut
        and all(np.array_equal(x, y) for x, y in zip((*left.head, *left.tail), (*right.head, *right.tail), strict=True))
        and b"".join(left.groups) == b"".join(right.groups)
        and left.n_groups == right.n_groups
        and np.array_equal(left.links.pairs, right.links.pairs)
        and np.array_equal(left.links.counts, right.links.counts)
    )


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
def test_fragments_merge_in_any_bracketing(streams, size):
    a, b = next(streams.tokens(["tokenisation of unusual words: 日本語 naïveté 12345 xqzzvw antidisestablishmentarianism " * 6]))
    a_end, b_end = (np.cumsum(n[i]) for n, i in zip(streams.lengths, (a, b), strict=True))
    edges = [0, *range(size, int(a_end[-1]), size), int(a_end[-1])]
    parts = []
    for low, high in zip(edges, edges[1:], strict=False):
        x, y = ((end > low) & (end <= high) for end in (a_end, b_end))
        parts.append(alignment.fragment(streams, a[x], a_end[x], b[y], b_end[y]))
    left = reduce(lambda f, g: alignment.compose(streams, f, g), parts)
    right = reduce(lambda g, f: alignment.compose(streams, f, g), parts[::-1])
    tree, whole = alignment.merge(streams, parts), alignment.fragment(streams, a, a_end, b, b_end)
    assert same(left, right) and same(left, tree) and same(left, whole)


def test_query_against_brute_force(spark, files):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op12_token_alignment(spark, SMALL)) == brute(files, rows)

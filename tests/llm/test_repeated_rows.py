"""Shingle join of rows that repeat under one id in several tasks."""

import random

from sparrowline.llm import shingles
from tests.llm import brute


def test_repeated_rows_do_not_add_up_to_a_link(spark):
    draw = random.Random(31)
    once, again = [], []
    for i in range(120):
        n = draw.randint(20, 200)
        base = [f"g{i}w{j}" for j in range(n)]
        lost = n // 9 + 1
        once.append((2 * i, " ".join(base)))
        again.append((2 * i + 1, " ".join([*base[:-lost], *[f"e{i}w{j}" for j in range(lost)]])))
    rows = [*once, *again, *again, *again, *again]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 10), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.join_shingles(docs, width=4, percent=85).collect()}
    assert got == brute.shingle_classes(rows, 4, 85)

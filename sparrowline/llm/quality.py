"""Quality rules as a bitmask ledger.

``measure`` reads each text once; ``ledger`` evaluates every rule on the
measurements and stores one bit per failed rule; policies are masks over these
bits, so a new policy version, or the question what a rule changes, never reads a
text again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SCHEMA = ", ".join(f"{name} long" for name in MEASURES)
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"

# Rules by bit, lowest first: a name, and when a text fails; ``m`` gives a measurement.
# Bits are never given to another rule, so stored ledgers stay readable.
RULES: tuple[tuple[str, Callable[[Callable[[str], Column]], Column]], ...] = (
    ("too_few_words", lambda m: m("n_words") < 50),
    ("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    ("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    ("duplicate_lines", lambda m: (m("n_dup_lines") >= 3) & (10 * m("n_dup_lines") > 3 * m("n_lines"))),
    ("long_words", lambda m: m("word_chars") > 25 * m("n_words")),
    ("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version's name and the rules it applies."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return reduce(lambda mask, name: mask | BIT[name], self.rules, 0)


BASE = Policy("base", ("too_few_words", "repeated_words"))
V1 = Policy("v1", BASE.rules + ("symbols",))
V2 = Policy("v2", V1.rules + ("duplicate_lines",))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text; all 0 for null."""
    data = (text or "").encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    return (
        len(words),
        len(text or "") - (len(data) - len(data.translate(None, _SPACES))),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measure_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measures(text) for text in texts], columns=list(MEASURES))


def measure(text: Column) -> Column:
    """Struct of ``MEASURES`` of a text, in one pass over the whole of it.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_lines``
    (lines with a word), ``n_dup_lines`` (such lines equal to an earlier one) and
    ``n_repeat_words``. Null counts as an empty text; words are runs of characters
    other than ASCII white space, and are compared as they are.
    """
    return F.pandas_udf(_measure_batches, _SCHEMA)(text)


def failure_bits(measured: str | None = None) -> Column:
    """Bits of the rules that a row fails; ``measured`` names a struct with its measurements."""
    value = lambda name: F.col(f"{measured}.{name}" if measured else name)
    bits = [F.when(fails(value), F.lit(BIT[name])).otherwise(F.lit(0)) for name, fails in RULES]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def ledger(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keys``, the measurements, ``failed_bits``.

    Rows with null keys or texts, and repeated rows, are kept one for one; other
    columns of ``docs`` are not read.
    """
    measured = docs.select(*keys, measure(F.col(text)).alias("_measured")).select(*keys, "_measured.*")
    return measured.withColumn("failed_bits", failure_bits())


def passes(policy: Policy, bits: Column) -> Column:
    """Whether rows with these failure bits pass ``policy``."""
    return bits.bitwiseAND(F.lit(policy.mask)) == 0


def keep_passing(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    measured = docs.withColumn("_quality", measure(F.col(text)))
    return measured.filter(passes(policy, failure_bits("_quality"))).select(*docs.columns)


def ablations(entries: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """What each rule does in each policy, from the stored bits alone.

    Per ``version`` and ``rule``: ``failed`` (rows that fail the rule),
    ``failed_alone`` (rows that would pass without it) and ``kept`` (rows that pass the
    policy). Rows are first counted by bit pattern; there are 2 ** rules at most.
    """
    counted = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    out = []
    for policy in policies:
        hit = F.col("failed_bits").bitwiseAND(F.lit(policy.mask))
        for name in policy.rules:
            bit = F.lit(BIT[name])
            out.append(
                F.struct(
                    F.lit(policy.version).alias("version"),
                    F.lit(name).alias("rule"),
                    F.when(hit.bitwiseAND(bit) != 0, F.col("n")).otherwise(0).alias("failed"),
                    F.when(hit == bit, F.col("n")).otherwise(0).alias("failed_alone"),
                    F.when(hit == 0, F.col("n")).otherwise(0).alias("kept"),
                )
            )
    rows = counted.select(F.inline(F.array(*out)))
    return rows.groupBy("version", "rule").agg(*[F.sum(c).alias(c) for c in ("failed", "failed_alone", "kept")])

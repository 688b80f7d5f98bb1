"""Periodic runs of words, found from seeds and extended along diagonals.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
equal) that is at least ``max(6, 4 * q)`` words long and that no neighbouring word extends.
Words ``q`` apart lie on the diagonal of lag ``q``: a run of ``n`` words is a stretch of
``n - q`` equal pairs there, 5 at least for a lag of 1 and ``3 * q`` for others.

Lags are taken in classes ``2**j <= q < 2**(j + 1)``. Whatever its lag, a run of class
``j`` has a stretch of at least ``k = 5`` (class 0) or ``k = 3 * 2**j`` equal pairs, so the
``k``-grams of the text are the index. Of a ``k``-gram's places only neighbours in the text
are paired: inside a run of smallest period ``q`` no ``k``-gram, which covers 1.5 periods or
more, comes again before ``q`` words. So each class has at most one pair per place, and no
pairs of a frequent gram are made. A pair in its class's lags is extended in both
directions; for each lag, the furthest place covered so far suppresses the pairs inside it.

``k``-grams are numbered exactly, those of a class from the numbers of the class before, and
the classes end where no gram comes twice. Words never leave the task that reads the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.shared import WORD, slices

LEAST_WORDS = 6
LEAST_PERIODS = 4

Run = tuple[int, int, int]

_RUNS = "struct<runs:array<struct<start:long,length:long,period:long>>,n_words:long,collapsed:string>"
_KIND = pa.struct(
    [
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("n_words", pa.int64()),
        ("collapsed", pa.string()),
    ]
)
# Words looked at per step when a pair is extended; steps double.
_STEP = 64


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair; equal pairs, and only they, have equal numbers."""
    if not len(left):
        return left
    _, numbers = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)
    return numbers


def _neighbours(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place of a gram that comes again later, and how far on it does."""
    order = np.argsort(grams, kind="stable")
    again = grams[order[1:]] == grams[order[:-1]]
    return order[:-1][again], (order[1:] - order[:-1])[again]


def _equal_from(words: np.ndarray, place: int, lag: int) -> int:
    """End of the equal pairs that go on from ``place``."""
    step, end = _STEP, len(words) - lag
    while place < end:
        ahead = min(end, place + step)
        unlike = words[place:ahead] != words[place + lag : ahead + lag]
        if unlike.any():
            return place + int(unlike.argmax())
        place, step = ahead, step * 2
    return end


def _equal_since(words: np.ndarray, place: int, lag: int) -> int:
    """Start of the equal pairs that lead up to ``place``, which is not among them."""
    step = _STEP
    while place > 0:
        behind = max(0, place - step)
        unlike = words[behind:place] != words[behind + lag : place + lag]
        if unlike.any():
            return place - int(unlike[::-1].argmax())
        place, step = behind, step * 2
    return 0


def _classes(words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per class of lags: its least lag, the width of its grams, places and lags of its pairs."""
    count = len(words)
    if count < LEAST_WORDS:
        return
    two = _pairs(words[:-1], words[1:])
    three = _pairs(two[:-1], words[2:])
    wide, lag = three, 1
    while True:
        width = 5 if lag == 1 else 3 * lag
        grams = _pairs(three[:-2], three[2:]) if lag == 1 else wide
        places, lags = _neighbours(grams)
        own = (lags >= lag) & (lags < 2 * lag)
        yield lag, width, places[own], lags[own]
        # A gram of the next class holds two of this one, one after the other.
        if 8 * lag > count or not len(places):
            return
        wide = _pairs(wide[: -3 * lag], wide[3 * lag :])
        lag *= 2


def runs_of(words: np.ndarray) -> list[Run]:
    """All runs ``(start, length, period)`` of numbered words, by start, then period."""
    found: list[Run] = []
    for _, width, places, lags in _classes(words):
        covered: dict[int, int] = {}
        by_place = np.argsort(places, kind="stable")
        for place, lag in zip(places[by_place].tolist(), lags[by_place].tolist(), strict=True):
            if place < covered.get(lag, 0):
                continue
            end = _equal_from(words, place + width, lag)
            covered[lag] = end
            start = _equal_since(words, place, lag)
            length = end + lag - start
            if length >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                found.append((start, length, lag))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties: least start, then least period.

    Lengths of a text's words and their products stay below 2^63. Null without runs.
    """
    better = lambda a, b: (  # noqa: E731  b comes later in the order of the runs, so it must be greater
        F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    )
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, better)


def lines_of(runs: Column) -> Column:
    """Every run as a line ``start,length,period``, each ended by a line feed."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")


def _named(run: Run) -> dict[str, int]:
    return {"start": run[0], "length": run[1], "period": run[2]}


def _found(text: str | None) -> tuple[list[Run], int, str]:
    # Words as in ``shared.WORD``; surrogates cannot occur in a Spark string.
    words = (text or "").encode().split()
    numbers = _Numbers()
    numbered = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    runs = runs_of(numbered)
    return runs, len(words), collapse(words, runs).decode()


def find_runs(text: Column) -> Column:
    """``(runs, n_words, collapsed)`` of a text's words: runs of white space do not count.

    ``runs`` are ``(start, length, period)`` in words from 0, by start, then period;
    ``collapsed`` is the text with each run cut down to its first period, its kept words
    joined by one space. Null and empty texts have no words, no runs and ``''``. Equal rows
    give equal results each; nothing is looked up by id, so tables need none. A text is
    worked on whole by the task that reads it, in time ``n log n`` of its words and memory
    in proportion to them, however long it is or how often one word comes in it.
    """

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0):
                rows = [_found(t) for t in part.column(0).to_pylist()]
                named = [{"runs": [_named(r) for r in runs], "n_words": n, "collapsed": c} for runs, n, c in rows]
                parts.append(pa.array(named, _KIND))
            yield pa.concat_arrays(parts) if parts else pa.array([], _KIND)

    return F.arrow_udf(found, _RUNS)(text)


def repeat_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Put a periodic tail at the end of about one document in ten, chosen by its id.

    With ``h`` the crc32 of the id in decimal, ``g = floor(h / 10)`` and ``n`` words, a
    document with ``h % 10 = 0`` and words has word ``i >= a = g % n`` replaced by word
    ``a + (i - a) % p``, ``p = 1 + floor((n - a) / (3 + g % 8))``; its words are then joined
    by one space. Other documents, and those without an id, keep their text. This makes
    known repeats to find, as planted rows in a test of a corpus do.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))
    n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    # Bound once by a struct in an array, or Spark would cut the text anew for every word.
    parts = F.array(F.struct(words.alias("w"), a.alias("a"), p.alias("p")))
    tail = lambda s: F.transform(
        s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int")))
    )
    edited = F.array_join(F.get(F.transform(parts, tail), 0), " ")
    chosen = (h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]")
    return docs.withColumn(text, F.when(chosen, edited).otherwise(F.col(text)))

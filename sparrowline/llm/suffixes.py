"""Exact removal of repeated byte strings, by sorting the suffixes that may repeat.

A string of ``length`` bytes holds ``length - _GRAM + 1`` grams of ``_GRAM`` bytes, and the
one whose hash is least is its anchor: equal strings have equal anchors, wherever
they are. Strings that start side by side mostly share an anchor and make a run, so
a text is a few dozen times fewer runs than bytes. Only runs whose anchor is found in
other runs as well can hold a repeat:

1. Runs are dealt by anchor. A run that equals an earlier one, whole, is gone; the
   first of its kind is open if its anchor also starts other runs.
2. The suffixes of open runs, from their anchors on, are range-partitioned by their
   leading bytes, with splitters that Spark samples. Each bucket sorts the strings
   of its runs by multikey quicksort, eight bytes a key, and equal neighbours after
   the first go. Equal leading bytes never lie in two buckets, so nothing is left to
   compare across their boundaries.
3. An anchor that very many different runs share would make one bucket as large as
   they are. Its runs are cut up first: into single strings, which are partitioned by
   all of their bytes, after equal ones of one task have been reduced to the first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowline.llm.links import mix
from sparrowline.llm.shared import batch_of
from sparrowline.session import materialise

_GRAM = 50
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 16
_HELD = 1 << 21
_STRINGS = 1 << 17
_OUT = 1 << 16
_MANY = 8

_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int) -> np.ndarray:
    out = np.empty(_BLOCK, np.uint64)
    out[0], done = 1, 1
    while done < _BLOCK:
        step = min(done, _BLOCK - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every window of ``width`` bytes, one per start.

    Texts are hashed block by block, so memory is a few times the text and the tables
    of powers are of one block's length.
    """
    step = _BLOCK - width
    out = []
    for at in range(0, max(len(data) - width + 1, 0), step):
        part = _LETTERS[data[at : at + step + width - 1]] * _UP[: min(step + width - 1, len(data) - at)]
        sums = np.append(np.uint64(0), np.cumsum(part, dtype=np.uint64))
        out.append(mix((sums[width:] - sums[:-width]) * _DOWN[: len(part) - width + 1]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def anchors(hashes: np.ndarray, wide: int) -> np.ndarray:
    """For every ``wide`` neighbours: the place of the least, the first of equal ones."""
    value, place, step = hashes, np.arange(len(hashes)), 1
    while step < wide:
        shift = min(step, wide - step)
        less = value[shift:] < value[:-shift]
        place = np.where(less, place[shift:], place[:-shift])
        value = np.where(less, value[shift:], value[:-shift])
        step += shift
    return place


def runs(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts that share an anchor: its hash, the run's, first start,
    count, and how far the anchor lies behind the first start."""
    if len(data) < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    codes = np.frombuffer(data, np.uint8)
    grams = window_hashes(codes, _GRAM)
    place = anchors(grams, length - _GRAM + 1)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    counts = np.diff(np.append(starts, len(place)))
    # A run is as long as its count says, so its first and last string tell it whole.
    strings = window_hashes(codes, length)
    run = mix(strings[starts] + mix(strings[starts + counts - 1]) + counts.astype(np.uint64))
    return grams[place[starts]], run, starts, counts, place[starts] - starts


# States of a run: gone (equal to an earlier one), open, open under a crowded anchor;
# and, between tasks only, the mark of a crowded anchor.
_GONE, _OPEN, _CROWDED, _MARK = 0, 1, 2, 3
_ENTRY = "deal long, anchor long, run long, doc long, start long, count int, lead int, state int"
_ENTRY_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("deal", "anchor", "run", "doc", "start")] + [(n, pa.int32()) for n in ("count", "lead", "state")]
)


def _rows(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    types = [np.int64] * 5 + [np.int32] * 3
    for at in range(0, len(columns[0]), _OUT):
        cut = [c[at : at + _OUT] for c in columns]
        cut = [c.view(np.int64) if c.dtype == np.uint64 else c.astype(t) for c, t in zip(cut, types, strict=True)]
        yield batch_of(_ENTRY_ARROW, [pa.array(c) for c in cut])


def _reduce_local(anchor, run, doc, start, count, lead) -> Iterator[pa.RecordBatch]:
    """First runs of each kind, dealt by anchor; equal later ones are gone already."""
    order = np.lexsort((start, doc, run, anchor))
    anchor, run, doc, start, count, lead = (c[order] for c in (anchor, run, doc, start, count, lead))
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    first = new_anchor | np.append(True, run[1:] != run[:-1])
    group = np.cumsum(new_anchor) - 1
    kinds = np.bincount(group, weights=first).astype(np.int64)
    crowded = kinds[group] >= _MANY
    state = np.where(first, np.where(crowded, _CROWDED, _OPEN), _GONE)
    deal = np.where(state == _OPEN, anchor, mix(anchor + mix(run + doc.astype(np.uint64) * (state == _GONE))))
    yield from _rows([deal, anchor, run, doc, start, count, lead, state])
    marks = np.flatnonzero(new_anchor & crowded)
    if len(marks):
        zero = np.zeros(len(marks), np.int64)
        yield from _rows([anchor[marks], anchor[marks], *[zero] * 5, np.full(len(marks), _MARK)])


def _entries(docs: DataFrame, length: int) -> DataFrame:
    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                anchor, run, start, count, lead = runs(text.as_py(), length)
                if len(start):
                    held.append((anchor, run, np.full(len(start), doc, np.int64), start, count, lead))
                    size += len(start)
                if size >= _HELD:
                    yield from _reduce_local(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from _reduce_local(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return docs.select("doc", "text").mapInArrow(run_task, _ENTRY)


def _settle(columns: list[np.ndarray]) -> list[np.ndarray]:
    """States of whole groups of one anchor, sorted by anchor, run, doc, start."""
    deal, anchor, run, doc, start, count, lead, state = columns
    live = (state == _OPEN) | (state == _CROWDED)
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    group = np.cumsum(new_anchor) - 1
    at = np.flatnonzero(live)
    first = np.append(True, (anchor[at][1:] != anchor[at][:-1]) | (run[at][1:] != run[at][:-1])) if len(at) else live[:0]
    kinds = np.bincount(group[at], weights=first, minlength=group[-1] + 1)
    full = np.bincount(group, weights=state >= _CROWDED, minlength=group[-1] + 1) > 0
    out = state.copy()
    out[at] = np.where(first, np.where(full[group[at]], _CROWDED, np.where(kinds[group[at]] > 1, _OPEN, _MARK)), _GONE)
    return [c[out != _MARK] for c in (deal, anchor, run, doc, start, count, lead, out)]


def _settle_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if held:
            columns = [np.append(a, b) for a, b in zip(held, columns, strict=True)]
        # The last group may go on in the next batch.
        end = np.searchsorted(columns[1], columns[1][-1]) if len(columns[1]) else 0
        held = [c[end:] for c in columns]
        if end:
            yield from _rows(_settle([c[:end] for c in columns]))
    if held and len(held[0]):
        yield from _rows(_settle(held))


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """``doc``, ``start``, ``count``, ``state`` of the runs that are gone or open.

    Rows that are finished, and those of crowded anchors, are dealt by themselves, so
    that no task gets more than a few rows of one anchor from each other task.
    """
    dealt = _entries(docs, length).repartition("deal").sortWithinPartitions("anchor", "run", "doc", "start")
    return dealt.mapInArrow(_settle_task, _ENTRY).select("doc", "start", "count", "lead", "state")


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix, and which sorted rows differ from the one before.

    Sorts by one column at a time, and by the next one only rows that are still equal.
    """
    order = np.arange(len(keys))
    fresh = np.zeros(len(keys), bool)
    fresh[:1] = True
    for column in range(keys.shape[1]):
        group = np.cumsum(fresh)
        alone = fresh & np.append(fresh[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        values, member = keys[order[at], column], group[at]
        again = np.lexsort((values, member))
        order[at] = order[at][again]
        values, member = values[again], member[again]
        fresh[at[1:]] |= (member[1:] == member[:-1]) & (values[1:] != values[:-1])
    return order, fresh


def later_copies(strings: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows of a byte matrix equal another row of a lesser (doc, start)."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    before = np.lexsort((start, doc))
    order, fresh = multikey_order(padded[before].view(">u8").astype(np.uint64))
    later = np.zeros(n, bool)
    later[before[order]] = ~fresh
    return later


def _strings(texts: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """All strings of runs as a byte matrix, the run each belongs to, and its place there."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])[:-1]
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.lib.stride_tricks.sliding_window_view(joined, length)[offsets[owner] + inside], owner, inside


_SUFFIX = "lead binary, doc long, start long, count int, text binary"
_SUFFIX_ARROW = pa.schema(
    [("lead", pa.binary()), ("doc", pa.int64()), ("start", pa.int64()), ("count", pa.int32()), ("text", pa.binary())]
)
_SPAN = "doc long, start long, count int"
_SPAN_ARROW = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("count", pa.int32())])


def _open_suffixes(texts: DataFrame, length: int) -> DataFrame:
    """Rows to sort, by ``lead``; a null text marks a string that is already known to be a copy."""

    def crowd(rows: list) -> Iterator[pa.RecordBatch]:
        doc, start, count, text = zip(*rows, strict=True)
        matrix, owner, inside = _strings(list(text), np.array(count), length)
        docs, starts = np.array(doc)[owner], np.array(start)[owner] + inside
        later = later_copies(matrix, docs, starts)
        for at in range(0, len(owner), _OUT):
            cut = slice(at, at + _OUT)
            texts = [None if known else row.tobytes() for row, known in zip(matrix[cut], later[cut], strict=True)]
            # A known copy only passes through; bytes of its place spread such rows.
            leads = [x or int(d * 31 + s).to_bytes(8, "little", signed=True) for x, d, s in zip(texts, docs[cut], starts[cut], strict=True)]
            yield batch_of(_SUFFIX_ARROW, [leads, docs[cut], starts[cut], np.ones(len(texts), np.int32), texts])

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded, size = [], 0
        for batch in batches:
            out = []
            for doc, packed, held in zip(*(batch.column(c).to_pylist() for c in ("doc", "packed", "runs")), strict=True):
                data = zlib.decompress(packed)
                for run in held:
                    text = data[run["start"] : run["start"] + run["count"] + length - 1]
                    if run["state"] == _CROWDED:
                        crowded.append((doc, run["start"], run["count"], text))
                        size += run["count"]
                    elif run["state"] == _OPEN:
                        out.append((text[run["lead"] : run["lead"] + _GRAM], doc, run["start"], run["count"], text))
            if out:
                yield batch_of(_SUFFIX_ARROW, list(zip(*out, strict=True)))
            if size > _STRINGS:
                yield from crowd(crowded)
                crowded, size = [], 0
        if crowded:
            yield from crowd(crowded)

    return texts.select("doc", "packed", "runs").mapInArrow(run_task, _SUFFIX)


def _sort_buckets(suffixes: DataFrame, length: int) -> DataFrame:
    """Spans of string starts (``doc``, ``start``, ``count``) that are later copies."""

    def spans(rows: list) -> Iterator[pa.RecordBatch]:
        known = [(d, s, c) for _, d, s, c, text in rows if text is None]
        if known:
            yield batch_of(_SPAN_ARROW, list(zip(*known, strict=True)))
        rows = [row for row in rows if row[4] is not None]
        if not rows:
            return
        _, doc, start, count, text = zip(*rows, strict=True)
        matrix, owner, inside = _strings(list(text), np.array(count), length)
        docs, starts = np.array(doc)[owner], np.array(start)[owner] + inside
        at = np.flatnonzero(later_copies(matrix, docs, starts))
        if len(at):
            begin = np.append(True, (owner[at][1:] != owner[at][:-1]) | (at[1:] != at[:-1] + 1))
            sizes = np.diff(np.append(np.flatnonzero(begin), len(at)))
            yield batch_of(_SPAN_ARROW, [docs[at][begin], starts[at][begin], sizes.astype(np.int32)])

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, strings = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if strings >= _STRINGS and row[0] != held[-1][0]:
                    yield from spans(held)
                    held, strings = [], 0
                held.append(row)
                strings += row[3]
        if held:
            yield from spans(held)

    buckets = suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = suffixes.repartitionByRange(int(buckets), "lead").sortWithinPartitions("lead")
    return ranged.mapInArrow(run_task, _SPAN)


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (id, text) rows with ``doc``, a number in the order of ids, nulls last."""
    docs = docs.select(F.col(key).cast("long").alias("_id"), text_bytes(text).alias("text"))
    docs = docs.withColumn("_digest", F.xxhash64("text"))
    counted = docs.select("_id").groupBy("_id").agg(F.count("*").alias("n"))
    most, last, nulls = counted.agg(F.max("n"), F.max("_id"), F.count(F.when(F.col("_id").isNull(), 1))).first()
    if (most or 1) == 1 and not nulls:
        return docs.withColumn("doc", F.col("_id"))
    place = F.row_number().over(Window.partitionBy("_id").orderBy("_digest")) - 1
    places = docs.select("_id", "_digest").distinct().withColumn("_place", place)
    number = F.coalesce("_id", F.lit((last if last is not None else 0) + 1)) * F.lit(int(most)) + F.col("_place")
    places = places.select(F.col("_id").alias("_i"), F.col("_digest").alias("_d"), number.alias("doc"))
    places = materialise(places, "suffix-places")
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d"))
    return docs.join(places, same).drop("_i", "_d").dropDuplicates(["doc"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("_id", pa.int64()), ("_digest", pa.int64()), ("packed", pa.binary())])
    for batch in batches:
        packed = [zlib.compress(t.as_py(), 1) for t in batch.column("text")]
        yield batch_of(schema, [*(batch.column(c) for c in ("doc", "_id", "_digest")), packed])


def _cut(length: int):
    """Per document: what is left without the strings that start in its spans."""
    schema = pa.schema(
        [("_id", pa.int64()), ("_digest", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())]
    )

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows = (batch.column(c).to_pylist() for c in ("_id", "_digest", "packed", "spans"))
            for key, digest, packed, spans in zip(*rows, strict=True):
                data = zlib.decompress(packed)
                parts, borders, end = [], [], 0
                for start, stop in sorted((s["start"], s["start"] + s["count"] + length - 1) for s in spans):
                    if borders and start <= end:
                        borders[-1] = end = max(end, stop)
                        continue
                    parts.append(data[end:start])
                    borders += [start, stop]
                    end = stop
                parts.append(data[end:])
                kept = b"".join(parts)
                out.append((key, digest, len(data) - len(kept), borders, kept))
            if out:
                yield batch_of(schema, list(zip(*out, strict=True)))

    return run_task


def changed_documents(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = 100) -> DataFrame:
    """Documents that lose bytes: ``_id``, ``_digest`` (of the text), ``n_removed``, ``spans``, ``kept``.

    See ``remove_repeats``. Texts move once, compressed, to those of their runs that
    repeat; documents without such runs stay where they are.
    """
    if length <= _GRAM:
        raise ValueError(f"need a length over {_GRAM}")
    docs = _numbered(docs, key, text)
    found = materialise(repeated_runs(docs, length), "suffix-runs")
    per_doc = found.groupBy("doc").agg(F.collect_list(F.struct("start", "count", "lead", "state")).alias("runs"))
    packed = docs.select("doc", "_id", "_digest", "text")
    packed = packed.mapInArrow(_pack, "doc long, _id long, _digest long, packed binary")
    texts = materialise(packed.join(per_doc, "doc"), "suffix-texts")
    # Written first: the range partitioning reads its input twice, to sample splitters and to deal.
    suffixes = materialise(_open_suffixes(texts, length), "suffix-open")
    copies = materialise(_sort_buckets(suffixes, length), "suffix-copies")
    gone = found.filter(F.col("state") == _GONE).select("doc", "start", "count").unionByName(copies)
    spans = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    cut = texts.drop("runs").join(spans, "doc")
    cut = cut.mapInArrow(_cut(length), "_id long, _digest long, n_removed long, spans array<long>, kept binary")
    return materialise(cut, "suffix-cut")


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = 100) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``spans`` and ``kept``.

    A byte goes if one of the ``length``-byte strings that cover it also starts at an
    earlier place: in a document of lesser id, or further left in its own. Texts are
    UTF-8 bytes and strings are judged on the input. ``spans`` holds the borders of the
    removed parts (start, end, start, ...), ``kept`` the other bytes (binary: cut inside a
    character, they need not be UTF-8).

    A null text is empty; null ids come last. Rows repeated with the same text are one
    document and come out alike; different texts under one id follow each other in
    the order of their hashes. An empty table gives an empty one. Columns of ``docs``
    named like an output column are replaced.
    """
    passed = [name for name in docs.columns if name not in ("n_bytes", "n_removed", "spans", "kept")]
    cut = changed_documents(docs, text=text, key=key, length=length)
    return with_changes(docs.select(*passed, text_bytes(text).alias("_bytes"), text_digest(text).alias("_of")), cut, key).select(
        *passed,
        F.octet_length("_bytes").cast("long").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<long>")).alias("spans"),
        F.coalesce("kept", "_bytes").alias("kept"),
    )


def text_bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def text_digest(text: str) -> Column:
    return F.xxhash64(text_bytes(text))


def with_changes(rows: DataFrame, cut: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows``, with the digest of their text in ``_of``, next to what ``changed_documents`` says of them."""
    return rows.join(cut, rows[key].eqNullSafe(cut["_id"]) & (rows["_of"] == cut["_digest"]), "left").drop("_id", "_digest")

"""Exact n-gram Jaccard join by vertical partitioning.

The global order of shingles (by hash) is cut into fragments, finer for longer
documents: into more fragments than two similar documents can have shingles that
only one of them holds. So every similar pair agrees, wholly, on at least one
fragment, and only documents that agree on a fragment meet. Each agreement is a
partial overlap of the fragment's size; their sum per pair proves most links at
once, and the other pairs are verified on their whole sets.

Documents that agree on a fragment meet as a star (see ``stars``), not as pairs.
That finds every link that matters for classes: where all members of a fragment end
up in one class, no other pair of them can change it; where they do not, all members of
different classes that may be similar are brought together, and verified where they meet.

Whether two sets may be similar is told by their sketches: a few bits of each half
fragment, which differ in no more places than the sets differ in shingles.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.components import connected_components
from sparrowline.llm.links import class_links, dealt, mix, shingles, words
from sparrowline.llm.shared import batch_of, release_memory
from sparrowline.llm.stars import SCHEMA, LocalStars, meet
from sparrowline.session import materialise

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LONGEST = 1 << 32
# The lowest bits of a fragment's key give its level.
_LEVEL_BITS = np.uint64(6)
# Of two sketches' bytes, how many of the two half fragments differ.
_DIFFER = np.array([(x > 15) + (x & 15 > 0) for x in range(256)], np.uint8)
# Members of a key, outside its largest component, that a task holds at once.
_HUBS = 2048
# Keys of so many members are paired off, as one pair shares many keys.
_FEW = 12


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, whatever the order of ``values``."""
    sums = np.array([mix(values).sum(dtype=np.uint64), mix(values ^ _ODD).sum(dtype=np.uint64)])
    return tuple(sums.view(np.int64).tolist())


class Fragments:
    """How documents of a size cut the order of shingles, for a threshold in percent.

    Sizes fall into levels. A document is cut as its own level says, and also as the
    one below says if it is small enough to be similar to a document there.
    """

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("need a similarity of 50 to 100 percent")
        self.percent, self.starts, self.counts, self.apart = percent, [1], [], []
        step = max(1.5, 100 / percent)
        while self.starts[-1] < _LONGEST:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * step)))
            top = self.starts[-1] - 1
            most = top + max(top, top * 100 // percent)
            # |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|) for similar sets x, y.
            self.apart.append((100 - percent) * most // (100 + percent))
            self.counts.append(self.apart[-1] * 107 // 100 + (2 if self.apart[-1] else 1))
        assert len(self.counts) < 1 << int(_LEVEL_BITS)

    def levels(self, size: int) -> list[int]:
        own = bisect_right(self.starts, size) - 1
        return [own - 1, own] if own and self.percent * size <= 100 * (self.starts[own] - 1) else [own]

    def level(self, size: Column) -> Column:
        """The own level of documents of a size."""
        return F.size(F.filter(F.array(*map(F.lit, self.starts)), lambda start: start <= size)) - 1

    def apart_at_most(self, a: int, b: int) -> int:
        """How many shingles two similar sets of these sizes can have that only one of them holds."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def sketch(self, values: np.ndarray) -> bytes:
        """Four bits of each half fragment of a sorted set, level by level."""
        mixed, out = mix(values ^ np.uint64(0x2545F4914F6CDD1D)), [np.zeros(0, np.uint8)]
        for level in self.levels(len(values)) if len(values) else ():
            halves = 2 * self.counts[level]
            place = (values >> np.uint64(32)) * np.uint64(halves) >> np.uint64(32)
            starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            held = np.zeros(halves, np.uint8)
            held[place[starts].astype(np.int64)] = mix(np.add.reduceat(mixed, starts)) >> np.uint64(60)
            out.append(held[::2] << 4 | held[1::2])
        return np.concatenate(out).tobytes()

    def may_be_similar(self, size_a: int, sketch_a: bytes, size_b: int, sketch_b: bytes) -> bool:
        """False only for sets that are not similar."""
        if size_a > size_b:
            size_a, sketch_a, size_b, sketch_b = size_b, sketch_b, size_a, sketch_a
        level, levels = self.levels(size_a)[-1], self.levels(size_b)
        if level not in levels:
            return False
        a = np.frombuffer(sketch_a, np.uint8)[-self.counts[level] :]
        b = np.frombuffer(sketch_b, np.uint8)
        b = b[-self.counts[level] :] if level == levels[-1] else b[: self.counts[level]]
        return int(_DIFFER[a ^ b].sum()) <= self.apart_at_most(size_a, size_b)

    def keys(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the fragments of a sorted set, and how many shingles each holds.

        Empty fragments count only where a set has too few others to be sure that
        one of those agrees.
        """
        keys, sizes = [], []
        mixed = mix(values ^ np.uint64(0x5851F42D4C957F2D))
        for level in self.levels(len(values)):
            count = self.counts[level]
            place = (values >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
            starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            held = place[starts]
            content = np.add.reduceat(mixed, starts)
            size = np.diff(np.append(starts, len(values)))
            if len(starts) <= self.apart[level]:
                empty = np.setdiff1d(np.arange(count, dtype=np.uint64), held)
                held = np.append(held, empty)
                content = np.append(content, np.zeros(len(empty), np.uint64))
                size = np.append(size, np.zeros(len(empty), np.int64))
            key = mix(mix(content + _ODD) ^ held)
            keys.append(key >> _LEVEL_BITS << _LEVEL_BITS | np.uint64(level))
            sizes.append(size)
        return np.concatenate(keys), np.concatenate(sizes)


_PROFILE = "doc_id long, n_shingles long, digest_a long, digest_b long, sketch binary"
_PROFILE_ARROW = pa.schema(
    [(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in _PROFILE.split(", ")]
)


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the size, the digest and the sketch of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragments = Fragments(percent)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                values = np.unique(shingles(words(text.as_py()), width))
                rows.append((len(values), *digest(values), fragments.sketch(values)))
            yield batch_of(_PROFILE_ARROW, [batch.column("doc_id"), *(zip(*rows, strict=True) if rows else [[]] * 4)])
        release_memory()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, _PROFILE)


def agreements(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Stars of documents that agree on a fragment; ``size`` is the partial overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragments, stars = Fragments(percent), LocalStars()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                values = np.unique(shingles(words(text.as_py()), width))
                if len(values):
                    keys, sizes = fragments.keys(values)
                    stars.add(keys, doc, 0, sizes)
                    if stars.full():
                        yield from stars.flush()
        yield from stars.flush()
        release_memory()

    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    return meet(texts.mapInArrow(run, SCHEMA))


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _thinned(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of documents, those that may be similar by the ``sketches`` of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragments = Fragments(percent)
        for batch in batches:
            kept = [fragments.may_be_similar(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield batch_of(_PAIR, batch.filter(pa.array(kept, pa.bool_())).columns[:2])
        release_memory()

    a, b = (
        sketches.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        for c in ("a", "b")
    )
    met = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
    return met.mapInArrow(run, "a long, b long").distinct()


_MEMBER = ("key", "place", "class", "component", "n", "own", "cells")


def _tied(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the members of a key, of different components, that may be similar.

    Of such pairs those that the others do not connect, so no more than a key's members and hubs. A key
    decides only for pairs the smaller of which has its level.
    """
    fragments = Fragments(percent)
    level = F.col("key").bitwiseAND(F.lit((1 << int(_LEVEL_BITS)) - 1)).cast("int")
    # Of a key's two members the star's pair is known already.
    few = members.filter(F.col("n_members").between(3, _FEW)).select("key", "class", "n_shingles", "component")
    pairs = few.join(few.select("key", *[F.col(c).alias(f"_{c}") for c in few.columns[1:]]), "key")
    less, more = F.least("n_shingles", "_n_shingles"), F.greatest("n_shingles", "_n_shingles")
    may = (F.col("class") < F.col("_class")) & (F.col("component") != F.col("_component")) & (100 * less >= percent * more)
    pairs = pairs.filter(may & (level == fragments.level(less))).select(F.col("class").alias("a"), F.col("_class").alias("b"))
    pairs = _thinned(materialise(pairs.distinct(), "shingle-few"), sketches, percent)
    members = members.filter(F.col("n_members") > _FEW)
    own = fragments.level(F.col("n"))
    count = lambda level: F.element_at(F.array(*map(F.lit, fragments.counts)), level + 1)
    below = (own == level + 1) & (F.length("sketch") > count(own))
    cells = F.when(own == level, F.substring("sketch", -count(level), count(level))).when(
        below, F.substring("sketch", F.lit(1), count(level))
    )
    of = sketches.select(F.col("doc_id").alias("class"), F.col("n_shingles").alias("n"), "sketch")
    members = members.select("key", "class", "component", "outside", "n_outside").distinct()
    met = members.join(of, "class").select("*", cells.alias("cells"), (own == level).alias("own")).filter("cells IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs, table = None, [], None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in _MEMBER), strict=True):
                key, place, doc, component, n, first, cells = row
                if group != (key, place >> 1):
                    group, hubs, table = (key, place >> 1), [], None
                if not place & 1:
                    hubs.append((doc, component, n, first, np.frombuffer(cells, np.uint8)))
                    continue
                if not hubs:
                    continue
                if table is None:
                    docs, components, sizes, firsts, held = zip(*hubs, strict=True)
                    components, sizes, firsts, held = map(np.array, (components, sizes, firsts, held))
                    table, root = held, np.arange(len(hubs))
                differ = _DIFFER[table ^ np.frombuffer(cells, np.uint8)].sum(axis=1)
                near = (differ <= fragments.apart_at_most(n, sizes)) & (components != component) & (firsts | first)
                roots, at = np.unique(root[near], return_index=True)
                if len(roots):
                    out.extend((docs[i], doc) for i in np.flatnonzero(near)[at].tolist())
                    root[np.isin(root, roots)] = roots[0]
            if out:
                yield batch_of(_PAIR, list(zip(*out, strict=True)))
        release_memory()

    met = dealt(met, F.ceil(F.col("n_outside") / _HUBS)).select(*_MEMBER)
    return pairs.union(met.mapInArrow(run, "a long, b long")).distinct()


_PACKED = pa.schema([("doc", pa.int64()), ("packed", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [zlib.compress(text.as_py() or b"", 1) for text in batch.column("text")]
        yield batch_of(_PACKED, [batch.column("doc_id"), packed])
    release_memory()


def _texts_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``doc``, ``packed``: the texts of the documents ``asked`` for, compressed before they move."""
    asked = materialise(asked, "links-open")
    packed = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_pack, "doc long, packed binary")
    return materialise(packed.join(asked, "doc", "left_semi"), "links-texts")


def join_shingles(docs: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a
    document's set holds its distinct runs of ``width`` words, or its whole sequence of
    words if they are fewer. Documents link when 100 * intersection >= ``percent`` *
    union, and ``component_id`` is the least id that links lead to.

    A document without words (null or empty text) has no shingles and no links. A row
    with a null id links with nothing and has a null component. Rows repeated under
    one id are one document, linked by any of its texts. Other columns of ``docs`` are
    not read; an empty table gives an empty one.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = materialise(profiles(docs, width, percent), "shingle-profiles")
    same = ["n_shingles", "digest_a", "digest_b"]
    known = seen.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sketches, known = known.select("doc_id", "n_shingles", "sketch"), known.drop("sketch")
    first = materialise(known.groupBy(*same).agg(F.min("doc_id").alias("_first")), "shingle-first")
    known = materialise(known.join(first, same).withColumnRenamed("_first", "class"), "shingle-known")
    stars = materialise(agreements(docs, width, percent), "shingle-stars")
    level = F.col("key").bitwiseAND(F.lit((1 << int(_LEVEL_BITS)) - 1))
    sums = stars.groupBy("doc", "leader_doc", level.alias("level")).agg(F.sum("size").alias("overlap"))
    sums = sums.groupBy("doc", "leader_doc").agg(F.max("overlap").alias("overlap"))
    # Partial overlaps of several rows of an id would add up: its pairs are verified.
    several = known.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc_id")
    several = materialise(several, "shingle-several")
    for of in ("doc", "leader_doc"):
        again = several.select(F.col("doc_id").alias(of), F.lit(0).alias("_none"))
        sums = sums.join(again, of, "left").withColumn("overlap", F.coalesce("_none", "overlap")).drop("_none")
    fetch = lambda asked: _texts_of(docs, asked)
    thin = lambda pairs: _thinned(pairs, sketches, percent)
    tie = lambda members: _tied(members, sketches, percent)
    links = class_links(stars, known, fetch, width=width, percent=percent, overlaps=sums, thin=thin, tie=tie)
    copies = known.filter("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    found = materialise(connected_components(links.union(copies)), "shingle-components")
    return seen.join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )

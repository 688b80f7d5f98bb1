"""Links between similar word sets, from stars of items that may be similar.

An item is anything with an id and words: a document or a passage of one. Most pairs
of a star are settled by what is known of them already; the others are verified on
their whole sets, and only where that leaves the members of a key in several
components do other pairs than the star's come into play.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from sparrowline.llm.components import connected_components
from sparrowline.llm.shared import batch_of, release_memory, slices
from sparrowline.session import materialise

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_HELD = pa.schema([("class", pa.int64()), ("value", pa.int64())])
_MET = ("doc", "packed", "hub", "turn")
_SHARE = 256
# Shingles of hubs that a task holds at once.
_SHINGLES = 1 << 17
_OUT = 1 << 17
# Packed texts turned into Python values at once.
_TEXT_BYTES = 2 << 20
# Packed texts whose words are held at once.
_SET_BYTES = 1 << 19
# The members of a key with more outside its largest component are first thinned out by what its members hold alone.
_FEW = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: bytes | None) -> list[bytes]:
    """Words of a text's UTF-8 bytes, A-Z lower-cased."""
    return (data or b"").lower().split()


def shingles(found: list[bytes], width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` words; one for all words if there are fewer."""
    n = len(found)
    hashes = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, n)
    if 0 < n < width:
        hashes, width = np.append(hashes, np.uint64(n)), n + 1
    if n == 0:
        return hashes
    out = hashes[: len(hashes) - width + 1]
    for shift in range(1, width):
        out = mix(out * _ODD + hashes[shift : len(hashes) - width + 1 + shift])
    return out


def _sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of compressed texts, one text behind the other, and how many each has; they may repeat."""
    found = [words(zlib.decompress(text)) for text in texts]
    n = np.array([len(f) for f in found], np.int64)
    counts = np.where(n < width, np.minimum(n, 1), n - width + 1)
    values = np.zeros(counts.sum(), np.uint64)
    begins = np.cumsum(counts) - counts
    if (n >= width).any():
        every = shingles(list(chain.from_iterable(found)), width)
        whole = np.flatnonzero(n >= width)
        starts = (np.cumsum(n) - n)[whole]
        ramp = np.arange(counts[whole].sum()) - np.repeat(np.cumsum(counts[whole]) - counts[whole], counts[whole])
        values[np.repeat(begins[whole], counts[whole]) + ramp] = every[np.repeat(starts, counts[whole]) + ramp]
    for i in np.flatnonzero((n > 0) & (n < width)).tolist():
        values[begins[i]] = shingles(found[i], width)[0]
    return values, counts


def _similar(
    texts: list[bytes], hubs: list[int], of_hub: dict[int, list[bytes]], width: int, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts, each with its hub, which are similar to a text of their hub, and the overlap."""
    places, overlaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    turn = 0
    while texts and (now := {hub: i for i, hub in enumerate(h for h, t in of_hub.items() if len(t) > turn)}):
        mine = np.array([i for i, hub in enumerate(hubs) if hub in now], np.int64)
        values, counts = _sets([*(of_hub[hub][turn] for hub in now), *(texts[i] for i in mine.tolist())], width)
        # Shingles by number, with the text's, and then the hub's, in the upper bits: exact, however many texts.
        ranks = np.unique(values, return_inverse=True)[1]
        held = np.unique(np.repeat(np.arange(len(counts)), counts) << 32 | ranks)
        row, rank = held >> 32, held & 0xFFFFFFFF
        sizes, cut = np.bincount(row, minlength=len(counts)), np.searchsorted(row, len(now))
        hub_of = np.array([now[hubs[i]] for i in mine.tolist()], np.int64)
        known, asked, at = held[:cut], hub_of[row[cut:] - len(now)] << 32 | rank[cut:], row[cut:] - len(now)
        there = np.searchsorted(known, asked)
        there = known[np.minimum(there, max(0, len(known) - 1))] == asked if len(known) else np.zeros(len(asked), bool)
        overlap = np.bincount(at[there], minlength=len(mine))
        both = sizes[len(now) :] + sizes[: len(now)][hub_of] - overlap if len(mine) else np.zeros(0, np.int64)
        found = np.flatnonzero(100 * overlap >= percent * both)
        places.append(mine[found])
        overlaps.append(overlap[found])
        turn += 1
    return np.concatenate(places), np.concatenate(overlaps)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sets are similar: ``a``, ``b``, ``overlap``.

    The documents to be compared with one b come together, b first, a few hundred to a
    task: b goes to as many of these shares as it needs.
    """
    pairs = materialise(pairs, "links-pairs")
    if pairs.isEmpty():
        return pairs.withColumn("overlap", F.lit(0).cast("long"))
    shares = F.ceil(F.count("*") / _SHARE).alias("shares")
    shares = materialise(pairs.groupBy("b").agg(shares), "links-shares")
    share = F.pmod(F.xxhash64("a"), F.col("shares")).alias("share")
    asked = pairs.join(shares, "b").select(F.col("a").alias("doc"), F.col("b").alias("hub"), share, F.lit(1).alias("turn"))
    hubs = asked.select(F.col("hub").alias("doc"), "hub", "share", F.lit(0).alias("turn")).distinct()
    asked = materialise(asked.union(hubs), "links-asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of_hub = None, []
        for batch in chain.from_iterable(slices(batch, _MET.index("packed"), _SET_BYTES) for batch in batches):
            docs, texts, hubs, turns = (batch.column(c).to_pylist() for c in _MET)
            # The texts of a hub come first, and stand for those of its members that come in later batches.
            held = {hub: of_hub}
            for text, this, turn in zip(texts, hubs, turns, strict=True):
                of_this = held.setdefault(this, [])
                if turn == 0 and text not in of_this:
                    of_this.append(text)
            hub, of_hub = hubs[-1], held[hubs[-1]]
            others = [i for i, turn in enumerate(turns) if turn]
            out = _similar([texts[i] for i in others], [hubs[i] for i in others], held, width, percent)
            if len(out[0]):
                docs, hubs = np.array(docs)[others][out[0]], np.array(hubs)[others][out[0]]
                yield batch_of(_FOUND, [pa.array(docs), pa.array(hubs), pa.array(out[1])])
        release_memory()

    met = texts.join(asked, "doc").repartition("hub", "share").sortWithinPartitions("hub", "share", "turn")
    return met.select(*_MET).mapInArrow(run, "a long, b long, overlap long").distinct()


def _alone(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``class``, ``alone``: how many of its shingles no other of the members (class) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(words(zlib.decompress(t.as_py())), width)) for t in batch.column("packed")]
            docs = np.repeat(batch.column("doc").to_numpy(), [len(s) for s in sets])
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            for at in range(0, len(values), _OUT):
                yield batch_of(_HELD, [pa.array(docs[at : at + _OUT]), pa.array(values[at : at + _OUT])])
        release_memory()

    held = texts.join(members, F.col("doc") == F.col("class"), "left_semi").mapInArrow(run, "class long, value long")
    ends = held.groupBy("value").agg(F.min("class").alias("class"), F.max("class").alias("_last"))
    return ends.filter(F.col("class") == F.col("_last")).groupBy("class").agg(F.count("*").alias("alone"))


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are not in one component of ``classes`` yet."""
    left = classes.select(F.col("node").alias("a"), F.col("component").alias("_of_a"))
    right = classes.select(F.col("node").alias("b"), F.col("component").alias("_of_b"))
    found = pairs.join(left, "a", "left").join(right, "b", "left")
    differ = F.coalesce("_of_a", "a") != F.coalesce("_of_b", "b")
    return found.filter(differ).drop("_of_a", "_of_b")


def class_links(
    stars: DataFrame,
    seen: DataFrame,
    texts_of: Callable[[DataFrame], DataFrame],
    *,
    width: int,
    percent: int,
    overlaps: DataFrame | None = None,
    thin: Callable[[DataFrame], DataFrame] | None = None,
    tie: Callable[[DataFrame], DataFrame] | None = None,
    allowed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Links (a, b) between classes, enough to connect all that similar pairs connect.

    ``stars`` ties items (key, doc, leader_doc); ``seen`` gives every item's ``class`` (the
    least item with the same set) and ``n_shingles``; ``texts_of`` fetches ``doc`` and ``packed``
    (compressed words) of the classes asked for; ``overlaps`` (doc, leader_doc, overlap)
    says how much of an intersection is sure. ``thin`` leaves out pairs (a, b) that cannot be
    similar; ``tie`` gives edges (a, b) that connect the members of each key, as
    ``_members_apart`` gives them, that are of different components and may be similar. With
    ``tie`` no pairs are made of a key's members. ``allowed`` leaves out pairs (a, b) that are no link
    however similar; texts are then fetched for the others only.
    """
    if overlaps is None:
        overlaps = stars.select("doc", "leader_doc", F.lit(0).alias("overlap")).distinct()
    overlaps = materialise(overlaps, "links-overlaps")
    of_a = seen.select(F.col("doc_id").alias("doc"), F.col("class").alias("x"), F.col("n_shingles").alias("nx"))
    of_b = seen.select(F.col("doc_id").alias("leader_doc"), F.col("class").alias("y"), F.col("n_shingles").alias("ny"))
    met = overlaps.join(of_a.distinct(), "doc").join(of_b.distinct(), "leader_doc").filter("x <> y")
    enough = (100 + percent) * F.col("overlap") >= percent * (F.col("nx") + F.col("ny"))
    met = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    met = met.agg(
        F.max(enough).alias("sure"),
        F.max(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")).alias("possible"),
    )
    met = materialise(met, "links-met")
    pairs = met.filter("possible")
    if allowed is not None:
        pairs = met = materialise(allowed(pairs), "links-allowed")
    links = pairs.filter("sure").select("a", "b")
    open_pairs = pairs.filter("NOT sure").select("a", "b")
    if not links.isEmpty():
        open_pairs = _apart(open_pairs, materialise(connected_components(links), "links-sure"))
    if thin is not None:
        open_pairs = met = materialise(thin(open_pairs), "links-thinned")
    texts = texts_of(met.select(F.col("a").alias("doc")).union(met.select("b")).distinct())
    links = materialise(links.union(_verified(open_pairs, texts, width, percent).select("a", "b")), "links-first")
    members = _members_apart(stars, seen, materialise(connected_components(links), "links-classes"))
    if members is None:
        return links
    if tie is not None:
        members = materialise(members, "links-split-members")
        return links.union(_links_between(members, materialise(tie(members), "links-tied"), texts_of, width, percent))
    if allowed is not None:
        members = materialise(members, "links-split-members")
        texts = texts_of(members.select(F.col("class").alias("doc")).distinct())
    rest = _pairs_apart(members, texts, width, percent).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    if allowed is not None:
        rest = allowed(materialise(rest, "links-rest"))
    return links.union(_verified(rest, texts, width, percent).select("a", "b"))


def _members_apart(stars: DataFrame, seen: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Members of the keys whose members are not all in one component of the links so far.

    ``key``, ``class``, ``n_shingles``, ``component``, and ``outside``: whether that is not
    the largest component of the key. None if there are none.
    """
    component = F.coalesce("component", "class").alias("component")
    placed = seen.join(classes, F.col("class") == F.col("node"), "left")
    placed = placed.select(F.col("doc_id").alias("doc"), "class", "n_shingles", component).distinct()
    placed = materialise(placed, "links-placed")
    tied = stars.select("key", "doc", "leader_doc")
    leads = placed.select(F.col("doc").alias("leader_doc"), F.col("component").alias("_lead"))
    split = tied.join(placed.select("doc", "component"), "doc").join(leads, "leader_doc")
    split = materialise(split.filter("component <> _lead").select("key").distinct(), "links-split")
    if split.isEmpty():
        return None
    held = materialise(tied.join(split, "key", "left_semi"), "links-held")
    held = held.select("key", "doc").union(held.select("key", "leader_doc")).distinct()
    held = held.join(placed, "doc").select("key", "class", "n_shingles", "component").distinct()
    return _with_outside(materialise(held, "links-members"))


def _with_outside(held: DataFrame) -> DataFrame:
    """``held`` (key, component, n_shingles) with ``outside``: whether a row is not of its key's largest
    component; ``n_members``: how many rows the key has, ``n_outside``: how many of them are outside,
    and ``s_outside``: the shingles of these."""
    sizes = held.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    largest = F.struct("n", "component")
    sizes = sizes.groupBy("key").agg(
        F.max_by("component", largest).alias("_largest"),
        F.sum("n").alias("n_members"),
        (F.sum("n") - F.max("n")).alias("n_outside"),
        (F.sum("s") - F.max_by("s", largest)).alias("s_outside"),
    )
    held = held.join(materialise(sizes, "links-sizes"), "key")
    return held.withColumn("outside", F.col("component") != F.col("_largest")).drop("_largest")


def dealt(members: DataFrame, blocks: Column) -> DataFrame:
    """``members`` (key, class, outside) dealt so that all of a key meet all those outside, in ``blocks`` blocks.

    Every member goes to each block of its key, at an odd ``place``; before them, at the
    even place, come the block's share of those outside, its hubs. A block lies in one task, in order.
    """
    blocks = F.greatest(blocks, F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int") * 2
    places = F.transform(F.sequence(F.lit(0), blocks - 1), lambda block: block * 2 + 1)
    places = F.when(F.col("outside"), F.array_append(places, own)).otherwise(places)
    rows = members.withColumn("place", F.explode(places))
    return rows.repartition("key", F.shiftright("place", 1)).sortWithinPartitions("key", "place")


_PLACED = ("key", "place", "class", "component", "packed")


def _links_between(
    members: DataFrame, ties: DataFrame, texts_of: Callable[[DataFrame], DataFrame], width: int, percent: int
) -> DataFrame:
    """Links (a, b) that connect what similar pairs of different components connect.

    Members that ``ties`` connect come together, whole sets, a bounded number of hubs to a task. It
    compares each member with all hubs at once, and gives out a link only where it joins
    components that its earlier links have not joined.
    """
    ties = materialise(connected_components(ties), "links-clusters").withColumnRenamed("component", "key")
    held = members.groupBy("class").agg(F.min("component").alias("component"), F.max("n_shingles").alias("n_shingles"))
    held = materialise(held.join(ties, F.col("class") == F.col("node")).drop("node"), "links-clustered")
    texts = texts_of(held.select(F.col("class").alias("doc")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs, table = None, [], None
        for batch in chain.from_iterable(slices(batch, _PLACED.index("packed"), _TEXT_BYTES) for batch in batches):
            out = []
            for key, place, doc, component, packed in zip(*(batch.column(c).to_pylist() for c in _PLACED), strict=True):
                if group != (key, place >> 1):
                    group, hubs, table, joined = (key, place >> 1), [], None, {}
                values = np.unique(shingles(words(zlib.decompress(packed)), width))
                if len(values) == 0:
                    continue
                if not place & 1:
                    hubs.append((doc, component, values))
                    continue
                if not hubs:
                    continue
                if table is None:
                    docs, components, sets = zip(*hubs, strict=True)
                    sizes = np.array([len(s) for s in sets])
                    starts = np.cumsum(sizes) - sizes
                    table, at = np.unique(np.concatenate(sets), return_inverse=True)
                    hubs, sets = [()], None
                there = np.searchsorted(table, values)
                there = there[table[np.minimum(there, len(table) - 1)] == values]
                held = np.zeros(len(table), np.int64)
                held[there] = 1
                overlap = np.add.reduceat(held[at], starts)
                similar = 100 * overlap >= percent * (sizes + len(values) - overlap)
                for i in np.flatnonzero(similar).tolist():
                    a, b = _root(joined, components[i]), _root(joined, component)
                    if a != b:
                        joined[a] = b
                        out.append((docs[i], doc))
            if out:
                yield batch_of(_LINK, list(zip(*out, strict=True)))
        release_memory()

    held = _with_outside(held).join(texts, F.col("class") == F.col("doc"))
    met = dealt(held, F.ceil(F.col("s_outside") / _SHINGLES)).select(*_PLACED)
    return met.mapInArrow(run, "a long, b long").distinct()


def _root(joined: dict[int, int], node: int) -> int:
    while node in joined:
        if joined[node] in joined:
            joined[node] = joined[joined[node]]
        node = joined[node]
    return node


def _pairs_apart(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one key, but of different components, that may be similar.

    A pair inside a key's largest component is connected already, so one of the
    two is outside it. Where many are outside, members are dropped that cannot link with
    any: of x's shingles those that x holds alone are in no intersection, so its overlap
    with y is at most n_x - alone_x.
    """
    members = materialise(members, "links-apart")
    many = members.filter(F.col("n_outside") > _FEW)
    alone = _alone(materialise(many.select("class").distinct(), "links-many"), texts, width)
    most = F.col("n_shingles") - F.coalesce("alone", F.lit(0))
    many = many.join(materialise(alone, "links-alone"), "class", "left").withColumn("most", most)
    many = many.filter(100 * F.col("most") >= percent * F.col("n_shingles"))
    few = members.filter(F.col("n_outside") <= _FEW).withColumn("most", F.col("n_shingles"))
    held = materialise(few.unionByName(many.drop("alone")), "links-possible")
    outside = held.filter("outside").select(
        "key", *[F.col(c).alias(f"_{c}") for c in ("class", "n_shingles", "component", "most")]
    )
    overlap = F.least("most", "_most", "n_shingles", "_n_shingles")
    met = held.join(materialise(outside, "links-outside"), "key").filter("component <> _component")
    met = met.filter(100 * overlap >= percent * (F.col("n_shingles") + F.col("_n_shingles") - overlap))
    return met.select(F.least("class", "_class").alias("a"), F.greatest("class", "_class").alias("b")).distinct()

"""Alignment of two tokenizers' tokens over the same bytes, by an associative merge.

Both token streams cover the same bytes. Where a token of either stream ends at the same
byte, both are cut; the tokens between two such cuts are a group, and tokens overlap only
inside a group. A text is taken in byte ranges, each holding the tokens that end in it, and
each range gives a ``Fragment``: what lies before its first cut (open to the left), whole
groups, and what lies behind its last cut (open to the right). ``compose`` joins neighbours:
the open end of one and the open start of the next close a group. It is associative, so
ranges may be merged in any bracketing: inside a task for a piece of a text, and level by
level across tasks for the pieces of a long one.

Link counts over the whole corpus come back without a row per document and pair: a task
numbers the pairs it has met in bounded parts and hands on each part's distinct pairs once.
They are summed, joined back to the parts, and each part's documents look their own up.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.prefixes import Known
from sparrowline.llm.shared import batch_of, slices
from sparrowline.session import materialise

# Bytes of text per fragment, and per piece that one task tokenises.
RANGE_BYTES = 1 << 14
PIECE_BYTES = 1 << 16
# Neighbouring fragments that one task merges per level.
FAN = 8
# Distinct (document, pair) entries that a part numbers together.
PART_LINKS = 2_000_000
_DICTIONARY_ROWS = 1 << 16
# A space between characters that are no white space: no token of either stream crosses its start, so
# the parts of a text cut there have the tokens they have in the whole.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"

_EMPTY = np.zeros(0, np.int32)


class BytePieces:
    """Stream A: a byte-level BPE tokenizer file's text; special tokens' strings are plain text."""

    def __init__(self, definition: str):
        from tiktoken import Encoding

        from sparrowline.llm.bpe import PATTERN, byte_letters

        parts, letters = json.loads(definition), byte_letters()
        special = {t["content"] for t in parts["added_tokens"]}
        vocabulary = {t: i for t, i in parts["model"]["vocab"].items() if t not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"])
        made = [vocabulary[left + right] for left, right in pairs]
        if made != sorted(made) or (parts.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE file whose ids rank its merges")
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every single byte")
        self.bytes = {i: t for t, i in ranks.items()}
        self.model = Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        return (self.model.encode_ordinary(" " + text) for text in texts)


class SpacePieces:
    """Stream B: a sentence-piece BPE model's bytes; it puts a space before each text itself.

    Its pieces must not go on after a space, and it must not change or join characters itself.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        self.bytes = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if re.search(f"[^{_SPACE}]{_SPACE}", piece):
                raise ValueError("pieces that go on after a space cannot be cut at spaces")
            plain = b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace(_SPACE, " ").encode()
            self.bytes[i] = bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else plain

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Sizes:
    """Bytes of each token of both streams, and how ids are written: all that merging needs."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]):
        self.lengths = lengths
        self.width = max(map(len, lengths))
        #: Decimal ids followed by one of the three marks.
        self.written = Known(lambda i: f"{i % self.width}{',|;'[i // self.width]}".encode(), 3 * self.width)


class Streams(Sizes):
    """Both tokenizers."""

    def __init__(self, definition: str, model: bytes):
        self.both = BytePieces(definition), SpacePieces(model)
        super().__init__(tuple(self._lengths(tokens.bytes) for tokens in self.both))

    @staticmethod
    def _lengths(texts: dict[int, bytes]) -> np.ndarray:
        lengths = np.zeros(max(texts) + 1, np.int64)
        lengths[list(texts)] = [len(t) for t in texts.values()]
        return lengths

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Per text, ids of both streams for a space and the text; ``None`` if one of them does not give its bytes."""
        encoded = (tokens.encode(texts) for tokens in self.both)
        for text, *lists in zip(texts, *encoded, strict=True):
            # Stream A has a token for every byte and changes none, so only B can lose some.
            given = b"".join(map(self.both[1].bytes.__getitem__, lists[1]))
            whole = given == b" " + text.encode()
            yield tuple(np.array(ids, np.int32) for ids in lists) if whole else None


@dataclass
class Links:
    """Distinct pairs ``a << 32 | b`` in order, and how many links each stands for."""

    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def of(pairs: np.ndarray) -> Links:
        return Links(*np.unique(pairs, return_counts=True))

    @staticmethod
    def sum(many: list[Links]) -> Links:
        many = [links for links in many if len(links.pairs)]
        if len(many) < 2:
            return many[0] if many else Links()
        pairs, at = np.unique(np.concatenate([m.pairs for m in many]), return_inverse=True)
        weights = np.concatenate([m.counts for m in many])
        return Links(pairs, np.bincount(at, weights=weights, minlength=len(pairs)).astype(np.int64))


@dataclass
class Fragment:
    """A byte range's tokens: open to the left, whole groups, open to the right.

    Without a cut in the range, all its tokens are in ``head`` and ``cut`` is false.
    ``groups`` holds the whole groups as text, each ended by ``;``.
    """

    cut: bool
    head: tuple[np.ndarray, np.ndarray]
    groups: list[bytes]
    n_groups: int
    links: Links
    tail: tuple[np.ndarray, np.ndarray] = (_EMPTY, _EMPTY)


def _join(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(pair) for pair in zip(left, right, strict=True))


def _pairs(sizes: Sizes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair for each overlap of a token of ``a`` and one of ``b``, which cover the same bytes."""
    a_size, b_size = sizes.lengths[0][a], sizes.lengths[1][b]
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    first = np.searchsorted(b_end, a_end - a_size, "right")
    beyond = np.searchsorted(b_end - b_size, a_end, "left")
    many = beyond - first
    offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(a.astype(np.int64) << 32, many) | b[np.repeat(first, many) + offset]


def _text(sizes: Sizes, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> bytes:
    """Groups as text ``a1,a2|b1;``: ids of each group's tokens in order."""
    place = np.concatenate([2 * a_group, 2 * b_group + 1])
    order = np.argsort(place, kind="stable")
    place = place[order]
    ids = np.concatenate([a, b])[order].astype(np.int64)
    last = np.append(place[1:] != place[:-1], True)
    mark = np.where(last, 1 + (place & 1), 0)
    return b"".join(map(sizes.written.__getitem__, (mark * sizes.width + ids).tolist()))


def fragment(sizes: Sizes, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> Fragment:
    """The fragment of the tokens that end in one byte range; ends count from any one byte."""
    cuts = a_end[np.isin(a_end, b_end, assume_unique=True)]
    if not len(cuts):
        return Fragment(False, (a, b), [], 0, Links())
    a_low, a_high = np.searchsorted(a_end, cuts[[0, -1]], "right")
    b_low, b_high = np.searchsorted(b_end, cuts[[0, -1]], "right")
    inner_a, inner_b = a[a_low:a_high], b[b_low:b_high]
    groups, links = [], Links()
    if len(inner_a):
        links = Links.of(_pairs(sizes, inner_a, inner_b))
        a_group, b_group = np.searchsorted(cuts, a_end[a_low:a_high]), np.searchsorted(cuts, b_end[b_low:b_high])
        groups = [_text(sizes, inner_a, inner_b, a_group, b_group)]
    return Fragment(True, (a[:a_low], b[:b_low]), groups, len(cuts) - 1, links, (a[a_high:], b[b_high:]))


def _closed(sizes: Sizes, tokens: tuple[np.ndarray, np.ndarray]) -> tuple[list[bytes], Links]:
    """One whole group as text, and its links."""
    a, b = tokens
    text = _text(sizes, a, b, np.zeros(len(a), np.int64), np.zeros(len(b), np.int64))
    return [text], Links.of(_pairs(sizes, a, b))


def compose(sizes: Sizes, left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring byte ranges; associative."""
    if not right.cut:
        if not left.cut:
            return Fragment(False, _join(left.head, right.head), [], 0, Links())
        return Fragment(True, left.head, left.groups, left.n_groups, left.links, _join(left.tail, right.head))
    if not left.cut:
        return Fragment(True, _join(left.head, right.head), right.groups, right.n_groups, right.links, right.tail)
    text, links = _closed(sizes, _join(left.tail, right.head))
    many = left.n_groups + 1 + right.n_groups
    all_links = Links.sum([left.links, links, right.links])
    return Fragment(True, left.head, left.groups + text + right.groups, many, all_links, right.tail)


def merge(sizes: Sizes, fragments: list[Fragment]) -> Fragment:
    """Neighbours composed two by two, level by level."""
    while len(fragments) > 1:
        pairs = zip(fragments[::2], fragments[1::2], strict=False)
        odd = fragments[-1:] if len(fragments) % 2 else []
        fragments = [compose(sizes, left, right) for left, right in pairs] + odd
    return fragments[0]


def finish(sizes: Sizes, whole: Fragment) -> tuple[bytes, int, Links]:
    """All groups of a whole text, whose bounds are cuts: text, number and links."""
    text, links = _closed(sizes, whole.head)
    return b"".join(text + whole.groups)[:-1], 1 + whole.n_groups, Links.sum([links, whole.links])


def align_tokens(sizes: Sizes, a: np.ndarray, b: np.ndarray, range_bytes: int = RANGE_BYTES) -> Fragment:
    """The fragment of a text's tokens, from the fragments of its byte ranges."""
    a_end, b_end = np.cumsum(sizes.lengths[0][a]), np.cumsum(sizes.lengths[1][b])
    edges = np.arange(0, int(a_end[-1]), range_bytes)[1:]
    a_at, b_at = ([0, *np.searchsorted(end, edges, "right").tolist(), len(end)] for end in (a_end, b_end))
    ranges = zip(a_at, a_at[1:], b_at, b_at[1:], strict=False)
    return merge(sizes, [fragment(sizes, a[i:j], a_end[i:j], b[k:m], b_end[k:m]) for i, j, k, m in ranges])


def _pack(links: Links, kind: type = np.int64) -> bytes:
    """Links in few bytes: they come in order, so their steps are small."""
    steps = np.diff(links.pairs, prepend=0)
    return zlib.compress(steps.astype(kind).tobytes() + links.counts.astype(np.int32).tobytes(), 1)


def _unpack(data: bytes, kind: type = np.int64) -> Links:
    plain = zlib.decompress(data)
    many = len(plain) // (np.dtype(kind).itemsize + 4)
    steps = np.frombuffer(plain, kind, many)
    return Links(np.cumsum(steps.astype(np.int64)), np.frombuffer(plain, np.int32, many, steps.nbytes).astype(np.int64))


# One row per document, then the distinct pairs of a part in runs of rows.
_FOUND = (
    "part long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, "
    "base long, pairs array<long>, counts array<long>"
)
_FOUND_ARROW = [
    ("part", pa.int64()),
    ("n_a", pa.int64()),
    ("n_b", pa.int64()),
    ("n_groups", pa.int64()),
    ("n_links", pa.int64()),
    ("groups_sha256", pa.string()),
    ("links", pa.binary()),
    ("base", pa.int64()),
    ("pairs", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64())),
]
_PIECE = "row long, k long, n long, n_a long, n_b long, whole boolean, cut boolean, n_groups long"
_PIECE_ARROW = [
    ("row", pa.int64()),
    ("k", pa.int64()),
    ("n", pa.int64()),
    ("n_a", pa.int64()),
    ("n_b", pa.int64()),
    ("whole", pa.bool_()),
    ("cut", pa.bool_()),
    ("n_groups", pa.int64()),
]
_OPEN = ("head_a", "head_b", "tail_a", "tail_b", "groups", "links")


class _Parts:
    """Documents in bounded parts; a part's distinct pairs are numbered together."""

    def __init__(self, tag: int, id_type: pa.DataType, most: int):
        self.schema = pa.schema([("doc_id", id_type), *_FOUND_ARROW])
        self.next, self.most = tag << 60 | TaskContext.get().partitionId() << 28, most
        self.rows, self.links, self.held = [], [], 0

    def add(self, row: tuple, links: Links) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.links.append(links)
        self.held += 1 + len(links.pairs)
        if self.held >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        pairs, at = np.unique(np.concatenate([x.pairs for x in self.links]), return_inverse=True)
        counts = np.concatenate([x.counts for x in self.links])
        sums = np.bincount(at, weights=counts, minlength=len(pairs)).astype(np.int64)
        ends = np.cumsum([len(x.pairs) for x in self.links])
        packed = [_pack(Links(i, x.counts), np.int32) for i, x in zip(np.split(at, ends[:-1]), self.links, strict=True)]
        many = len(self.rows)
        none = [None] * many
        columns = [*map(list, zip(*self.rows, strict=True))]
        yield batch_of(self.schema, [columns[0], [self.next] * many, *columns[1:], packed, none, none, none])
        for low in range(0, len(pairs), _DICTIONARY_ROWS):
            some = slice(low, low + _DICTIONARY_ROWS)
            lists = [pa.array([x[some]], pa.list_(pa.int64())) for x in (pairs, sums)]
            yield batch_of(self.schema, [[None], [self.next], *[[None]] * 6, [low], *lists])
        self.next += 1
        self.rows, self.links, self.held = [], [], 0


_NOTHING = (0, 0, 0, 0, "")


def _finished(sizes: Sizes, whole: Fragment, n_a: int, n_b: int) -> tuple[tuple, Links]:
    text, n_groups, links = finish(sizes, whole)
    return (n_a, n_b, n_groups, int(links.counts.sum()), hashlib.sha256(text).hexdigest()), links


def _pieces(text: str, size: int) -> Iterator[str]:
    """Pieces of at least ``size`` characters, cut before a space that no token crosses.

    The space itself is left out, as each piece is tokenised after a space. Text without
    such a space is one piece.
    """
    low = 0
    while (cut := _CUT.search(text, low + size)) is not None:
        yield text[low : cut.start()]
        low = cut.end()
    yield text[low:]


def _fragment_row(row: int, k: int, n: int, many: tuple, whole: bool, f: Fragment) -> list:
    packed = [ids.astype("<i4").tobytes() for ids in (*f.head, *f.tail)]
    return [row, k, n, *many, whole, f.cut, f.n_groups, *packed, zlib.compress(b"".join(f.groups), 1), _pack(f.links)]


def _fragment_of(row: dict) -> Fragment:
    head_a, head_b, tail_a, tail_b = (np.frombuffer(row[name], "<i4") for name in _OPEN[:4])
    groups = [zlib.decompress(row["groups"])]
    return Fragment(row["cut"], (head_a, head_b), groups, row["n_groups"], _unpack(row["links"]), (tail_a, tail_b))


_BAD = Fragment(False, (_EMPTY, _EMPTY), [], 0, Links())


def _align_short(docs: DataFrame, load: Callable[[], Streams], id_type: pa.DataType, part_links: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams, parts = load(), _Parts(0, id_type, part_links)
        for batch in batches:
            for some in slices(batch, 1, 1 << 20):
                doc_ids, texts = (c.to_pylist() for c in some.columns)
                # Null and empty texts have no tokens, whatever an empty text would be given.
                for doc_id, text, ids in zip(doc_ids, texts, streams.tokens([t or "" for t in texts]), strict=True):
                    ids = ids if text else None
                    found, links = _NOTHING, Links()
                    if ids:
                        found, links = _finished(streams, align_tokens(streams, *ids), len(ids[0]), len(ids[1]))
                    yield from parts.add((doc_id, *found), links)
        yield from parts.flush()

    return docs.mapInArrow(run, f"{_id_field(docs)}, {_FOUND}")


def _id_field(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def _align_long(
    docs: DataFrame, load: Callable[[], Streams], id_type: pa.DataType, piece: int, fan: int, part_links: int
) -> DataFrame:
    """Texts of several pieces: fragments by piece in any task, merged level by level."""
    named, lengths = _id_field(docs), load().lengths
    schema = f"{named}, {_PIECE}, " + ", ".join(f"{name} binary" for name in _OPEN)
    kind = pa.schema([("doc_id", id_type), *_PIECE_ARROW, *((name, pa.binary()) for name in _OPEN)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", id_type), ("row", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("text", pa.string())])
        for batch in batches:
            for doc_id, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(_pieces(text, piece))
                many = len(found)
                yield batch_of(out, [[doc_id] * many, [row] * many, list(range(many)), [many] * many, found])

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = load()
        for batch in batches:
            for doc_id, row, k, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = next(streams.tokens([text]))
                f = align_tokens(streams, *ids) if ids else _BAD
                many = (len(ids[0]), len(ids[1])) if ids else (0, 0)
                values = [doc_id, *_fragment_row(row, k, n, many, ids is not None, f)]
                yield batch_of(kind, [[v] for v in values])

    def merged(table: pa.Table) -> pa.Table:
        sizes, rows = Sizes(lengths), sorted(table.to_pylist(), key=lambda r: r["k"])
        whole = all(r["whole"] for r in rows)
        f = merge(sizes, [_fragment_of(r) for r in rows]) if whole else _BAD
        many = tuple(sum(r[name] for r in rows) for name in ("n_a", "n_b"))
        first = rows[0]
        values = [first["doc_id"], *_fragment_row(first["row"], first["k"] // fan, first["n"], many, whole, f)]
        return pa.Table.from_batches([batch_of(kind, [[v] for v in values])])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, parts = Sizes(lengths), _Parts(1, id_type, part_links)
        for batch in batches:
            for row in batch.to_pylist():
                found, links = _NOTHING, Links()
                if row["whole"]:
                    found, links = _finished(sizes, _fragment_of(row), row["n_a"], row["n_b"])
                yield from parts.add((row["doc_id"], *found), links)
        yield from parts.flush()

    # The scan gives its rows in the same order each time, so a lost task gives the same numbers again.
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    cut_rows = rows.mapInArrow(cut, f"{named}, row long, k long, n long, text string")
    level = materialise(cut_rows.repartition("row", "k").mapInArrow(fragments, schema), "fragments")
    most = level.agg(F.max("n")).first()[0] or 1
    while most > 1:
        level = level.groupBy("row", F.floor(F.col("k") / fan)).applyInArrow(merged, schema)
        most = -(-most // fan)
    return level.mapInArrow(ended, f"{named}, {_FOUND}")


def _looked_up(docs: DataFrame, told: DataFrame, id_type: pa.DataType) -> DataFrame:
    """Each document's links meet the counts of its part's pairs."""
    names = ["n_a", "n_b", "n_groups", "n_links"]
    out = pa.schema(
        [("doc_id", id_type), *((n, pa.int64()) for n in (*names, "n_best", "count_sum")), ("groups_sha256", pa.string())]
    )

    def look_up(rows: pa.Table, counts: pa.Table) -> pa.Table:
        at = counts["at"].to_numpy()
        total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        total[at], best[at] = counts["total"].to_numpy(), counts["best"].to_numpy()
        n_best, sums = [], []
        for packed in rows["links"].to_pylist():
            links = _unpack(packed, np.int32)
            n_best.append(int(links.counts @ best[links.pairs]))
            sums.append(int(links.counts @ total[links.pairs]))
        columns = [rows["doc_id"], *(rows[n] for n in names), n_best, sums, rows["groups_sha256"]]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.Table.from_batches([batch_of(out, columns)])

    schema = ", ".join([_id_field(docs), *(f"{n} long" for n in (*names, "n_best", "count_sum")), "groups_sha256 string"])
    told = told.toDF("of_part", "at", "total", "best")
    return docs.groupBy("part").cogroup(told.groupBy("of_part")).applyInArrow(look_up, schema)


def align(
    docs: DataFrame,
    a_definition: str,
    b_model: bytes,
    doc_id: str = "doc_id",
    text: str = "text",
    piece_chars: int = PIECE_BYTES,
    fan: int = FAN,
    part_links: int = PART_LINKS,
) -> DataFrame:
    """How the tokens of two tokenizers lie over each text, one row per row of ``docs``.

    ``a_definition`` is the text of a byte-level BPE file, ``b_model`` the bytes of a
    sentence-piece BPE model. Both encode a space and the text; special tokens' strings are
    plain text. Returns ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256)``: tokens, groups, overlapping token pairs; links whose id pair is the most
    frequent one of its B id in the corpus, ties included; the sum of the links' corpus-wide
    counts; a digest of the groups as ``a1,a2|b1;a3|b2``.

    A text that is null, empty, or not given back by one of the two has no tokens: zeros and
    an empty digest, and no links for others to count. Repeated rows and ids count each for
    themselves; ids may be null and of any type. An empty table gives an empty one; columns
    other than the two named are not looked at. Texts over ``piece_chars`` are tokenised in
    pieces by any tasks; only text without a space between other characters is one piece.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    def load() -> Streams:
        return Streams(a_definition, b_model)

    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    is_long = F.coalesce(F.length("text") > piece_chars, F.lit(False))
    found = _align_short(docs.filter(~is_long), load, id_type, part_links).unionByName(
        _align_long(docs.filter(is_long), load, id_type, piece_chars, fan, part_links)
    )
    found = materialise(found, "aligned")
    pairs = found.filter("pairs IS NOT NULL").select(
        "part", "base", F.posexplode(F.arrays_zip("pairs", "counts")).alias("pos", "one")
    )
    pairs = pairs.select("part", (F.col("base") + F.col("pos")).alias("at"), "one.pairs", "one.counts")
    totals = pairs.groupBy("pairs").agg(F.sum("counts").alias("total"))
    # A B id has no more pairs than A has ids.
    b = F.col("pairs").bitwiseAND(0xFFFFFFFF)
    most = totals.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    best = totals.withColumn("b", b).join(most, "b").select("pairs", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    told = pairs.select("part", "at", "pairs").join(best, "pairs").select("part", "at", "total", "best")
    return _looked_up(found.filter("pairs IS NULL").drop("pairs", "counts", "base"), told, id_type)

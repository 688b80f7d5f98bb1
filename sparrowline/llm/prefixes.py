"""Byte-level BPE by prefix dynamic programming, with exact appends and local re-encoding.

For every prefix of a word's bytes, BPE has one encoding, so one last token. The token that
ends at byte ``i`` is that suffix of the prefix which is a token and may follow the last
token of the prefix before it: two neighbours are valid if BPE of their joined bytes gives
back these two, and a sequence is the encoding of its bytes if all its neighbours are valid
(the first merge across a border would also be the first one of that pair). The table of
last tokens therefore grows byte by byte and never changes for bytes that stand already:
appending continues it, and reading it backwards from any byte gives that prefix's tokens.

Each word of the vocabulary's pattern is encoded by itself. A space before a character that
is no white space always starts a word, so a text is cut there, and an edit changes words
only between the nearest such cuts on both sides.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowline.llm.shared import slices

# Words start here whatever surrounds them. Both meanings of \S in use leave out all white space.
CUT = re.compile(r" (?=\S)")
_NONE = 1 << 60
_CACHED_BYTES = 48
_CACHED_PIECES = 1 << 18
_CACHED_PAIRS = 1 << 20


def load(path: str) -> bytes:
    """A rank file, read on the driver; its size is the vocabulary's."""
    with open(path, "rb") as file:
        return file.read()


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Known(dict):
    """Remembers what ``find`` gives for keys of up to ``longest`` characters.

    Holds ``most`` keys, and those looked up among the ``most`` before: what is rare goes first.
    """

    def __init__(self, find, most: int, longest: int = 1 << 62):
        super().__init__()
        self.find, self.most, self.longest, self.older = find, most, longest, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.find(key)
            if not isinstance(key, int) and len(key) > self.longest:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class PrefixBpe:
    """A vocabulary of ranked byte strings, and the tables of last tokens it gives.

    ``ranks`` is the text of a rank file (base64 of a token's bytes, space, rank, a line
    each); ``pattern`` cuts texts into words. A token's rank is its id.
    """

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every single byte")
        self.tokens = {i: token for token, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.pattern = regex.compile(pattern)
        self.halves = Known(self._halves, _CACHED_PAIRS)
        self.valid = Known(self._valid, _CACHED_PAIRS)
        self.words = Known(self._word, _CACHED_PIECES, _CACHED_BYTES)
        self.first = Known(self._packed, _CACHED_PIECES, _CACHED_BYTES)
        self.later = Known(lambda piece: self._packed(" " + piece), _CACHED_PIECES, _CACHED_BYTES)

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """Plain merges until ``least`` parts are left: the pair of least rank first, the leftmost of equal ones."""
        rank = lambda part: self.ids.get(part, _NONE)
        cuts = list(range(len(data) + 1))
        ranks = [rank(data[i : i + 2]) for i in range(len(data) - 1)]
        while len(ranks) >= least and (lowest := min(ranks)) < _NONE:
            at = ranks.index(lowest)
            del cuts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(data[cuts[at - 1] : cuts[at + 1]])
            if at < len(ranks):
                ranks[at] = rank(data[cuts[at] : cuts[at + 2]])
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _halves(self, token: int) -> tuple[int, ...]:
        """The two tokens that the token's last merge joins; none for a byte, one for a token no merge makes."""
        data = self.tokens[token]
        if len(data) == 1:
            return ()
        parts = self.merged(data, 2)
        return tuple(self.ids[part] for part in parts) if len(parts) == 2 else (token,)

    def _valid(self, pair: int) -> bool:
        """Whether the second of two packed tokens may follow the first; -1 stands for a word's start.

        Merges are taken back, the later one of the two sides first. At each step the parts
        that meet at the border stood there until the merge just taken back: had they a merge
        of lower rank, it would have come before. Of equal ranks the one on the left comes first.
        """
        left, right = pair >> 32, pair & 0xFFFFFFFF
        halves, tokens = self.halves, self.tokens
        if len(halves[right]) == 1:
            return False
        if left < 0:
            return True
        until = _NONE
        while True:
            across = self.ids.get(tokens[left] + tokens[right])
            if across is not None and across < until:
                return False
            of_left, of_right = halves[left], halves[right]
            if of_left and (left > right or not of_right):
                until, left = left, of_left[1]
            elif of_right:
                until, right = right + 1, of_right[0]
            else:
                return True

    def extend(self, last: array, word: bytes) -> int:
        """Continue ``last``, the table of a prefix of ``word``, to its end; the entries made."""
        had, ids, valid, longest = len(last), self.ids, self.valid, self.longest
        for end in range(had + 1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(word[start:end])
                if token is not None and valid[(last[start - 1] if start else -1) << 32 | token]:
                    last.append(token)
                    break
        return len(last) - had

    def _last(self, word: bytes, end: int, last: list[int | None]) -> int:
        """One entry of a short word's table, and those that it asks for."""
        ids, valid = self.ids, self.valid
        for start in range(end):
            token = ids.get(word[start:end])
            if token is not None:
                before = -1
                if start and (before := last[start]) is None:
                    before = self._last(word, start, last)
                if valid[before << 32 | token]:
                    last[end] = token
                    return token
        raise AssertionError("every byte is a token")

    def _word(self, word: str) -> bytes:
        """Packed tokens of a word. Tables of short words are filled from the end, where it is needed."""
        data = word.encode()
        if data in self.ids:
            return self.ids[data].to_bytes(4, "little")
        if len(data) > _CACHED_BYTES:
            last = array("i")
            self.extend(last, data)
            return _pack(self.word_ids(data, last))
        last: list[int | None] = [None] * (len(data) + 1)
        found, end = [], len(data)
        while end:
            token = last[end] if last[end] is not None else self._last(data, end, last)
            found.append(token)
            end -= len(self.tokens[token])
        return _pack(found[::-1])

    def word_ids(self, word: bytes, last: array) -> list[int]:
        """Tokens of a word, read backwards from its table. A word that is a token is itself."""
        if word in self.ids:
            return [self.ids[word]]
        found, end = [], len(word)
        while end:
            found.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return found[::-1]

    def _packed(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(piece)))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        first, *rest = CUT.split(text or "")
        return self.first[first] + b"".join(map(self.later.__getitem__, rest))

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of ids; those that are not known give none."""
        get = self.tokens.get
        return b"".join([get(i, b"") for i in struct.unpack(f"<{len(ids or b'') // 4}I", ids or b"")])


@dataclass
class PrefixTable:
    """A text's words and their tables of last tokens, kept right under appends and edits."""

    bpe: PrefixBpe
    words: list[str]
    tables: list[array]
    made: int = 0

    @classmethod
    def of(cls, bpe: PrefixBpe, text: str) -> PrefixTable:
        table = cls(bpe, [], [])
        table.replace(0, 0, text)
        return table

    @classmethod
    def stored(cls, bpe: PrefixBpe, text: str, last: bytes) -> PrefixTable:
        """From a text and the entries of all its words, one after the other, as ``packed`` gives."""
        words, entries, at = bpe.pattern.findall(text), array("i"), 0
        entries.frombytes(last)
        tables = []
        for word in words:
            size = len(word.encode())
            tables.append(entries[at : at + size])
            at += size
        return cls(bpe, words, tables)

    @property
    def text(self) -> str:
        return "".join(self.words)

    def packed(self) -> bytes:
        return b"".join(table.tobytes() for table in self.tables)

    def ids(self) -> list[int]:
        pairs = zip(self.words, self.tables, strict=True)
        return [i for word, last in pairs for i in self.bpe.word_ids(word.encode(), last)]

    def append(self, more: str) -> None:
        end = sum(map(len, self.words))
        self.replace(end, end, more)

    def replace(self, begin: int, end: int, put: str) -> None:
        """Put other characters in place of ``begin`` to ``end``; ``made`` counts new entries.

        Words outside the nearest cuts keep their tables; inside, a word that starts as the
        old one at the same place keeps the entries of the prefix they share.
        """
        starts, at = [], 0
        for word in self.words:
            starts.append(at)
            at += len(word)
        size = at
        if not 0 <= begin <= end <= size:
            raise ValueError(f"no characters {begin} to {end} in a text of {size}")
        # A word that starts with a space and goes on with something else starts at a cut. Before
        # the edit both characters must stand; behind it, as well.
        cut = [len(word) > 1 and word[0] == " " and not word[1].isspace() for word in self.words]
        low = next((i for i in range(len(starts) - 1, -1, -1) if cut[i] and starts[i] + 2 <= begin), 0)
        high = next((i for i in range(low, len(starts)) if cut[i] and starts[i] >= end), len(starts))
        left = starts[low] if starts else 0
        old = "".join(self.words[low:high])
        words = self.bpe.pattern.findall(old[: begin - left] + put + old[end - left :])
        had = {starts[i]: i for i in range(low, high)}
        tables, at, self.made = [], left, 0
        for word in words:
            data, last = word.encode(), array("i")
            if at in had:
                i = had[at]
                before = self.words[i].encode()
                pairs = enumerate(zip(before, data, strict=False))
                unlike = next((n for n, (a, b) in pairs if a != b), min(len(before), len(data)))
                last = self.tables[i][:unlike]
            self.made += self.bpe.extend(last, data)
            tables.append(last)
            at += len(word)
        self.words[low:high], self.tables[low:high] = words, tables


def _over(texts: pa.Array, convert, kind: pa.DataType) -> pa.Array:
    """Convert a batch some megabytes of text at a time."""
    parts = slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0)
    done = [pa.array([convert(t) for t in part.column(0).to_pylist()], kind) for part in parts]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def encode(text: Column, ranks: bytes, pattern: str) -> Column:
    """Ids (array<int>) of a whole text, without special tokens.

    Null and empty texts have no ids. Each row stands for itself: repeated rows give the same
    ids, an empty table gives an empty one, other columns are not looked at. A word without a
    space costs time in proportion to its bytes, so very long texts and words are no matter.
    """

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = PrefixBpe(ranks, pattern)
        for texts in batches:
            yield _over(texts, lambda t: memoryview(bpe.encode(t)).cast("I").tolist(), pa.list_(pa.int32()))

    return F.arrow_udf(ids, "array<int>")(text)


def round_trip(text: Column, ranks: bytes, pattern: str) -> Column:
    """``(ids, decoded)`` of a whole text in one pass: packed ids, and the bytes they stand for.

    ``ids`` are little-endian unsigned 32-bit integers. Rules as for ``encode``; without
    ids both are empty.
    """
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.binary())])

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = PrefixBpe(ranks, pattern)

        def row(t: str | None) -> dict[str, bytes]:
            ids = bpe.encode(t)
            return {"ids": ids, "decoded": bpe.decode(ids)}

        for texts in batches:
            yield _over(texts, row, kind)

    return F.arrow_udf(both, "struct<ids:binary,decoded:binary>")(text)


def prefix_table(text: Column, ranks: bytes, pattern: str) -> Column:
    """The table of a text: for each byte, the last token of its word's prefix up to there.

    Signed 32-bit integers in a row (binary), four times the text's bytes; empty for null.
    It is what ``edit_text`` continues from.
    """

    def tables(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = PrefixBpe(ranks, pattern)
        for texts in batches:
            yield _over(texts, lambda t: PrefixTable.of(bpe, t or "").packed(), pa.binary())

    return F.arrow_udf(tables, "binary")(text)


def edit_text(text: Column, table: Column, begin: Column, end: Column, put: Column, ranks: bytes, pattern: str) -> Column:
    """Replace characters ``begin`` to ``end`` of a text by ``put`` and carry its table on.

    Returns ``(text, table, ids, made)``: ``made`` counts the entries that were worked out
    anew. An append is an edit at the text's end. A null text or table counts as empty, a
    null ``put`` as a deletion; a null place is the text's end. Places outside the text end
    the job with an error.
    """
    kind = pa.struct([("text", pa.string()), ("table", pa.binary()), ("ids", pa.list_(pa.int32())), ("made", pa.int64())])

    def edited(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        bpe = PrefixBpe(ranks, pattern)
        for columns in batches:
            rows = []
            for t, last, low, high, new in zip(*(c.to_pylist() for c in columns), strict=True):
                t = t or ""
                held = PrefixTable.stored(bpe, t, last) if last else PrefixTable.of(bpe, t)
                low = len(t) if low is None else low
                held.replace(low, len(t) if high is None else high, new or "")
                rows.append({"text": held.text, "table": held.packed(), "ids": held.ids(), "made": held.made})
            yield pa.array(rows, kind)

    made = F.arrow_udf(edited, "struct<text:string,table:binary,ids:array<int>,made:bigint>")
    return made(text, table, begin, end, put)

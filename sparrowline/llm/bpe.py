"""Byte-level BPE encoding and decoding with a public vocabulary.

A text is cut into words by the vocabulary's pattern and each word is merged by
itself, so a task keeps the ids of the words it has seen. A short word is held as
a contiguous array of part boundaries with the rank of each adjacent pair: the
smallest rank is looked up, its boundary deleted, and the two ranks beside it are
made anew. Scanning the whole array per merge is cheapest for short words; for long
ones, the same merges are taken from a heap, so time stays near-linear.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowline.llm.prefixes import Known
from sparrowline.llm.shared import release_memory

# Fixed value: the word pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same words in texts of ASCII characters alone, where the standard library's matcher will do.
_SPACE = r" \t\n\v\f\r"
_ASCII_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{_SPACE}A-Za-z0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)

_LONG_WORD = 64
_CACHED_WORDS = 1 << 16
_PART = 500
_CACHED_BYTES = 48
_NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file.

    Printable bytes of Latin-1 stand for themselves, the others are numbered from 256.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merge ranks and added tokens of a tokenizer file's text."""

    def __init__(self, definition: str):
        parts = json.loads(definition)
        model, letters = parts["model"], byte_letters()
        split = parts.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
            raise ValueError("not a byte-level BPE file without prefix space")
        plain = lambda token: bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.ids = {plain(token): i for token, i in model["vocab"].items() if token not in self.added}
        texts = {i: token for token, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.texts = defaultdict(bytes, texts)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        self.ranks, self.made = {}, []
        for rank, (left, right) in enumerate((plain(a), plain(b)) for a, b in pairs):
            self.ranks[self.ids[left] << 32 | self.ids[right]] = rank
            self.made.append(self.ids[left + right])
        self.words, self.ascii_words = regex.compile(PATTERN), re.compile(_ASCII_PATTERN)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.seen = Known(self._word_ids, _CACHED_WORDS, _CACHED_BYTES)

    def merge_short(self, word: bytes) -> tuple[int, ...]:
        """Ids of a word: repeatedly delete the boundary inside the pair of least rank."""
        get, made = self.ranks.get, self.made
        parts = [self.bytes[b] for b in word]
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            parts[at] = made[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] << 32 | parts[at], _NONE)
            if at < len(ranks):
                ranks[at] = get(parts[at] << 32 | parts[at + 1], _NONE)
        return tuple(parts)

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same merges in the same order (rank, then place), from a heap."""
        n = len(word)
        parts = [self.bytes[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get
        pair = lambda at: parts[at] << 32 | parts[after[at]]
        heap = [(r, at, pair(at)) for at in range(n - 1) if (r := get(pair(at))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, key = heapq.heappop(heap)
            # A part that was merged away is -1; one that has grown makes another pair.
            if parts[at] < 0 or after[at] >= n or pair(at) != key:
                continue
            gone = after[at]
            parts[at], parts[gone], after[at] = self.made[rank], -1, after[gone]
            if after[at] < n:
                before[after[at]] = at
            for start in (before[at], at):
                if start >= 0 and after[start] < n and (r := get(pair(start))) is not None:
                    heapq.heappush(heap, (r, start, pair(start)))
        return tuple(part for part in parts if part >= 0)

    def _word_ids(self, word: str) -> bytes:
        """Packed ids of a word not seen lately."""
        data = word.encode()
        ids = self.merge_short(data) if len(data) <= _LONG_WORD else self.merge_long(data)
        return array("i", ids).tobytes()

    def pack(self, text: str | None) -> bytes:
        """Ids of a whole text as 32-bit integers, one after the other."""
        out = []
        for i, piece in enumerate(self.specials.split(text or "") if self.specials else [text or ""]):
            if i % 2:
                out.append(array("i", [self.added[piece]]).tobytes())
            else:
                words = self.ascii_words if piece.isascii() else self.words
                out += map(self.seen.__getitem__, words.findall(piece))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.pack(text)).cast("i").tolist()

    def decode(self, ids: list[int] | None) -> str:
        """Bytes that are no UTF-8 come out as U+FFFD; ids that are not known as nothing."""
        return b"".join(map(self.texts.__getitem__, ids or ())).decode("utf-8", "replace")


def _by_parts(rows: pa.Array, convert: Callable, kind: pa.DataType) -> pa.Array:
    """Convert a batch a few hundred rows at a time: Python objects take many times their Arrow size."""
    parts = [pa.array([convert(r) for r in rows.slice(at, _PART).to_pylist()], kind) for at in range(0, len(rows), _PART)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def load(path: str) -> str:
    """Text of a tokenizer file, read on the driver; its size is the vocabulary's."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(text: Column, definition: str) -> Column:
    """Token ids (array<int>) of a whole text; no ids for null or empty.

    Added tokens are found in the text first, as the vocabulary's library does by
    default; nothing is added, cut or padded.
    """

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Vocabulary(definition)
        for texts in batches:
            yield _by_parts(texts, words.encode, pa.list_(pa.int32()))
        del words
        release_memory()

    return F.arrow_udf(ids, "array<int>")(text)


def decode(ids: Column, definition: str) -> Column:
    """Text of token ids, added tokens included; empty for null or no ids."""

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Vocabulary(definition)
        for rows in batches:
            yield _by_parts(rows, words.decode, pa.string())
        del words
        release_memory()

    return F.arrow_udf(texts, "string")(ids)


def round_trip(text: Column, definition: str) -> Column:
    """``(ids, decoded)`` of a whole text in one pass: its ids, and the text they decode to.

    Rules as for ``encode`` and ``decode``: null and empty texts have no ids and decode to
    ``''``. Repeated rows give the same each, an empty table an empty one; other columns are
    not looked at. A text is worked on whole, however long it or a word of it is.
    """

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Vocabulary(definition)
        for texts in batches:
            packed, plain, ends = [], [], [0]
            for at in range(0, len(texts), _PART):
                for text in texts.slice(at, _PART).to_pylist():
                    ids = words.pack(text)
                    packed.append(ids)
                    ends.append(ends[-1] + len(ids) // 4)
                    plain.append(words.decode(memoryview(ids).cast("i").tolist()))
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.StructArray.from_arrays([lists, pa.array(plain, pa.string())], ["ids", "decoded"])
        del words
        release_memory()

    return F.arrow_udf(both, "struct<ids:array<int>,decoded:string>")(text)

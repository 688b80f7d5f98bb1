"""White-space rules, trimming, words and sentences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space characters of the three rules in use, as ranges
# of code points. Word splitting and line coercion follow the first, request
# trimming the second, the stream client the third.
_WORD_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
_REQUEST_RANGES = (
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
_CLIENT_RANGES = (
    (0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
)


def _characters(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(chr(code) for low, high in ranges for code in range(low, high + 1))


def char_class(characters: str) -> str:
    """Regex class, without brackets, in the syntax Java and RE2 share."""
    return "".join(f"\\x{{{ord(character):x}}}" for character in characters)


WORD_SPACE = _characters(_WORD_RANGES)
REQUEST_SPACE = _characters(_REQUEST_RANGES)
CLIENT_SPACE = _characters(_CLIENT_RANGES)

_WORD_BREAK = "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in _WORD_RANGES) + "]+"
SENTENCE = r"[^.!?\n]*[.!?\n]|[^.!?\n]+"


def strip(text: Column, space: str = WORD_SPACE) -> Column:
    """Remove leading and trailing characters that are in ``space``."""
    return F.btrim(text, F.lit(space))


def words(text: Column) -> Column:
    """Array of the maximal runs of non-white-space characters."""
    return F.filter(F.split(text, _WORD_BREAK), lambda w: w != "")


def distinct_words(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(words(F.lower(text)))


def sentences(text: Column) -> Column:
    """Sentences, cut after ``.``, ``!``, ``?`` or a newline, and stripped."""
    pieces = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(pieces, lambda s: strip(s)), lambda s: s != "")


def slices(text: Column, size: int, stride: int | None = None) -> Column:
    """Slices of ``size`` code points starting every ``stride`` code points.

    One regex pass over the text: time grows with the length of the text,
    while repeated ``substring`` calls would rescan it for every slice.
    """
    stride = size if stride is None else stride
    if not 0 < stride <= size:
        raise ValueError("need 0 < stride <= size")
    if stride == size:
        return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    pattern = f"(?s)(?=(.{{1,{size}}})).{{1,{stride}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

"""Recursive splitting of one text, run inside Arrow batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Places to cut, best first. After the last one, any character.
SEPARATORS = ("\n\n", "\n", " ")


def _pieces(text: str, size: int, level: int = 0) -> Iterator[list[str]]:
    """Runs of neighbouring pieces shorter than ``size``; each piece but the
    first of a text starts with the separator it was cut at."""
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    if level == len(SEPARATORS):
        yield list(text)
        return
    separator = SEPARATORS[level]
    head, *rest = text.split(separator)
    run: list[str] = []
    for piece in [head, *(separator + part for part in rest)]:
        if len(piece) < size:
            if piece:
                run.append(piece)
            continue
        if run:
            yield run
            run = []
        yield from _pieces(piece, size, level + 1)
    if run:
        yield run


def _pack(run: list[str], size: int, overlap: int) -> Iterator[str]:
    """Fill chunks up to ``size``; each starts with the last pieces of the one
    before, as many as fit in ``overlap``."""
    held: deque[str] = deque()
    length = 0
    for piece in run:
        if held and length + len(piece) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.popleft())
        held.append(piece)
        length += len(piece)
    if held:
        yield "".join(held)


def split_text(text: str, size: int, overlap: int) -> list[str]:
    chunks = (chunk.strip() for run in _pieces(text, size) for chunk in _pack(run, size, overlap))
    return [chunk for chunk in chunks if chunk]


def split_recursive(size: int, overlap: int) -> Callable[[Column], Column]:
    """Column function from text to an array of chunks."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: split_text(text, size, overlap), na_action="ignore")

    return split

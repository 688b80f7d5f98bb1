"""Items that share a key, as stars instead of pairs.

A key that n items share would give n * n / 2 pairs. Here each task names the least
item of a key its leader and hands on only the leader; the leaders of all tasks then
meet once more. Every item of a key is thus tied to the key's least item by at most
two rows, and no more than one row per key and task reaches a reducer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.shared import batch_of, release_memory

# A key, one item that holds it, what the key stands for, and the item's leader.
SCHEMA = "key long, doc long, part long, size long, leader_doc long, leader_part long, leader_size long"
ARROW = pa.schema([(column.split()[0], pa.int64()) for column in SCHEMA.split(", ")])
_HELD = 1 << 19
_OUT = 1 << 17


class LocalStars:
    """Collects (key, item) rows of a task and gives them out as stars, a few million at a time."""

    def __init__(self):
        self.rows, self.held = [], 0

    def add(self, keys: np.ndarray, docs: np.ndarray | int, parts: np.ndarray | int, sizes: np.ndarray) -> None:
        n = len(keys)
        self.rows.append((keys, *(np.broadcast_to(np.asarray(c, np.int64), n) for c in (docs, parts)), sizes))
        self.held += n

    def full(self) -> bool:
        return self.held >= _HELD

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, docs, parts, sizes = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        self.rows, self.held = [], 0
        order = np.lexsort((parts, docs, keys))
        keys, docs, parts, sizes = keys[order], docs[order], parts[order], sizes[order].astype(np.int64)
        first = np.append(True, keys[1:] != keys[:-1])
        again = np.append(False, (keys[1:] == keys[:-1]) & (docs[1:] == docs[:-1]) & (parts[1:] == parts[:-1]))
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        columns = (docs, parts, sizes)
        leads = [column[lead][~again] for column in columns]
        keys, docs, parts, sizes, first = (column[~again] for column in (keys, *columns, first))
        for at in range(0, len(keys), _OUT):
            cut = slice(at, at + _OUT)
            yield batch_of(
                ARROW,
                [
                    pa.array(keys[cut].view(np.int64)),
                    pa.array(docs[cut]),
                    pa.array(parts[cut]),
                    pa.array(sizes[cut]),
                    *(pa.array(column[cut], mask=first[cut]) for column in leads),
                ],
            )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tie the leaders of one key, which come sorted, to the first; pass on the other rows."""
    last = None
    for batch in batches:
        entry = batch.column(4).is_null().to_numpy(zero_copy_only=False)
        out = [batch.filter(pa.array(~entry))] if not entry.all() else []
        at = np.flatnonzero(entry)
        if len(at):
            columns = [batch.column(i).to_numpy()[at] for i in range(4)]
            if last is not None:
                columns = [np.append(a, b) for a, b in zip(last, columns, strict=True)]
            key, doc, part, _ = columns
            first = np.append(True, key[1:] != key[:-1])
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            skip = len(key) - len(at)
            tied = np.flatnonzero(~first[skip:] & ((doc != doc[lead]) | (part != part[lead]))[skip:])
            rows, of = batch.take(pa.array(at[tied])), lead[skip:][tied]
            out.append(batch_of(ARROW, [*rows.columns[:4], *(pa.array(column[of]) for column in columns[1:])]))
            last = [column[lead[-1:]] for column in columns]
        yield from (rows for rows in out if rows.num_rows)
    release_memory()


def meet(entries: DataFrame) -> DataFrame:
    """Stars over all tasks, from the rows that ``LocalStars`` gave out.

    Rows without a leader are dealt by key; the others are finished and dealt by item,
    so that a key with very many items is no larger than the number of tasks. Keys
    that only one item holds give no row.
    """
    dealt = F.when(F.col("leader_doc").isNull(), F.col("key")).otherwise(F.xxhash64("key", "doc", "part"))
    return entries.repartition(dealt).sortWithinPartitions("key", "doc", "part").mapInArrow(_meet, SCHEMA)

"""Line reassembly on a stream of byte chunks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparrowline.functions.text import CLIENT_SPACE
from sparrowline.streaming.run import use_keyed_state

# A session without a chunk for this long has ended, as a closed connection has.
IDLE_MS = 300_000

# Sessions are dealt to so many groups. A call to the state takes longer than a chunk, so a group's
# sessions are read and written with one call for all.
GROUPS = 1024

_SESSIONS = (
    "sessions array<{kind}>, next_seq array<bigint>, line_no array<bigint>, remainder array<binary>, "
    "early array<array<bigint>>, ended array<boolean>, due array<bigint>, timer bigint, parcel bigint"
)
_EARLY = "sessions array<{kind}>, seqs array<bigint>, datas array<binary>, lasts array<boolean>"


_COLUMNS = ("_session", "seq", "data", "is_last")
_LINES = Row("_sessions", "line_nos", "lines")
# Chunks put together in a row for each group: so many, and of so many bytes.
_PACKED_ROWS, _PACKED_BYTES = 200_000, 16 << 20


def _packed(chunks: DataFrame, kind: str) -> DataFrame:
    """The chunks of a task as lists, one row for each group: rows cost more in Python than their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _PACKED_ROWS or sum(b.nbytes for b in held) >= _PACKED_BYTES:
                yield pack(held)
                held = []
        if any(batch.num_rows for batch in held):
            yield pack(held)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        group = whole.column("_group").to_numpy()
        order = np.argsort(group, kind="stable")
        group = group[order]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        offsets = pa.array(np.append(starts, len(group)), pa.int32())
        whole = whole.take(pa.array(order)).combine_chunks()
        lists = [pa.ListArray.from_arrays(offsets, whole.column(name).combine_chunks()) for name in _COLUMNS]
        return pa.RecordBatch.from_arrays([pa.array(group[starts]), *lists], names=["_group", *_COLUMNS])

    kinds = zip(_COLUMNS, (kind, "bigint", "binary", "boolean"), strict=True)
    return chunks.mapInArrow(run, "_group bigint, " + ", ".join(f"{name} array<{of}>" for name, of in kinds))


class _Session:
    """A session's place: the next chunk, the open line, and where its early chunks lie.

    ``early`` has pairs: the first of the chunks, and the parcel that holds them. ``fresh`` are
    chunks at hand that wait for their turn.
    """

    __slots__ = ("next_seq", "line_no", "open_line", "early", "ended", "due", "fresh")

    def __init__(self, next_seq=0, line_no=0, remainder=b"", early=(), ended=False, due=0):
        self.next_seq, self.line_no, self.open_line, self.ended, self.due = next_seq, line_no, [bytes(remainder)], ended, due
        self.early = sorted(zip(early[::2], early[1::2], strict=True))
        self.fresh = {}

    def add(self, seq, data, last) -> None:
        """A chunk to be used; what was used before is a repetition."""
        if seq >= self.next_seq:
            self.fresh[int(seq)] = (bytes(data), bool(last))

    def lines(self, take) -> Iterator[tuple[int, bytes]]:
        """Lines that chunks whose turn has come complete; ``take`` fetches early ones."""
        while not self.ended:
            if self.next_seq not in self.fresh:
                if not self.early or self.early[0][0] > self.next_seq:
                    break
                take(self, self.early.pop(0)[1])
                continue
            data, self.ended = self.fresh.pop(self.next_seq)
            self.next_seq += 1
            head, *tail = data.split(b"\n")
            self.open_line.append(head)
            for piece in tail:
                yield self.line_no, b"".join(self.open_line)
                self.line_no += 1
                self.open_line = [piece]

    def last_line(self) -> tuple[int, bytes]:
        line = self.line_no, b"".join(self.open_line)
        self.open_line, self.early, self.fresh, self.ended = [], [], {}, True
        return line


class _Lines(StatefulProcessor):
    """State of a group of sessions: their places, chunks that came before their turn, and a timer.

    Early chunks of a trigger are kept in one parcel as they came, which is read again once one of its
    sessions needs it, and goes with the last of them.

    A session ends with its chunk marked last, or when its time is due. It is then
    remembered for as long again, so chunks sent twice are known, and forgotten.
    """

    def __init__(self, kind: str, idle_ms: int):
        self.kind, self.idle_ms = kind, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", _SESSIONS.format(kind=self.kind))
        self.early = handle.getMapState("early", "parcel bigint", _EARLY.format(kind=self.kind))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sessions, timer, parcel = self._read()
        parcels, touched = {}, {}
        before = _parcels(sessions)

        for row in rows:
            found = []
            for name, seq, data, last in zip(*(row[column] for column in _COLUMNS), strict=True):
                session = touched.get(name)
                if session is None:
                    session = touched[name] = sessions.setdefault(name, _Session())
                if not session.ended:
                    session.add(seq, data, last)
                    found.extend((name, *line) for line in session.lines(self._taker(name, parcels)))
            yield from self._lines(found)
        found, now = [], timerValues.getCurrentProcessingTimeInMs()
        early = ([], [], [], [])
        for name, session in touched.items():
            session.due = now + self.idle_ms
            if session.ended:
                found.append((name, *session.last_line()))
            elif session.fresh:
                self._put_by(name, session, parcel, parcels, early)
        yield from self._lines(found)
        if early[0]:
            self.early.updateValue((parcel,), early)
        self._drop(before, sessions, parcels)
        self._write(sessions, timer, parcel + 1, timerValues)

    def _taker(self, name, parcels: dict):
        def take(session: _Session, parcel: int) -> None:
            if parcel not in parcels:
                held = parcels[parcel] = {}
                for of, *chunk in zip(*self.early.getValue((parcel,)), strict=True):
                    held.setdefault(of, []).append(chunk)
            for chunk in parcels[parcel].pop(name, ()):
                session.add(*chunk)

        return take

    def _put_by(self, name, session: _Session, parcel: int, parcels: dict, early: tuple[list, ...]) -> None:
        """Keep a session's chunks that came before their turn."""
        first = min(session.fresh)
        for at, (begin, of) in enumerate(session.early):
            if begin == first:
                del session.early[at]
                self._taker(name, parcels)(session, of)
                break
        session.early.append((first, parcel))
        early[0].extend([name] * len(session.fresh))
        early[1].extend(session.fresh)
        for data, last in session.fresh.values():
            early[2].append(data)
            early[3].append(last)
        session.fresh = {}

    def _drop(self, before: set[int], sessions: dict, parcels: dict) -> None:
        """Drop parcels that no session needs any more, and the larger part of those it was taken from."""
        needed = _parcels(sessions)
        for parcel in before - needed:
            self.early.removeKey((parcel,))
        for parcel, held in parcels.items():
            if parcel in needed and held:
                live = [(of, *chunk) for of, chunks in held.items() if any(p == parcel for _, p in _early(sessions, of)) for chunk in chunks]
                self.early.updateValue((parcel,), tuple(map(list, zip(*live, strict=True))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sessions, _, parcel = self._read()
        before, found, now = _parcels(sessions), [], timerValues.getCurrentProcessingTimeInMs()
        for name, session in [(n, s) for n, s in sessions.items() if s.due <= now]:
            if session.ended:
                del sessions[name]
                continue
            # Chunks behind a gap have no line number: they go with their session.
            found.append((name, *session.last_line()))
            session.due = now + self.idle_ms
        yield from self._lines(found)
        self._drop(before, sessions, {})
        self._write(sessions, None, parcel, timerValues)

    def close(self) -> None:
        pass

    def _read(self) -> tuple[dict, int | None, int]:
        """The group's sessions by name, its timer, and the number of its next parcel."""
        held = self.place.get()
        if not held:
            return {}, None, 0
        *columns, timer, parcel = held
        return {name: _Session(*place) for name, *place in zip(*columns, strict=True)}, timer, parcel

    def _write(self, sessions: dict, timer: int | None, parcel: int, timerValues) -> None:
        due = min((session.due for session in sessions.values()), default=None)
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.place.clear()
            return
        places = sessions.values()
        self.place.update(
            (
                [*sessions],
                [s.next_seq for s in places],
                [s.line_no for s in places],
                [b"".join(s.open_line) for s in places],
                [[*chain.from_iterable(s.early)] for s in places],
                [s.ended for s in places],
                [s.due for s in places],
                due,
                parcel,
            )
        )

    def _lines(self, found: list[tuple]) -> Iterator[Row]:
        """One row for all the lines (session, number, bytes) that are not blank."""
        lines = [(*of, text) for *of, data in found if (text := data.decode("utf-8", "replace").strip(CLIENT_SPACE))]
        if lines:
            yield _LINES(*map(list, zip(*lines, strict=True)))


def _early(sessions: dict, name) -> list[tuple[int, int]]:
    return sessions[name].early if name in sessions else []


def _parcels(sessions: dict) -> set[int]:
    return {parcel for session in sessions.values() for _, parcel in session.early}


def stream_lines(chunks: DataFrame, session: str = "session_id", idle_ms: int = IDLE_MS) -> DataFrame:
    """``(session, line_no, line)`` as lines are completed.

    ``chunks`` has ``(session, seq, data, is_last)`` with ``seq`` from 0. Chunks may come in
    any order and more than once. The chunk marked ``is_last`` completes the last line; a
    session that gets no chunk for ``idle_ms`` of processing time ends as well: its open line
    is given out, chunks behind one that never came are not. State goes ``idle_ms`` after
    the end; until then a repeated chunk gives nothing. Run it with a processing-time
    trigger, whose triggers also let timers run out when nothing arrives.
    """
    use_keyed_state(chunks.sparkSession)
    kind = chunks.schema[session].dataType.simpleString()
    group = F.pmod(F.xxhash64(session), F.lit(GROUPS)).alias("_group")
    columns = chunks.select(group, F.col(session).alias("_session"), F.col("seq").cast("bigint").alias("seq"), "data", "is_last")
    found = _packed(columns, kind).groupBy("_group").transformWithState(
        _Lines(kind, idle_ms), f"_sessions array<{kind}>, line_nos array<bigint>, lines array<string>", "append", "ProcessingTime"
    )
    return found.select(F.inline(F.arrays_zip("_sessions", "line_nos", "lines"))).toDF(session, "line_no", "line")

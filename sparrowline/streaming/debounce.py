"""Debounced saves on a stream of states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparrowline.streaming.run import use_keyed_state


class _Saves(StatefulProcessor):
    """Last updates of bursts that may still go on, and a timer that runs while nothing comes."""

    def __init__(self, kind: str, gap_us: int, delay_us: int, idle_ms: int):
        self.kind, self.gap_us, self.delay_us, self.idle_ms = kind, gap_us, delay_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"ts array<bigint>, seq array<bigint>, state array<{self.kind}>, top bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, top, timer = [], None, None
        if known := self.open.get():
            *lists, top, timer = known
            held = list(zip(*lists, strict=True))
        # What is older than the delay allows belongs to a burst that has been given out.
        since = None if top is None else top - self.delay_us - self.gap_us
        for batch in rows:
            for ts, seq, state in zip(batch["us"], batch["place"], batch["value"], strict=True):
                if since is None or ts >= since:
                    held.append((int(ts), int(seq), state))
        held.sort(key=lambda update: update[:2])
        # An update that another one follows within the gap is not saved, whatever comes.
        held = [u for u, v in zip(held, [*held[1:], None], strict=True) if v is None or v[0] - u[0] > self.gap_us]
        if held:
            top = held[-1][0] if top is None else max(top, held[-1][0])
        done = [u for u in held if u[0] + self.gap_us < top - self.delay_us]
        held = held[len(done) :]
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(timer)
        self.open.update(([u[0] for u in held], [u[1] for u in held], [u[2] for u in held], top, timer))
        if done:
            yield self._frame(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        times, seqs, states, _, _ = self.open.get()
        self.open.clear()
        if len(times):
            yield self._frame(key, list(zip(times, seqs, states, strict=True)))

    def close(self) -> None:
        pass

    def _frame(self, key: tuple, updates: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], ts, state) for ts, _, state in updates], columns=["owner", "us", "value"])


def stream_debounce(
    updates: DataFrame,
    gap_ms: int = 300,
    delay_ms: int = 0,
    idle_ms: int | None = None,
    key: str = "session_id",
    ts: str = "ts",
    seq: str = "seq",
    state: str = "state",
) -> DataFrame:
    """``(key, ts, state)`` of the last update before each pause over ``gap_ms``.

    A pause shows in one of two ways: a later update of the key, more than the gap and
    ``delay_ms`` on by its own time, or no update of the key for ``idle_ms`` of processing
    time (the gap, if not given), after which the key's state is gone. Updates of a key may
    be out of order by up to ``delay_ms``; older ones are left out. Of updates with one time,
    the one with the greatest ``seq`` counts.
    """
    use_keyed_state(updates.sparkSession)
    kinds = {name: updates.schema[name].dataType.simpleString() for name in (key, state)}
    rows = updates.select(
        F.col(key).alias("owner"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(seq).cast("bigint").alias("place"),
        F.col(state).alias("value"),
    )
    saves = _Saves(kinds[state], gap_ms * 1000, delay_ms * 1000, gap_ms if idle_ms is None else idle_ms)
    given = rows.groupBy("owner").transformWithStateInPandas(
        saves, f"owner {kinds[key]}, us bigint, value {kinds[state]}", "append", "ProcessingTime"
    )
    return given.select(F.col("owner").alias(key), F.timestamp_micros("us").alias(ts), F.col("value").alias(state))

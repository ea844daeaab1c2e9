"""Zero counts on a stream: once a key has been seen, every later window of it comes out, with a 0 where nothing was counted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mentionflow.functions.times import micros
from mentionflow.operators.windows import SLIDE

EXPIRY = "7 days"
BATCH_ROWS = 10_000


class _Slots(StatefulProcessor):
    """State per key: the start of the next window due, the length of its windows and the start of the last one counted,
    in microseconds. A timer at the end of the next window tells that it has come out or is empty."""

    def __init__(self, step: int, expiry: int, key: str) -> None:
        self.step, self.expiry, self.key = step, expiry, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", T.StructType([T.StructField(n, T.LongType()) for n in ("next", "length", "seen")]))

    def _rows(self, key: tuple, found: list[tuple[int, int, int]]) -> pd.DataFrame:
        starts, lengths, counts = zip(*found, strict=True)
        return pd.DataFrame({"start": starts, "length": lengths, self.key: [key[0]] * len(found), "count": counts})

    def _out(self, key: tuple, slots: Iterator[tuple[int, int, int]]) -> Iterator[pd.DataFrame]:
        held = []
        for slot in slots:
            held.append(slot)
            if len(held) >= BATCH_ROWS:
                yield self._rows(key, held)
                held = []
        if held:
            yield self._rows(key, held)

    def _wait(self, state: tuple[int, int, int], before: tuple[int, int, int] | None) -> None:
        self.due.update(state)
        if before is not None:
            self.handle.deleteTimer(-(-(before[0] + before[1]) // 1000))
        self.handle.registerTimer(-(-(state[0] + state[1]) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = self.due.get() if self.due.exists() else None
        counted = sorted((int(s), int(n), int(c)) for df in rows for s, n, c in zip(df["start"], df["length"], df["count"], strict=True))

        def slots() -> Iterator[tuple[int, int, int]]:
            following = None if state is None else state[0]
            for start, length, count in counted:
                while following is not None and following < start:
                    yield following, length, 0
                    following += self.step
                yield start, length, count
                following = start + self.step if following is None else max(following, start + self.step)

        yield from self._out(key, slots())
        last, length, _ = counted[-1]
        following = last + self.step if state is None else max(state[0], last + self.step)
        self._wait((following, length, last), state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if not self.due.exists():
            return
        following, length, seen = state = tuple(self.due.get())
        now = timerValues.getCurrentWatermarkInMs() * 1000
        until = min(now - length, seen + self.expiry)  # the last start that is due
        n = max(0, (until - following) // self.step + 1)
        yield from self._out(key, ((following + i * self.step, length, 0) for i in range(n)))
        following += n * self.step
        if following > seen + self.expiry:
            self.due.clear()
        else:
            self._wait((following, length, seen), state)

    def close(self) -> None:
        pass


def zero_filled_stream(counts: DataFrame, slide: str = SLIDE, key: str = "mention", expiry: str = EXPIRY) -> DataFrame:
    """Closed windows of ``windows.sliding_count(..., timed=True)``, and a 0 row for every later one of a key
    as the watermark passes its end. A key that has not been counted for ``expiry`` is forgotten: its
    windows stop, and begin again when it is seen again. The slots of a key lie a slide apart.

    Needs the RocksDB state store."""
    start = F.unix_micros("window_start")
    rows = counts.select(
        key, start.alias("start"), (F.unix_micros("window_end") - start).alias("length"), "count", "window_time"
    )
    schema = T.StructType([
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField(key, T.StringType()), T.StructField("count", T.LongType()),
    ])
    slots = rows.groupBy(key).transformWithStateInPandas(_Slots(micros(slide), micros(expiry), key), schema, "append", "eventTime")
    begin = F.col("start")
    return slots.select(
        F.timestamp_micros(begin).alias("window_start"), F.timestamp_micros(begin + F.col("length")).alias("window_end"), key, "count"
    )

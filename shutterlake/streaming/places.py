"""Places of a stream's rows, filled in by session, with state that grows by what arrives.

State is a list of a key's open rows, to which a batch appends its own, and one timer a key, not later than the end of its first open session. The list is
read only when the timer fires; what has ended then goes out at once, and the timer is set to the next end. Spark keeps lists and timers in RocksDB: start
such a stream inside ``list_state``, or set that provider for the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROW = "t long, id long, place string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def list_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def session_ends(times: np.ndarray, gap: int, last: int | None) -> tuple[list[int], bool]:
    """The times at which sessions of new rows end for now, without those inside the session that ends at ``last``; and whether the new rows go on with that session."""
    t = np.unique(times)
    ends = t[np.append(np.diff(t) > gap, True)]
    if last is None:
        return ends.tolist(), False
    later = t[t > last]
    return ends[(ends > last) | (ends < last - gap)].tolist(), len(later) > 0 and later[0] - last <= gap


def best_place(session: list[tuple]) -> str | None:
    """The most frequent place of a session's rows ``(t, id, place)``, t in microseconds; of equals the one seen in the first second, then the least."""
    seen: dict[str, list[int]] = {}
    for t, _, place in session:
        if place is not None:
            own = seen.setdefault(place, [0, t // 1_000_000])
            own[0], own[1] = own[0] + 1, min(own[1], t // 1_000_000)
    return min(seen, key=lambda p: (-seen[p][0], seen[p][1], p), default=None)


class OpenSessions(StatefulProcessor):
    def __init__(self, key: str, gap_s: int) -> None:
        self.key, self.gap = key, gap_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ROW)
        self.span = handle.getValueState("span", "first long, last long")  # at most the end of the first open session, and the last row

    def _timer(self, end: int) -> int:
        return (end + self.gap) // 1000 + 1

    def _wait(self, first: int, last: int, before: int | None) -> None:
        if before is None or self._timer(before) != self._timer(first):
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.handle.registerTimer(self._timer(first))
        self.span.update((first, last))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if frame.empty:
                continue
            t = frame["epoch_micros_of_row"].to_numpy()
            self.rows.appendList([(a, None if pd.isna(b) else int(b), None if pd.isna(c) else c) for a, b, c in zip(t.tolist(), frame["id"], frame["place"], strict=True)])
            first, last = self.span.get() if self.span.exists() else (None, None)
            ends, goes_on = session_ends(t, self.gap, last)
            # sessions only grow, so none ends before these; a lone one that goes on takes its timer along
            least = min(ends if first is None or (goes_on and first == last) else [*ends, first])
            self._wait(least, max(int(t.max()), least if last is None else last), first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        sessions: list[list[tuple]] = []
        for row in sorted(map(tuple, self.rows.get()), key=lambda r: r[0]):
            if sessions and row[0] - sessions[-1][-1][0] <= self.gap:
                sessions[-1].append(row)
            else:
                sessions.append([row])
        still = [x for x in sessions if x[-1][0] + self.gap >= now]
        if not still:
            self.rows.clear()
            self.span.clear()
        else:
            if len(still) < len(sessions):
                self.rows.put([r for x in still for r in x])
            self._wait(still[0][-1][0], still[-1][-1][0], None)
        ids, named = [], []
        for session in sessions[: len(sessions) - len(still)]:
            best = best_place(session)
            ids += [i for _, i, _ in session]
            named += [best if p is None else p for _, _, p in session]
        if ids:
            yield pd.DataFrame({self.key: key[0], "id": pd.array(ids, dtype="Int64"), "place": pd.Series(named, dtype=object)})

    def close(self) -> None:
        pass


def stream_propagated(df: DataFrame, key: str, ts: str = "ts", gap_s: int = 12_600, delay: str = "1 hour") -> DataFrame:
    """Rows ``(key, id, place)`` of ``df(key, ts, id, place)`` with the most frequent place of their session filled in, given out once event time is a gap past its last row. State holds the rows of the open sessions of a key, which the gap bounds. Rows without a time are left out."""
    form = f"{key} {dict(df.dtypes)[key]}, id long, place string"
    own = df.filter(F.col(ts).isNotNull()).select(key, ts, "id", "place", F.unix_micros(F.col(ts).cast("timestamp")).alias("epoch_micros_of_row"))  # pandas would show local times; names with a leading underscore get lost on the way
    return own.withWatermark(ts, delay).groupBy(key).transformWithStateInPandas(OpenSessions(key, gap_s), form, "append", "eventTime")

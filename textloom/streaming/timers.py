"""Streams with timers: idle sessions closed by event time, debounce, stored values that expire.

The processors keep typed state and need the state store of RocksDB (`use_rocksdb`).  Outcomes by event time do not depend on how rows are cut
into batches or, within the watermark's delay, on their order; later rows are left out by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "key string, first long, last long, n long"
SETTLED = "key string, us long, tie long"
LOADED = "key string, seq long, value string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _IdleClose(StatefulProcessor):
    """Open sessions of a key by their first event; late rows may lengthen or join them until the watermark is past their end."""

    def __init__(self, idle_us: int) -> None:
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "first long", "last long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        spans = [(k[0], v[0], v[1]) for k, v in self.open.iterator()]
        old = {s[0] for s in spans}
        for pdf in rows:
            counts = pdf["us"].value_counts()
            spans += [(int(us), int(us), int(n)) for us, n in counts.items()]
            spans = self._joined(spans)
        for first, last, n in spans:
            self.open.updateValue((first,), (last, n))
            self.handle.registerTimer((last + self.idle) // 1000 + 1)
        for first in old - {s[0] for s in spans}:
            self.open.removeKey((first,))
        return iter([])

    def _joined(self, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for first, last, n in sorted(spans):
            if out and first - out[-1][1] <= self.idle:
                begun, until, so_far = out.pop()
                first, last, n = begun, max(last, until), n + so_far
            out.append((first, last, n))
        return out

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        done = [(k[0], v[0], v[1]) for k, v in self.open.iterator() if v[0] + self.idle < now]
        for first, _, _ in done:
            self.open.removeKey((first,))
        if done:
            yield pd.DataFrame([(key[0], *s) for s in sorted(done)], columns=["key", "first", "last", "n"])

    def close(self) -> None:
        pass


class _Debounce(StatefulProcessor):
    """Events of a key that no later event has replaced yet, and those that a late one may still have to be measured against."""

    def __init__(self, quiet_us: int) -> None:
        self.quiet = quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "us long, tie long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for us, tie in zip(pdf["us"].tolist(), pdf["tie"].tolist(), strict=True):
                self.seen.updateValue((us, tie), (1,))
                self.handle.registerTimer((us + self.quiet) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(k for k, _ in self.seen.iterator())
        out = []
        for i, (us, tie) in enumerate(events):
            if us + self.quiet < now:
                if i + 1 == len(events) or us + self.quiet <= events[i + 1][0]:
                    out.append((key[0], us, tie))
                self.seen.removeKey((us, tie))
        if out:
            yield pd.DataFrame(out, columns=["key", "us", "tie"])

    def close(self) -> None:
        pass


class _Stored(StatefulProcessor):
    """One value a key, forgotten `ttl_ms` after it was saved."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        out = []
        now = self.value.get() if self.value.exists() else None
        changed = False
        for seq, cmd, value in sorted((r for pdf in rows for r in zip(pdf["seq"].tolist(), pdf["cmd"].tolist(), pdf["value"].tolist(), strict=True)), key=lambda r: r[0]):
            if cmd == "load":
                out.append((key[0], seq, now[0] if now is not None else None))
            else:
                now, changed = ((value,) if cmd == "save" else None), True
        if changed and now is not None:
            self.value.update(now)
        elif changed:
            self.value.clear()
        yield pd.DataFrame(out, columns=["key", "seq", "value"]).astype({"seq": "int64"})

    def close(self) -> None:
        pass


def _timed(events: DataFrame, key: str, ts: str, tie: str, late: str) -> DataFrame:
    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("tie"))
    return rows.withWatermark("ts", late)


def closed_sessions(events: DataFrame, key: str, ts: str, tie: str, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """(key, first, last, n) of every session of a stream, in microseconds, once the watermark is more than `minutes` past its last event.

    Rows without a key or time are left out.  The same as groups of sessions.idle_sessions() over the finished table.
    """
    rows = _timed(events, key, ts, tie, late)
    return rows.groupBy("key").transformWithStateInPandas(_IdleClose(minutes * 60_000_000), CLOSED, "Append", "EventTime")


def debounced(events: DataFrame, key: str, ts: str, tie: str, quiet_ms: int, late: str = "10 minutes") -> DataFrame:
    """(key, us, tie) of events after which the key was quiet for `quiet_ms`: as sessions.settled() over the finished table; a repeated (ts, tie) is one event."""
    rows = _timed(events, key, ts, tie, late)
    return rows.groupBy("key").transformWithStateInPandas(_Debounce(quiet_ms * 1000), SETTLED, "Append", "EventTime")


def stored(commands: DataFrame, ttl_ms: int) -> DataFrame:
    """(key, seq, value) of every load of a stream (key, seq, cmd, value) of saves, loads and clears; null where nothing is stored or it has expired."""
    return commands.groupBy("key").transformWithStateInPandas(_Stored(ttl_ms), LOADED, "Append", "ProcessingTime")

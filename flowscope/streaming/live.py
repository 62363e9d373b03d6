"""Event time, timers and joins of streams: what arrives out of order gives what the batch gives, as far as it isn't late.

Rows wait in state until the watermark has passed them, so a session's rows are taken in the order of their time whatever the
micro-batch they came in. Rows behind the watermark are late: Spark drops them before they get here and counts them
(numRowsDroppedByWatermark). The state needs the RocksDB provider (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Name of Spark's own provider of state with maps and timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _InOrder(StatefulProcessor):
    """Keeps a session's rows until the watermark has passed them and hands them over in the order of time, then number.

    A timer at the last row's time and ``idle_ms`` more ends the session: what it leaves goes and its state with it.
    """

    columns: list[str] = []

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        value = ", ".join(f"{c} double" for c in self.columns)
        self.waiting = handle.getMapState("waiting", "ts_ms long, no long", value)
        self.newest = handle.getValueState("newest", "ts_ms long")
        self.open(handle)

    def open(self, handle) -> None:
        """More state."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        times = set()
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                self.waiting.updateValue((int(r.ts_ms), int(r.no)), tuple(float(getattr(r, c)) for c in self.columns))
                times.add(int(r.ts_ms))
        for t in times:
            self.handle.registerTimer(t)
        if times and (newest is None or max(times) > newest):
            if newest is not None:
                self.handle.deleteTimer(newest + self.idle_ms)
            newest = max(times)
            self.newest.update((newest,))
            self.handle.registerTimer(newest + self.idle_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k for k in self.waiting.keys() if k[0] <= now), key=tuple)
        rows = [(*map(int, k), *self.waiting.getValue(k)) for k in due]
        for k in due:
            self.waiting.removeKey(k)
        out = list(self.taken(key, rows))
        if self.newest.exists() and now >= self.newest.get()[0] + self.idle_ms:
            out += self.ended(key)
            self.newest.clear()
        yield self.frame(out)

    def taken(self, key, rows):
        raise NotImplementedError

    def ended(self, key):
        return []

    def frame(self, rows):
        raise NotImplementedError


class Keyframes(_InOrder):
    """``timeline.keyframes`` row by row: the frame before, the last keyframe, and whether the frame before was one."""

    columns = ["changed_pct"]

    def __init__(self, pct_over: float, shortest: int, longest: int, idle_ms: int):
        super().__init__(idle_ms)
        self.pct_over, self.shortest, self.longest = pct_over, shortest, longest

    def open(self, handle) -> None:
        self.last = handle.getValueState("last", "key_ms long, before_ms long, before_no long, is_key boolean")

    def taken(self, key, rows):
        state = tuple(self.last.get()) if self.last.exists() else None
        for ts, no, pct in rows:
            if state is None:
                why, key_ms = "first", ts
            else:
                key_ms, before, *_ = state
                enough = ts - before >= self.shortest
                why = None if not enough else "change" if pct > self.pct_over else "forced" if ts - key_ms > self.longest else None
            if why:
                key_ms = ts
                yield key[0], no, why
            state = (key_ms, ts, no, bool(why))
        if state is not None:
            self.last.update(state)

    def ended(self, key):
        state = tuple(self.last.get()) if self.last.exists() else None
        self.last.clear()
        return [] if state is None or state[3] else [(key[0], state[2], "last")]

    def frame(self, rows):
        return pd.DataFrame(rows, columns=["session", "frame_no", "reason"]).astype({"session": "int64", "frame_no": "int64", "reason": object})


def keyframes(
    frames: DataFrame, late: str = "10 seconds", pct_over: float = 30.0, shortest: int = 50, longest: int = 2000, idle_ms: int = 60_000
) -> DataFrame:
    """(session, frame_no, reason) of a stream of frames (session, frame_no, ts, changed_pct; the first frame's null).

    A session's keyframes are those of ``timeline.keyframes`` on its frames in order of ts, if none comes later than ``late``;
    its last one is told when no frame has come for ``idle_ms``. Frames after that begin a session anew.
    """
    ms = F.unix_millis("ts").alias("ts_ms")
    cols = frames.withWatermark("ts", late).select("session", "ts", ms, F.col("frame_no").alias("no"), F.coalesce("changed_pct", F.lit(0.0)).alias("changed_pct"))
    return cols.groupBy("session").transformWithStateInPandas(
        Keyframes(pct_over, shortest, longest, idle_ms), "session long, frame_no long, reason string", "Append", "EventTime"
    )


class Ring(_InOrder):
    """A ring buffer: the last rows by time, each in a map of its own place, so a row costs no copy of the others."""

    columns = ["bytes"]

    def __init__(self, capacity: int, idle_ms: int):
        super().__init__(idle_ms)
        self.capacity = capacity

    def open(self, handle) -> None:
        self.held = handle.getMapState("held", "place long", "no long, ts_ms long, bytes double")
        self.seen = handle.getValueState("seen", "n long")

    def taken(self, key, rows):
        n = self.seen.get()[0] if self.seen.exists() else 0
        for ts, no, size in rows:
            self.held.updateValue((n % self.capacity,), (no, ts, size))
            n += 1
        if rows:
            self.seen.update((n,))
        return []

    def ended(self, key):
        n = self.seen.get()[0] if self.seen.exists() else 0
        kept = [tuple(self.held.getValue((i % self.capacity,))) for i in range(max(0, n - self.capacity), n)]
        self.held.clear()
        self.seen.clear()
        if not n:
            return []
        return [(key[0], len(kept), n - len(kept), kept[0][1], kept[-1][1], int(sum(r[2] for r in kept)))]

    def frame(self, rows):
        return pd.DataFrame(rows, columns=["session", "held", "dropped", "oldest", "newest", "bytes"]).astype("int64")


def rings(rows: DataFrame, capacity: int, late: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """(session, held, dropped, oldest, newest, bytes) of each session's ring buffer when it ends: rows (session, no, ts, bytes) in
    order of ts, at its capacity the oldest goes.
    """
    cols = rows.withWatermark("ts", late).select("session", "ts", F.unix_millis("ts").alias("ts_ms"), "no", F.col("bytes").cast("double").alias("bytes"))
    ddl = "session long, held long, dropped long, oldest long, newest long, bytes long"
    return cols.groupBy("session").transformWithStateInPandas(Ring(capacity, idle_ms), ddl, "Append", "EventTime")


def candidates(events: DataFrame, slices: DataFrame, before_ms: int, longest_ms: int, late: str = "10 seconds") -> DataFrame:
    """Events (session, id, ts) with the slices (session, segment, start, end) that they may explain, as both arrive.

    An event goes with a slice from ``before_ms`` before its start to its end. Both sides carry watermarks, and a slice lasts
    ``longest_ms`` at most (a longer one is an error), so an event is forgotten once slices that far ahead have come, a slice
    once events have passed its end.
    """
    ms = lambda n: F.expr(f"INTERVAL {n} MILLISECONDS")
    checked = F.when(F.col("end") <= F.col("start") + ms(longest_ms), F.col("end")).otherwise(
        F.raise_error(F.concat(F.lit(f"a slice of more than {longest_ms} ms: "), F.col("segment").cast("string"))).cast("timestamp")
    )
    left = events.select("session", "id", "ts").withWatermark("ts", late).alias("e")
    right = slices.select("session", "segment", "start", checked.alias("end")).withWatermark("end", late).alias("s")
    near = (F.col("e.ts") >= F.col("s.end") - ms(longest_ms + before_ms)) & (F.col("e.ts") <= F.col("s.end"))
    exact = F.col("e.ts") >= F.col("s.start") - ms(before_ms)
    both = left.join(right, (F.col("e.session") == F.col("s.session")) & near & exact)
    return both.select("e.session", "e.id", "e.ts", "s.segment", "s.start", "s.end")

"""Progress snapshots by the clock, with keyed state and timers.

Events are (client_key, scan_id, ts, listed, done, ended). From a scan's first event on a
snapshot is due every so many seconds, and one final snapshot at the event that
ends the scan. Time is event time, so a replay gives what the live stream gave: a
timer stands at the next tick, and when the watermark has passed it, the snapshot counts all
events up to the tick. Each scan of a client has a state of its own, so counters begin at
zero with every new scan. Between ticks state holds one pair of sums for each tick that
is still to come, not the events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SNAPSHOT = "client_key string, scan_id long, ts timestamp, processed_count long, active_count long, elapsed_in_sec long, final boolean"
EVERY, LATE = 5, "10 minutes"
#: In place of the ticks of a scan that had its final snapshot.
OVER = -1


class Ticker(StatefulProcessor):
    """State of one (client_key, scan_id): its start and end in ms, the counts so far, its timer, and what waits for its tick.

    All of it is one value, as each call of the state store is a round trip out of Python: a
    batch costs a scan one read and one write. What waits are rows (tick, processed, active) in order of ticks, as bytes.
    """

    def __init__(self, every: int):
        self.every = every * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scan = handle.getValueState("scan", "start long, end long, ticks long, processed long, active long, wake long, waiting binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, end, ticks, processed, active, wake, waiting = self.scan.get() or (None, -1, 0, 0, 0, None, b"")
        if ticks == OVER:
            return iter([])
        ms, listed, done, ended = (np.concatenate(c) for c in zip(*([r[c].to_numpy() for c in ("ms", "listed", "done", "ended")] for r in rows), strict=True))
        held = _unpacked(waiting)
        first = int(ms.min())
        if start is None:
            start = first
        elif first < start:  # an event from before the start moves it; what waits moves to its new ticks
            more = (start - first) // self.every
            held[:, 0] += more
            ticks += more
            start = first
        if ended.any():
            end = int(ms[ended].max())
        due = np.maximum(-((start - ms) // self.every), 1)
        held = _summed(np.concatenate([held, np.column_stack([due, done, listed - done])]))
        self.scan.update((start, end, ticks, processed, active, self._wake(start, end, ticks, wake), held.tobytes()))
        return iter([])

    def _wake(self, start: int, end: int, ticks: int, wake: int | None = None) -> int:
        """One timer in place of ``wake``, at the next tick or at the end, whichever comes first."""
        at = start + (ticks + 1) * self.every
        at = min(at, end) if end >= 0 else at
        if at != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(at)
        return at

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        start, end, ticks, processed, active, _, waiting = self.scan.get()
        if ticks == OVER:
            self.scan.clear()
            return
        held = _unpacked(waiting)
        last = (now - 1 - start) // self.every  # the last tick that the watermark has passed
        over = 0 <= end < now
        if over:
            last = (end - 1 - start) // self.every
        tick = np.arange(ticks + 1, last + 1)
        passed = np.searchsorted(held[:, 0], tick, "right")
        sums = np.concatenate([[[processed, active]], held[:, 1:]]).cumsum(axis=0)  # before the first row, and after each
        at, counts = start + tick * self.every, sums[passed]
        if over:
            at, counts = np.append(at, end), np.concatenate([counts, sums[-1:]])
            # late events may still pass until the watermark has moved once more
            self.scan.update((start, end, OVER, 0, 0, now + 1, b""))
            self.handle.registerTimer(now + 1)
        else:
            n = int(np.searchsorted(held[:, 0], last, "right"))
            ticks = max(ticks, last)
            self.scan.update((start, end, ticks, *sums[n].tolist(), self._wake(start, end, ticks), held[n:].tobytes()))  # Spark deletes the timer that woke it
        if len(at):
            final = np.zeros(len(at), bool)
            final[-1] = over
            yield pd.DataFrame({"client_key": key[0], "scan_id": key[1], "ts": pd.to_datetime(at, unit="ms", utc=True), "processed_count": counts[:, 0], "active_count": counts[:, 1], "elapsed_in_sec": (at - start) // 1000, "final": final})

    def close(self) -> None:
        pass


def _unpacked(waiting: bytes) -> np.ndarray:
    return np.frombuffer(waiting, np.int64).reshape(-1, 3).copy()


def _summed(held: np.ndarray) -> np.ndarray:
    """One row for each tick, in order of ticks."""
    held = held[np.argsort(held[:, 0], kind="stable")]
    firsts = np.flatnonzero(np.diff(held[:, 0], prepend=held[0, 0] - 1))
    return np.column_stack([held[firsts, 0], np.add.reduceat(held[:, 1:], firsts)])


def _clean(events: DataFrame) -> DataFrame:
    return events.filter("client_key IS NOT NULL AND scan_id IS NOT NULL AND ts IS NOT NULL").select(
        "client_key",
        F.col("scan_id").cast("long").alias("scan_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.coalesce(F.col("listed").cast("long"), F.lit(0)).alias("listed"),
        F.coalesce(F.col("done").cast("long"), F.lit(0)).alias("done"),
        F.coalesce("ended", F.lit(False)).alias("ended"),
    )


def ticks(events: DataFrame, every: int = EVERY, late: str = LATE) -> DataFrame:
    """SNAPSHOT rows of a stream of events. Run it with the RocksDB state store.

    Rows without a client, scan or time are left out. An event later than ``late``
    behind the newest one is dropped, as the watermark says. What comes in after a
    scan's final snapshot is ignored. A scan without an end ticks on as time goes.
    """
    keyed = _clean(events).withWatermark("ts", late).groupBy("client_key", "scan_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Ticker(every), outputStructType=SNAPSHOT, outputMode="Append", timeMode="EventTime")


def ticks_of(events: DataFrame, every: int = EVERY, late_ms: int = 600_000) -> DataFrame:
    """The same snapshots from events at rest, as a batch: sums by tick, then a running sum over a scan's ticks."""
    e = _clean(events)
    now = e.agg(F.max("ms").alias("_now"))
    scan = e.groupBy("client_key", "scan_id").agg(F.min("ms").alias("start"), F.max(F.when(F.col("ended"), F.col("ms"))).alias("end"))
    scan = scan.crossJoin(F.broadcast(now)).withColumn("now", F.col("_now") - late_ms)  # one row
    over = F.coalesce(F.col("end") < F.col("now"), F.lit(False))
    last = F.floor((F.when(over, F.col("end")).otherwise(F.col("now")) - 1 - F.col("start")) / (every * 1000))
    due = scan.withColumns({"over": over, "last": F.greatest(last, F.lit(0))})
    ticked = due.select("client_key", "scan_id", "start", F.explode(F.when(F.col("last") > 0, F.sequence(F.lit(1).cast("long"), "last")).otherwise(F.array().cast("array<long>"))).alias("tick"))
    marks = ticked.select("client_key", "scan_id", "start", "tick", (F.col("start") + F.col("tick") * every * 1000).alias("at"), F.lit(False).alias("final"))
    marks = marks.union(due.filter("over").select("client_key", "scan_id", "start", F.col("last") + 1, "end", F.lit(True)))
    tick = F.greatest(F.lit(1), F.ceil((F.col("ms") - F.col("start")) / (every * 1000)))
    placed = e.join(due.select("client_key", "scan_id", "start", "last", "over"), ["client_key", "scan_id"]).withColumn("tick", tick)
    sums = placed.withColumn("tick", F.when(F.col("over"), F.least("tick", F.col("last") + 1)).otherwise(F.col("tick"))).groupBy("client_key", "scan_id", "tick").agg(F.sum("done").alias("done"), F.sum(F.col("listed") - F.col("done")).alias("more"))
    w = Window.partitionBy("client_key", "scan_id").orderBy("tick")
    both = marks.join(sums, ["client_key", "scan_id", "tick"], "left")
    count = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(w)
    return both.select("client_key", "scan_id", F.timestamp_millis("at").alias("ts"), count("done").alias("processed_count"), count("more").alias("active_count"), F.call_function("div", F.col("at") - F.col("start"), F.lit(1000)).alias("elapsed_in_sec"), "final")

"""Removal of what nobody has open, as a stream with a timer for each conversion.

A visit sets the timer to the moment from which the batch rule (presence.expired) holds; leaving shortens it, being read lengthens it, a kept
conversion has none. When the timer fires, the removal is emitted and the state goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

AWAY, GRACE, STUCK = timedelta(minutes=15), timedelta(minutes=1), timedelta(hours=1)
_EPOCH = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)


def needs_state_store(spark: SparkSession) -> None:
    """ValueError unless the session keeps state where timers and typed state can live."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(t: datetime) -> int:
    return (pd.Timestamp(t).tz_localize(None).to_pydatetime() - _EPOCH) // _MICRO


class Retention(StatefulProcessor):
    """State of one conversion, all times in microseconds: when it was made, when it was last seen, by which event, its status, and whether it is kept."""

    def __init__(self, away: timedelta, grace: timedelta, stuck: timedelta, event_time: bool):
        self.away, self.grace, self.stuck, self.event_time = away // _MICRO, grace // _MICRO, stuck // _MICRO, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("conversion", "created long, seen long, at long, event long, status string, status_at long, status_event long, keep boolean")

    def due(self, created: int, seen: int, status: str | None, keep: bool) -> int | None:
        """The first microsecond at which it is to go (the rule is strict), null for a kept one."""
        if keep:
            return None
        return max(seen + self.away, created + self.stuck if status == "reading" else 0) + 1

    def _timer(self, due: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))  # timers count milliseconds

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        created, seen, at, event, status, status_at, status_event, keep = self.value.get() if self.value.exists() else (None, 0, None, None, None, None, None, False)
        for part in rows:
            for r in part.itertuples(index=False):
                t, n = _micros(r.ts), int(r.event_id)
                created = t if created is None else min(created, t)
                keep = keep or bool(r.keep)
                if r.kind in ("seen", "left"):
                    if at is None or (t, n) > (at, event):
                        at, event, seen = t, n, t - self.away + self.grace if r.kind == "left" else t
                elif status_at is None or (t, n) > (status_at, status_event):
                    status_at, status_event, status = t, n, r.kind
        if at is None:  # made, and not seen yet: its making counts
            seen = created
        self.value.update((created, seen, at, event, status, status_at, status_event, keep))
        self._timer(self.due(created, seen, status, keep))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        created, seen, _, _, status, _, _, keep = self.value.get()
        due = self.due(created, seen, status, keep)
        now = 1000 * (timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs())
        if due is None:
            return
        if due > now:
            self._timer(due)
            return
        self.value.clear()
        gone = _EPOCH + timedelta(microseconds=due)
        yield pd.DataFrame({"id": [key[0]], "due": pd.Series([gone.replace(tzinfo=UTC)])})


def removals(visits: DataFrame, away: timedelta = AWAY, grace: timedelta = GRACE, stuck: timedelta = STUCK, event_time: bool = False, late: str = "0 seconds") -> DataFrame:
    """(id, due): conversions to delete, and from when, in append mode.

    visits: (id long, event_id long, ts, kind, keep boolean), a stream. kind: seen, left, or a status (reading, ready, failed); the last by (ts, event_id)
    counts, of presence and of status each. keep: set by any row, it stays. event_time: the clock is the watermark on ts, else the machine's. One
    timer and one small state a conversion; nothing is kept of one that has gone, so a later visit begins a new one. At any moment of the clock, what was
    emitted by then is what presence.expired selects for that moment, if no row is late by the watermark.
    """
    needs_state_store(visits.sparkSession)
    rows = visits.withWatermark("ts", late) if event_time else visits
    processor = Retention(away, grace, stuck, event_time)
    return rows.select("id", "event_id", "ts", "kind", "keep").groupBy("id").transformWithStateInPandas(processor, "id long, due timestamp", "Append", "EventTime" if event_time else "ProcessingTime")

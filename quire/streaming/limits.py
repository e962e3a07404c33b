"""The hourly limit in the order of event time, whatever the order in which posts arrive."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.operators.presence import untrapped
from quire.streaming.retention import needs_state_store

_EPOCH, _MILLI = datetime(1970, 1, 1), timedelta(milliseconds=1)


class OrderedLimit(StatefulProcessor):
    """Of one form, visitor and hour: the posts that wait for the watermark, and how many have been decided."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, event_id long")
        self.decided = handle.getValueState("decided", "n long")
        self.done = handle.getValueState("done", "watermark long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(r.ts, int(r.event_id)) for part in rows for r in part.itertuples(index=False)]
        self.waiting.appendList(new)
        for ms in {self._ms(t) for t, _ in new}:
            self.handle.registerTimer(ms)
        yield from ()

    @staticmethod
    def _ms(t) -> int:
        """The first whole millisecond from t on: when the watermark is past it, no post of t or before can come."""
        return -((_EPOCH - pd.Timestamp(t).tz_localize(None).to_pydatetime()) // _MILLI)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, over = timerValues.getCurrentWatermarkInMs(), (int(key[2]) + 1) * 3_600_000
        if self.done.exists() and self.done.get()[0] == mark:  # the first timer of a batch releases all that are due
            return
        waiting = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (pd.Timestamp(x[0]), x[1])) if self.waiting.exists() else []
        ready = [x for x in waiting if self._ms(x[0]) <= mark]
        n = self.decided.get()[0] if self.decided.exists() else 0
        if mark >= over:  # no post of this hour can come any more
            for state in (self.waiting, self.decided, self.done):
                state.clear()
        else:
            rest = waiting[len(ready) :]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            self.decided.update((n + len(ready),))
            self.done.update((mark,))
            self.handle.registerTimer(over)
        nth = range(n + 1, n + len(ready) + 1)
        if ready:
            yield pd.DataFrame({"form": key[0], "visitor": key[1], "event_id": [i for _, i in ready], "nth": nth, "refused": [x > self.limit for x in nth]})


def rate_limit(posts: DataFrame, limit: int, late: str = "1 hour", trap: str | None = None) -> DataFrame:
    """(form, visitor, event_id, nth, refused), as presence.rate_limit gives them on the same rows in one batch; trapped posts are not in the result.

    A post is held until the watermark passes its time, so posts that arrive after later ones are still counted first; the decision waits
    for the watermark in turn (posts.rate_limit decides at once and needs posts in order). Posts later than the watermark are dropped. State: the posts of an hour
    that wait, and one count, dropped when the hour is over.
    """
    needs_state_store(posts.sparkSession)
    keyed = posts.where(untrapped(trap)).withWatermark("ts", late).withColumn("hour", F.floor(F.unix_timestamp("ts") / 3600))
    rows = keyed.select("form", "visitor", "hour", "ts", "event_id").groupBy("form", "visitor", "hour")
    return rows.transformWithStateInPandas(OrderedLimit(limit), "form string, visitor long, event_id long, nth long, refused boolean", "Append", "EventTime")

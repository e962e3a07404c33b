"""Streams of posts, visits and saves. Each result equals the batch operator's on the same rows.

rate_limit() decides as posts come: that holds for it if no micro-batch brings a post that is earlier than one decided before.

Rows that are late by the watermark are dropped; a stream's first watermark is 1970-01-01, so rows at or before that are late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.presence import untrapped


def hourly_totals(posts: DataFrame, limit: int, late: str = "1 hour", trap: str | None = None) -> DataFrame:
    """Accepted and refused posts a form, visitor and hour, from event time with a watermark."""
    n = F.count("*")
    return posts.where(untrapped(trap)).withWatermark("ts", late).groupBy("form", "visitor", F.window("ts", "1 hour")).agg(F.least(n, F.lit(limit)).alias("accepted"), F.greatest(n - limit, F.lit(0)).alias("refused"))


def rate_limit(posts: DataFrame, limit: int, late: str = "1 hour", trap: str | None = None) -> DataFrame:
    """A decision a post: (form, visitor, event_id, nth, refused). State: one counter a form, visitor and hour, dropped by event time.

    Trapped posts are not counted and not in the result.
    """

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        nth = range(n + 1, n + len(rows) + 1)
        state.update((n + len(rows),))
        state.setTimeoutTimestamp(max(int(key[2] + 1) * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"form": key[0], "visitor": key[1], "event_id": rows["event_id"].to_numpy(), "nth": nth, "refused": [x > limit for x in nth]})

    keyed = posts.where(untrapped(trap)).withWatermark("ts", late).withColumn("hour", F.floor(F.unix_timestamp("ts") / 3600))
    return keyed.groupBy("form", "visitor", "hour").applyInPandasWithState(decide, "form string, visitor long, event_id long, nth long, refused boolean", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def debounce(saves: DataFrame, gap: str, late: str = "1 hour", key: str = "user_id", order: str = "event_id") -> DataFrame:
    """The last version of each session, when the watermark has passed its end."""
    s = saves.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key)
    return s.agg(F.max_by(order, F.struct("ts", order)).alias("saved"), F.count("*").alias("changes")).drop("w")


def last_seen(visits: DataFrame) -> DataFrame:
    """Latest presence of each id (update or complete mode): the state a retention job reads."""
    from quire.operators.presence import effective_seen

    v = visits.withColumn("_seen", effective_seen(F.col("kind"), F.col("ts")))
    return v.groupBy("id").agg(F.max_by("_seen", F.struct("ts", "event_id")).alias("last_seen"), F.min("ts").alias("created_at"))

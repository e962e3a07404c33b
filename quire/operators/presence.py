"""Time: presence, retention, hourly limits, debounced saves, progress. `now` is a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.storage import hold

#: Fixed value: the text of a reading that failed for no known reason.
BROKEN = "Something went wrong while reading the book."
AWAY, GRACE, HOUR = "15 minutes", "1 minute", "1 hour"


def effective_seen(kind: Column, ts: Column) -> Column:
    """Leaving sets last_seen so that removal follows a minute later."""
    return F.when(kind == "left", ts - F.expr(f"interval {AWAY}") + F.expr(f"interval {GRACE}")).otherwise(ts)


def last_seen(visits: DataFrame) -> DataFrame:
    """Latest event of each id decides; ties by event_id. A partial aggregate, no sort."""
    v = visits.withColumn("_seen", effective_seen(F.col("kind"), F.col("ts")))
    return v.groupBy("id").agg(F.max_by("_seen", F.struct("ts", "event_id")).alias("last_seen"), F.min("ts").alias("created_at"))


def expired(keep: Column, seen: Column, status: Column, created: Column, now: Column) -> Column:
    old = seen < now - F.expr(f"interval {AWAY}")
    return ~keep & old & ((status != "reading") | (created < now - F.expr(f"interval {HOUR}")))


def rate_limit(posts: DataFrame, limit: int, order: str = "event_id", trap: str | None = None) -> DataFrame:
    """Adds nth and refused: posts of one form and visitor beyond `limit` in a clock hour; refused posts count.

    trap: a field that only robots fill in; such posts are never refused and do not count (nth null).
    """
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    w = Window.partitionBy("form", "visitor", "_hour").orderBy("ts", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = untrapped(trap)
    nth = F.when(counts, F.sum(counts.cast("long")).over(w))
    return posts.withColumn("_hour", hour).withColumn("nth", nth).withColumn("refused", F.coalesce(F.col("nth") > limit, F.lit(False))).drop("_hour")


def untrapped(trap: str | None) -> Column:
    return F.coalesce(F.col(trap), F.lit("")) == "" if trap else F.lit(True)


def hourly_totals(posts: DataFrame, limit: int, trap: str | None = None) -> DataFrame:
    """Accepted and refused posts a form, visitor and hour: counts only, so no rows are ordered. Trapped posts are neither."""
    posts = posts.where(untrapped(trap))
    hour = F.floor(F.unix_timestamp("ts") / 3600).alias("hour")
    n = F.count("*")
    return posts.groupBy("form", "visitor", hour).agg(F.least(n, F.lit(limit)).alias("accepted"), F.greatest(n - limit, F.lit(0)).alias("refused"))


def debounce(saves: DataFrame, gap: str, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """The last version of each run of changes that are less than `gap` apart."""
    s = saves.groupBy(key, F.session_window("ts", gap).alias("w"))
    return s.agg(F.max_by(order, F.struct("ts", order)).alias("saved"), F.count("*").alias("changes")).drop("w")


def progress(events: DataFrame, steps: list[str], order: str = "event_id") -> DataFrame:
    """Status of each conversion from its events (id, ts, kind, text): (id, status, step, error).

    kind: one of `steps` (reading is there), ready, or failed with a text. ready stands at the last step; failed keeps the step that it had
    reached and its text, or the plain sentence where it has none. Unknown kinds change nothing.
    """
    place = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(steps) for x in (s, i)]), F.col("kind"))
    at = F.struct("ts", order)
    ends = F.col("kind").isin("ready", "failed")
    last = events.groupBy("id").agg(F.max_by("kind", F.when(ends, at)).alias("_end"), F.max_by("text", F.when(ends, at)).alias("_text"), F.max_by(place, F.when(place.isNotNull(), at)).alias("_step"))
    status = F.coalesce("_end", F.lit("reading"))
    step = F.when(status == "ready", len(steps) - 1).otherwise(F.coalesce("_step", F.lit(0)))
    text = F.coalesce(F.nullif("_text", F.lit("")), F.lit(BROKEN))
    return last.select("id", status.alias("status"), step.cast("long").alias("step"), F.when(status == "failed", text).otherwise("").alias("error"))


def throttle(calls: DataFrame, every: float, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """The calls (key, order, ts) that run: the first, then each that comes `every` seconds or more after the last that ran, for each key.

    Each call points to its successor, the first call of its key `every` seconds or more after it; those that run are the chain from a key's first
    call. Successors come from one range sort of calls and of the times that they wait for, so a key's calls lie in many tasks.
    The chain is walked by doubling: a round joins the marked calls with pointers 1, 2, 4, ... successors ahead, so the rounds grow with
    the logarithm of the runs. Calls without a time never run; rows of equal time and order are calls of their own.
    """
    spark = calls.sparkSession
    rows = calls.where("ts is not null").select(key, order, "ts", F.monotonically_increasing_id().alias("_id"))
    if every <= 0:
        return rows.drop("_id")
    rows = hold(rows)
    waits = rows.withColumn("_at", F.col("ts") + F.make_dt_interval(secs=F.lit(every).cast("decimal(18,6)"))).withColumn("_call", F.lit(0))  # before a call at that time
    line = [F.col(key).asc_nulls_first(), F.col("_at"), F.col("_call"), F.col(order), F.col("_id")]
    both = rows.withColumn("_at", F.col("ts")).withColumn("_call", F.lit(1)).unionByName(waits)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = hold(both.repartitionByRange(n, *line).withColumn("_range", F.spark_partition_id()))
    call = F.when(F.col("_call") == 1, F.struct(F.col(key).alias("key"), F.col("_id").alias("id")))
    # backwards, the last call seen is the next one; the first call of a later range stands in where a range has no more
    back = Window.partitionBy("_range").orderBy(F.col(key).desc_nulls_last(), F.desc("_at"), F.desc("_call"), F.desc(order), F.desc("_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = dealt.groupBy(F.col("_range").alias("_r")).agg(F.min(F.when(F.col("_call") == 1, F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key"), "_at", F.col(order).alias("order"), F.col("_id").alias("id")))).alias("_first"))
    later = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    firsts = firsts.select("_r", F.last(F.when(F.col("_first").isNotNull(), F.struct("_first.key", "_first.id")), ignorenulls=True).over(later).alias("_later"))
    near = dealt.withColumn("_next", F.last(call, ignorenulls=True).over(back)).where("_call = 0").join(firsts, F.col("_range") == F.col("_r"))
    near = near.withColumn("_next", F.coalesce("_next", "_later"))
    pointers = hold(near.where(F.col("_next.key").eqNullSafe(F.col(key))).select(F.col("_id").alias("id"), F.col("_next.id").alias("next")))
    marks = hold(rows.groupBy(key).agg(F.min(F.struct("ts", order, "_id")).alias("_first")).select(F.col("_first._id").alias("id")))
    while True:
        more = hold(marks.join(pointers, "id").select(F.col("next").alias("id")))
        if more.isEmpty():
            break
        marks = hold(marks.unionByName(more))
        further = pointers.select(F.col("id").alias("next"), F.col("next").alias("_further"))
        pointers = hold(pointers.join(further, "next").select("id", F.col("_further").alias("next")))
    return rows.join(marks, F.col("_id") == F.col("id"), "left_semi").drop("_id")


def latest(events: DataFrame, key: str, status: str, order: str = "event_id") -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, F.struct("ts", order)).alias("status"), F.count("*").alias("events"))

"""Queries of presence, limits and other time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import scalar as fn
from quire.operators import presence as pr
from quire.operators import tables as tb
from quire.plans.base import cols, on

SEEN = "seen AS (SELECT id, arg_max(CASE WHEN kind = 'left' THEN ts - INTERVAL 14 MINUTE ELSE ts END, {'t': ts, 'e': event_id}) AS last_seen, min(ts) AS created_at FROM visits GROUP BY id)"
EXPIRED = "(id % 10 <> 0 AND last_seen < now - INTERVAL 15 MINUTE AND (id % 7 <> 0 OR created_at < now - INTERVAL 1 HOUR))"
on("visits", "st_seen", f", {SEEN} SELECT id, last_seen FROM seen", lambda v: pr.last_seen(v).select("id", "last_seen"))
cols("st_left", "visits", "event_id", lambda: {"seen": pr.effective_seen(F.col("kind"), F.col("ts"))}, {"seen": "CASE WHEN kind = 'left' THEN ts - INTERVAL 14 MINUTE ELSE ts END"})


def _expired(v: DataFrame) -> DataFrame:
    now = F.broadcast(v.agg(F.max("ts").alias("now")))
    s = pr.last_seen(v).crossJoin(now)  # one row
    return s.withColumn("gone", pr.expired(F.col("id") % 10 == 0, F.col("last_seen"), F.when(F.col("id") % 7 == 0, "reading").otherwise("ready"), F.col("created_at"), F.col("now")))


on("visits", "st_retention", f", {SEEN}, t AS (SELECT max(ts) AS now FROM visits) SELECT id, {EXPIRED} AS gone FROM seen, t", lambda v: _expired(v).select("id", "gone"))
on("visits", "flt_retention", f", {SEEN}, t AS (SELECT max(ts) AS now FROM visits) SELECT id FROM seen, t WHERE {EXPIRED}", lambda v: _expired(v).where("gone").select("id"))
on("visits", "mut_delete", f", {SEEN}, t AS (SELECT max(ts) AS now FROM visits) SELECT id FROM seen, t WHERE NOT {EXPIRED}", lambda v: tb.delete_where(_expired(v), F.col("gone")).select("id"))
NTH = "CASE WHEN website = '' THEN CAST(sum(CAST(website = '' AS INT)) OVER (PARTITION BY form, visitor, floor(epoch(ts) / 3600) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END"
on("posts", "st_rate_limit", f"SELECT event_id, {NTH} AS nth, coalesce({NTH} > 2, false) AS refused FROM posts", lambda p: pr.rate_limit(p, 2, trap="website").select("event_id", "nth", "refused"))
on("posts", "st_rate_totals", "SELECT form, visitor, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, least(count(*), 2) AS accepted, greatest(count(*) - 2, 0) AS refused FROM posts WHERE website = '' GROUP BY ALL", lambda p: pr.hourly_totals(p, 2, trap="website"))
on("events", "st_debounce", "WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS saved, count(*) AS changes FROM s GROUP BY user_id, n", lambda e: pr.debounce(e, "6 hours"))
STEPS = {"click": "pages", "view": "blocks", "signup": "notes", "purchase": "ready", "error": "failed"}
on("events", "st_progress", """SELECT id, status, CASE WHEN status = 'ready' THEN 2 ELSE coalesce(step, 0) END AS step, CASE WHEN status <> 'failed' THEN '' WHEN event_id % 2 = 0 THEN 'broken' ELSE 'Something went wrong while reading the book.' END AS error
  FROM (SELECT user_id AS id, coalesce(arg_max(CASE event_type WHEN 'purchase' THEN 'ready' ELSE 'failed' END, {'t': ts, 'e': event_id}) FILTER (event_type IN ('purchase', 'error')), 'reading') AS status, arg_max(event_id, {'t': ts, 'e': event_id}) FILTER (event_type IN ('purchase', 'error')) AS event_id,
    CAST(arg_max(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, {'t': ts, 'e': event_id}) FILTER (event_type IN ('click', 'view', 'signup')) AS BIGINT) AS step FROM events GROUP BY user_id)""",
    lambda e: pr.progress(e.select(F.col("user_id").alias("id"), "ts", "event_id", fn.label_or_code(F.col("event_type"), STEPS).alias("kind"), F.when(F.col("event_id") % 2 == 0, "broken").otherwise("").alias("text")), ["pages", "blocks", "notes"]))
on("events", "st_throttle", """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT user_id, event_id, ts, k, ts AS last, true AS runs FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.ts, o.k, CASE WHEN o.ts >= r.last + INTERVAL 6 HOUR THEN o.ts ELSE r.last END, o.ts >= r.last + INTERVAL 6 HOUR FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
  SELECT user_id, event_id, ts FROM r WHERE runs""", lambda e: pr.throttle(e, 6 * 3600))
on("events", "st_latest", "SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS status, count(*) AS events FROM events GROUP BY user_id", lambda e: pr.latest(e, "user_id", "event_type"))

"""Queries of sections, pages, neighbours and picks in the order of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import blocks as bl
from quire.operators import picking as pk
from quire.plans.base import on, query
from quire.plans.parts import SECTION
from quire.sources.views import sql
from quire.sources import views

on("blocks", "seq_sections", f", {SECTION} SELECT doc_id, CAST(section AS BIGINT) AS section, min(pos) AS start, max(pos) + 1 AS stop FROM secs GROUP BY doc_id, section", lambda b: bl.sections(b).select("doc_id", "section", "start", "stop"))
on("blocks", "seq_level_at", "SELECT doc_id, pos, coalesce(last_value(CASE WHEN type = 'heading' THEN level END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS level_at FROM blocks", lambda b: bl.level_at(b).select("doc_id", "pos", "level_at"))
PLACES = """k1 AS (SELECT *, sum(CAST(include AS INT)) OVER w AS k, sum(CAST(include AND type = 'heading' AS INT)) OVER w AS hs FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
k2 AS (SELECT *, hs - 1 + max(CAST(k = 1 AND include AND type <> 'heading' AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sec FROM k1),
k3 AS (SELECT *, CASE WHEN k > 0 THEN sec END AS section FROM k2), k4 AS (SELECT *, sum(CAST(include AND type <> 'heading' AS INT)) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS p FROM k3),
places AS (SELECT doc_id, pos, CAST(section AS BIGINT) AS section, CAST(CASE WHEN k > 0 AND p >= 0 THEN p END AS BIGINT) AS paragraph FROM k4)"""
on("blocks", "seq_preview_page", f", {PLACES} SELECT * FROM places", lambda b: bl.preview_places(b).select("doc_id", "pos", "section", "paragraph"))
SIZES = "sizes AS (SELECT doc_id, section, section * 3 + j AS page_no, 2 AS paragraphs FROM (SELECT DISTINCT doc_id, section FROM places WHERE section IS NOT NULL), (SELECT unnest([1, 2, 3]) AS j))"


@query("join_page_of_paragraph", sql("blocks", f", {PLACES}, {SIZES} SELECT doc_id, pos, page_no, lpad(CAST(page_no AS VARCHAR), CAST(greatest(4, length(CAST(page_no AS VARCHAR))) AS INTEGER), '0') || '.xhtml' AS file FROM (SELECT doc_id, pos, CAST(CASE WHEN section IS NULL THEN 1 WHEN paragraph IS NULL THEN section * 3 + 1 ELSE section * 3 + least(3, paragraph // 2 + 1) END AS BIGINT) AS page_no FROM places)"))
def _(spark, d):
    places = bl.preview_places(views.blocks(spark, d))
    sizes = places.where("section is not null").select("doc_id", "section").distinct().select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("j"))
    sizes = sizes.select("doc_id", "section", (F.col("section") * 3 + F.col("j")).alias("page_no"), F.lit(2).alias("paragraphs"))
    return bl.preview_pages(places.select("doc_id", "pos", "section", "paragraph"), sizes).select("doc_id", "pos", "page_no", "file")


on("blocks", "seq_open_section", f", {SECTION} SELECT doc_id, CAST(coalesce(min(section) FILTER (include), 0) AS BIGINT) AS open_section FROM secs GROUP BY doc_id", bl.open_section)
on("blocks", "seq_open_page", "SELECT doc_id, coalesce(arg_min(page, pos) FILTER (include AND page > 0), 1) AS open_page FROM blocks GROUP BY doc_id", bl.open_page)
on("blocks", "seq_section_page", f", {SECTION} SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(min(page) FILTER (page > 0), 9) AS page FROM secs GROUP BY doc_id, section", lambda b: bl.section_page(b, 9))
on("documents", "seq_range", "SELECT doc_id, unnest(generate_series(least(doc_id % 7, 3), greatest(doc_id % 7, 3))) AS at FROM documents", lambda d: d.select("doc_id", F.explode(pk.range_pick(F.col("doc_id") % 7, F.lit(3).cast("long"))).alias("at")))
CLICKS = """clicks AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, (event_id * 7919) % 40 AS "at", event_type IN ('click', 'error') AS shift FROM events)"""
# each block by itself: its last range, then the parity of the toggles after it
on("events", "seq_range_pick", f"""WITH {CLICKS}, a AS (SELECT *, lag("at") OVER (PARTITION BY session ORDER BY n) AS anchor FROM clicks),
  o AS (SELECT session, n, unnest(generate_series(least(anchor, "at"), greatest(anchor, "at"))) AS "at", true AS range FROM a WHERE shift AND anchor IS NOT NULL UNION ALL SELECT session, n, "at", false FROM a WHERE NOT shift OR anchor IS NULL),
  l AS (SELECT *, max(n) FILTER (range) OVER (PARTITION BY session, "at") AS last FROM o)
  SELECT session, "at" FROM l GROUP BY session, "at", last HAVING ((last IS NOT NULL)::INT + count(*) FILTER (NOT range AND n > coalesce(last, 0))) % 2 = 1""", lambda e: pk.picked(_clicks(e)))
on("blocks", "seq_can_join", "SELECT doc_id, pos, type = 'text' AND coalesce(lead(type) OVER (PARTITION BY doc_id ORDER BY pos) = 'text', false) AS can_join FROM blocks", lambda b: bl.can_join(b).select("doc_id", "pos", "can_join"))
on("blocks", "seq_prev_next", f", {SECTION}, s AS (SELECT DISTINCT doc_id, CAST(section AS BIGINT) AS section FROM secs) SELECT doc_id, section, lag(section) OVER w AS previous, lead(section) OVER w AS next FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY section)", lambda b: bl.neighbours(bl.sections(b)))


def _clicks(events: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("session"), n.alias("n"), ((F.col("event_id") * 7919) % 40).alias("at"), F.col("event_type").isin("click", "error").alias("shift"))

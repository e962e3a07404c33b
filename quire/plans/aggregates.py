"""Queries that aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import blocks as bl
from quire.operators import intake as it
from quire.operators import library as li
from quire.plans.base import on, query
from quire.plans.parts import NO_BLOCKS, SECTION, WITH_NOTES
from quire.sources.views import sql
from quire.sources import views

@query("agg_block_counts", sql("blocks book_notes", f", {WITH_NOTES} SELECT * FROM summary"))
def _(spark, d):
    return bl.counts(views.blocks(spark, d), views.book_notes(spark, d))


@query("agg_summary", sql("blocks book_notes books", f", {WITH_NOTES} SELECT uid, title, author, language, headings, paragraphs, notes FROM books JOIN summary ON uid = doc_id"))
def _(spark, d):
    return bl.counts(views.blocks(spark, d), views.book_notes(spark, d)).join(views.books(spark, d), F.col("doc_id") == F.col("uid")).select("uid", "title", "author", "language", "headings", "paragraphs", "notes")


@query("agg_chapters", sql("blocks books", f", {NO_BLOCKS} SELECT uid, CASE WHEN uid % 2 = 0 THEN headings END AS chapters FROM books LEFT JOIN counts ON uid = doc_id"))
def _(spark, d):
    b = views.books(spark, d).join(bl.counts(views.blocks(spark, d)), F.col("doc_id") == F.col("uid"), "left")
    return bl.chapters(b, F.col("uid") % 2 == 0).select("uid", "chapters")


on("blocks", "agg_role_counts", "SELECT doc_id, role, count(*) AS n, bool_and(include) AS all_included FROM blocks WHERE role <> 'body' GROUP BY doc_id, role", bl.role_counts)
on("blocks", "agg_page_range", "SELECT doc_id, min(page) FILTER (page > 0) AS first_page, max(page) FILTER (page > 0) AS last_page FROM blocks GROUP BY doc_id", bl.page_range)
on("blocks", "agg_contents_count", "SELECT doc_id, count(*) FILTER (type = 'heading') AS n FROM blocks GROUP BY doc_id", bl.contents_count)


WAITING = """waiting AS (SELECT * FROM (SELECT 1 AS place, 'unread messages' AS what, count(*) AS n, '/m' AS url FROM contact_posts WHERE turn % 2 = 0 UNION ALL SELECT 2, 'new suggestions', count(*), '/s' FROM suggestions WHERE status = 'new'
  UNION ALL SELECT 3, 'books to check', count(*), '/b' FROM books WHERE NOT is_published UNION ALL SELECT 4, 'none', count(*), '/n' FROM books WHERE uid < 0) WHERE n > 0)"""


def _waiting(spark, d) -> DataFrame:
    b = views.books(spark, d)
    return it.waiting({"unread messages": (it.unread(views.contact_posts(spark, d), F.col("turn") % 2 != 0), "/m"), "new suggestions": (it.new_suggestions(views.suggestions(spark, d)), "/s"), "books to check": (it.unpublished(b), "/b"), "none": (b.where("uid < 0"), "/n")})


query("agg_waiting", sql("contact_posts suggestions books", f", {WAITING} SELECT what, n, url FROM waiting"))(lambda s, d: _waiting(s, d).select("what", "n", "url"))
query("agg_review", sql("contact_posts suggestions books", f", {WAITING} SELECT CAST(sum(n) AS BIGINT) AS total, sum(n) || ' waiting for review' AS subject, string_agg(n || ' ' || what || ':' || chr(10) || url, chr(10) || chr(10) ORDER BY place) AS body FROM waiting HAVING sum(n) > 0"))(lambda s, d: it.review(_waiting(s, d)))


on("books", "agg_distinct_languages", "SELECT language, row_number() OVER (ORDER BY o, t, u) AS rank FROM (SELECT language, f.o AS o, f.t AS t, f.u AS u FROM (SELECT language, min({'o': ord, 't': title, 'u': uid}) AS f FROM books GROUP BY language))", li.languages)
on("blocks", "agg_any_included", f", {SECTION} SELECT doc_id, CAST(section AS BIGINT) AS section, bool_or(include) AS any_included FROM secs GROUP BY doc_id, section", lambda b: bl.sections(b).select("doc_id", "section", "any_included"))
on("events", "agg_total_counter", "SELECT count(*) AS count FROM events WHERE event_type = 'purchase'", lambda e: it.total(e, F.col("event_type") == "purchase"))
on("suggestions", "agg_affected", "SELECT count(*) AS n, count(*) FILTER (email <> '') AS told FROM suggestions WHERE status = 'new'", lambda s: it.affected(it.new_suggestions(s)))
PICTURE = "pos % 5 = 3"
PROBLEMS = f"""SELECT doc_id, concat_ws(';', CASE WHEN count(*) FILTER (include) = 0 THEN 'nothing to write' END,
  string_agg('block ' || chr(39) || 'b' || pos || chr(39) || ': a picture must be a JPEG image with its width and height', ';' ORDER BY pos) FILTER ({PICTURE} AND NOT (pos % 2 = 1 AND pos % 3 > 0))) AS problems FROM blocks GROUP BY doc_id"""


def _with_pictures(b: DataFrame) -> DataFrame:
    """Every fifth line a picture: a JPEG or none, with a height of 0 to 2."""
    pos, is_picture = F.col("pos"), F.expr(PICTURE)
    return b.withColumns({"id": F.concat(F.lit("b"), pos.cast("string")), "type": F.when(is_picture, "picture").otherwise(F.col("type")), "data": F.when(is_picture & (pos % 2 == 1), "/9ggcGljdHVyZQ==").otherwise("cGljdHVyZQ=="), "width": F.lit(3), "height": pos % 3})


on("blocks", "agg_problems_set", PROBLEMS, lambda b: bl.problems(_with_pictures(b)).select("doc_id", F.array_join("problems", ";").alias("problems")))

"""Queries that join."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import blocks as bl
from quire.operators import intake as it
from quire.operators import library as li
from quire.plans.base import on, query
from quire.plans.parts import SECTION
from quire.sources.views import table

@query("join_language_text", "SELECT doc_id, CASE lang WHEN 'fr' THEN 'Bonjour' ELSE 'Hello' END AS subject FROM documents")
def _(spark, d):
    t = spark.createDataFrame([("en", "Hello", "..."), ("fr", "Bonjour", "...")], "lang string, subject string, text string")
    return it.accepted_mail(table(spark, d, "documents").select("doc_id", "lang"), t).select("doc_id", "subject")


on("blocks", "join_section_of_block", f", {SECTION} SELECT doc_id, pos, CAST(section AS BIGINT) AS section FROM secs", lambda b: bl.with_section(b).select("doc_id", "pos", "section"))
on("books", "join_self_exclude", "SELECT uid FROM books WHERE uid <> 5", lambda b: li.without(b, "uid", 5).select("uid"))


@query("join_field_limits", """SELECT field, CASE WHEN field = 'click' THEN 2000 ELSE max_length END AS most FROM (SELECT DISTINCT event_type AS field FROM events)
  LEFT JOIN (SELECT event_type AS field, CAST(max(length(props)) AS INTEGER) AS max_length FROM events WHERE event_type <> 'error' GROUP BY event_type) USING (field)""")
def _(spark, d):
    """Kinds of events as fields; a field's limit is its call's, else the longest value that its column has."""
    e = table(spark, d, "events")
    columns = e.where("event_type <> 'error'").groupBy(F.col("event_type").alias("field")).agg(F.max(F.length("props")).alias("max_length"))
    return it.field_limits(e.select(F.col("event_type").alias("field")).distinct(), columns, {"click": 2000})

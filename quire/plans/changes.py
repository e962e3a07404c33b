"""Queries that change tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import tables as tb
from quire.plans.base import on, query
from quire.sources.storage import new_folder
from quire.sources.views import table

on("documents", "mut_insert", "SELECT doc_id, 'old' AS status FROM documents UNION ALL SELECT doc_id + 1000000000, 'new' FROM documents", lambda d: tb.insert(d.select("doc_id", F.lit("old").alias("status")), d.select((F.col("doc_id") + 1_000_000_000).alias("doc_id")), status="new"))
on("events", "mut_upsert_add", "SELECT event_type AS name, count(*) + CASE WHEN event_type = 'click' THEN 5 ELSE 0 END AS count FROM events GROUP BY event_type UNION ALL SELECT 'absent', 3", lambda e: tb.upsert_add(e.sparkSession.createDataFrame([("click", 5), ("absent", 3)], "name string, count long"), e.select(F.col("event_type").alias("name"), F.lit(1).alias("delta"))))
on("suggestions", "mut_update_where", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'accepted' ELSE status END AS status FROM suggestions", lambda s: tb.update_where(s, F.col("doc_id") % 4 == 0, status="accepted").select("doc_id", "status"))
on("orders", "mut_promote", "SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'upload' END AS title, '' AS author, 'en' AS language, false AS is_published, o_orderpriority || '!' AS data, CASE WHEN o_orderkey % 3 = 0 THEN 'cover.jpg' END AS cover FROM orders WHERE o_orderstatus = 'F'", lambda o: tb.promote(o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("reading").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("title"), F.lit("upload").alias("name"), F.lit(None).cast("string").alias("author"), F.lit("en").alias("language"), F.concat("o_orderpriority", F.lit("!")).alias("data"), F.when(F.col("o_orderkey") % 3 == 0, "cover.jpg").alias("cover"))))
on("suggestions", "mut_convert_suggestion", "SELECT doc_id, CASE WHEN has_pdf THEN title END AS name, CASE WHEN has_pdf THEN title || '.pdf' END AS file, CASE WHEN has_pdf THEN size END AS size, CASE WHEN has_pdf THEN pages END AS pages, CASE WHEN has_pdf THEN 'reading' END AS status, CASE WHEN has_pdf THEN true END AS keep, CASE WHEN NOT has_pdf THEN 'no_pdf' END AS error FROM suggestions", tb.convert_suggestions)
on("books", "mut_list_edit", "SELECT uid, CASE WHEN uid % 10 = 0 THEN 77 ELSE ord END AS ord FROM books", lambda b: tb.list_edit(b.select("uid", "ord"), b.where("uid % 10 = 0").select("uid", F.lit(77).cast("long").alias("ord")), "uid"))


@query("mut_backfill_uid", "SELECT doc_id, true AS uid, true AS alone FROM documents")
def _(spark, d):
    """A uid for each row, written once: is it one, and its row's alone."""
    rows = tb.backfill_uid(table(spark, d, "documents").select("doc_id"), new_folder(spark, "uids"))
    copies = rows.groupBy("uid").agg(F.count("*").alias("n"))
    return rows.join(copies, "uid").select("doc_id", F.col("uid").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$").alias("uid"), (F.col("n") == 1).alias("alone"))

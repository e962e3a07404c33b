"""Queries of filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import blocks as bl
from quire.operators import intake as it
from quire.operators import library as li
from quire.plans.base import cols, on

on("books", "flt_published", "SELECT uid FROM books WHERE is_published", lambda b: li.published(b).select("uid"))
on("books", "flt_pk", "SELECT uid, title FROM books WHERE uid = 7", lambda b: li.by_key(b, "uid", 7).select("uid", "title"))
cols("flt_ready", "orders", "o_orderkey", lambda: {"code": li.not_ready(F.col("o_orderstatus"), "F")}, {"code": "CASE WHEN o_orderstatus <> 'F' THEN 'not_ready' END"})
on("books", "flt_language", "SELECT uid FROM books WHERE language = 'fr'", lambda b: li.of_language(b, "fr").select("uid"))
on("books", "flt_search", "SELECT uid FROM books WHERE contains(lower(title || ' ' || author), 'the s')", lambda b: li.search(b, " The S").select("uid"))
on("books", "flt_admin_search", "SELECT uid FROM books WHERE (contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'an') OR contains(translate(author, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'an')) AND (contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'src1') OR contains(translate(author, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'src1'))", lambda b: li.admin_search(b, "AN  src1", ["title", "author"]).select("uid"))
on("books", "flt_admin_facet", "SELECT uid FROM books WHERE language = 'en' AND is_published", lambda b: li.facet(b, language="en", is_published=True).select("uid"))
on("books", "flt_admin_facet_values", "SELECT 'language' AS facet, language AS value, count(*) AS n FROM books GROUP BY language UNION ALL SELECT 'is_published', CAST(is_published AS VARCHAR), count(*) FROM books GROUP BY is_published", lambda b: li.facet_values(b, "language", "is_published"))
on("contact_posts", "flt_waiting", "SELECT conv_id, turn FROM contact_posts WHERE turn % 2 = 0", lambda c: it.unread(c, F.col("turn") % 2 != 0).select("conv_id", "turn"))
on("suggestions", "flt_waiting_suggestions", "SELECT doc_id FROM suggestions WHERE status = 'new'", lambda s: it.new_suggestions(s).select("doc_id"))
on("books", "flt_waiting_books", "SELECT uid FROM books WHERE NOT is_published", lambda b: it.unpublished(b).select("uid"))
on("contact_posts", "flt_has_email", "SELECT conv_id, turn FROM contact_posts WHERE email <> ''", lambda c: it.with_email(c).select("conv_id", "turn"))
on("blocks", "flt_included", "SELECT doc_id, pos FROM blocks WHERE include", lambda b: bl.included(b).select("doc_id", "pos"))
on("blocks", "flt_page_known", "SELECT doc_id, pos, page FROM blocks WHERE page > 0", lambda b: bl.page_known(b).select("doc_id", "pos", "page"))
on("blocks", "flt_non_body", "SELECT doc_id, pos, role FROM blocks WHERE role <> 'body'", lambda b: bl.non_body(b).select("doc_id", "pos", "role"))
on("books", "flt_has_cover", "SELECT uid, cover_url FROM books WHERE cover_url IS NOT NULL ORDER BY ord, title, uid LIMIT 4", lambda b: li.first(b.where("cover_url is not null")).select("uid", "cover_url"))
media_path = lambda: F.concat(F.lit("/media/"), F.element_at(F.array(*map(F.lit, ("conversions/", "conversions/x/", "suggestions/", "conversions/x/y/"))), (F.col("doc_id") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("cover.jpg", "source.pdf", "book.json"))), (F.col("n_chars") % 3 + 1).cast("int")))
path = "('/media/' || list_extract(['conversions/', 'conversions/x/', 'suggestions/', 'conversions/x/y/'], doc_id % 4 + 1) || list_extract(['cover.jpg', 'source.pdf', 'book.json'], n_chars % 3 + 1))"
cols("flt_media_deny", "documents", "doc_id", lambda: {"rule": li.media_rule(media_path())}, {"rule": f"CASE WHEN regexp_matches({path}, '^/media/conversions/[^/]+/') AND NOT regexp_matches({path}, '^/media/conversions/[^/]+/cover[.]jpg$') THEN 'deny' WHEN {path} LIKE '%.pdf' THEN 'attachment' ELSE 'serve' END"})
ROUTE = "concat(CASE page_id % 6 WHEN 1 THEN 'api/' WHEN 2 THEN 'admin/' WHEN 3 THEN 'media' WHEN 4 THEN 'static/' WHEN 5 THEN 'media/' ELSE '' END, {path})"
URL_PATH = "regexp_extract(url, '^https?://[^/]+/(.*)$', 1)"
cols("flt_route", "pages", "page_id", lambda: {"page": li.is_page(F.expr(ROUTE.format(path=URL_PATH)))}, {"page": f"NOT regexp_matches({ROUTE.format(path=URL_PATH)}, '^(api|admin|media|static)/')"})
cols("flt_is_pdf_client", "pages", "page_id", lambda: {"is_pdf": it.is_pdf_client(F.when(F.col("page_id") % 5 == 0, "application/pdf").otherwise("text/html"), F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PDF").otherwise(".txt")))}, {"is_pdf": "(page_id % 5 = 0 OR page_id % 3 = 0)"})

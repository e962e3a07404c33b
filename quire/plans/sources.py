"""Queries of sources and sinks, and the first one end to end."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import scalar as fn
from quire.operators import blocks as bl
from quire.operators import conversions as cv
from quire.operators import counter as ct
from quire.operators import intake as it
from quire.operators import library as li
from quire.plans.base import cols, on, query
from quire.plans.parts import CLAMP, NO_BLOCKS, WITH_NOTES
from quire.sources import books as bk
from quire.sources import files, previews, views
from quire.sources.storage import hold, new_folder
from quire.sources.views import sql, table


@query("first_four_books", sql("blocks books", f", {NO_BLOCKS} SELECT uid, title, ord, headings, paragraphs FROM books JOIN counts ON uid = doc_id WHERE is_published ORDER BY ord, title, uid LIMIT 4"))
def first_four_books(spark, d):
    """Top four first, then counts of these four books only."""
    top = li.first(li.published(views.books(spark, d)))
    return bl.counts(views.blocks(spark, d).join(F.broadcast(top), F.col("doc_id") == F.col("uid"), "left_semi")).join(top, F.col("doc_id") == F.col("uid")).select("uid", "title", "ord", "headings", "paragraphs")


on("books", "src_table", "SELECT uid, title, ord FROM books", lambda b: li.library_order(b).select("uid", "title", "ord"))


LINES = "string_split(text, chr(10))"


@query("src_book_json", f"""SELECT doc_id, error, "at", title, CASE WHEN error IS NULL THEN len(list_filter(l, lambda x, i: length(x) <= 40 AND (i - 1) % 7 <> 6)) END AS headings,
  CASE WHEN error IS NULL THEN len(list_filter(l, lambda x, i: length(x) > 40 AND (i - 1) % 7 <> 6)) END AS paragraphs, CASE WHEN error IS NULL THEN CAST(2 - 2 * (doc_id % 2) AS BIGINT) END AS notes, error IS NOT NULL AS kept
  FROM (SELECT doc_id, {LINES} AS l, CASE WHEN doc_id % 9 = 8 THEN substring(text, 1, 60) END AS title, CASE WHEN doc_id % 9 = 5 THEN len({LINES}) END AS "at",
    list_extract(['not_json', 'not_object', 'not_object', 'no_metadata', 'no_notes', 'bad_block', 'not_json', 'no_blocks', NULL], doc_id % 9 + 1) AS error FROM documents)""")
def _(spark, d):
    got = bk.counts(bk.read_books(views.book_texts(spark, d), "json"))
    kept = (F.col("refused") == F.col("json")) & F.col("error").isNotNull()
    return got.select("doc_id", "error", "at", F.col("metadata.title").alias("title"), "headings", "paragraphs", F.col("n_notes").alias("notes"), F.coalesce(kept, F.lit(False)).alias("kept"))


on("events", "src_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", lambda e: e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k")))

cols("src_form", "conversations", "conv_id turn", lambda: {"text": files.form_field(F.create_map(F.lit("text"), F.concat(F.lit("\t "), F.col("text"), F.lit(" \n")), F.lit("name"), F.col("role")), "text")}, {"text": r"regexp_replace(regexp_replace(chr(9) || ' ' || text || ' ' || chr(10), '^\s+', ''), '\s+$', '')"})

JSON = """CAST(to_json({'title': title, 'id': CAST(uid AS VARCHAR), 'author': author, 'language': language, 'description': '', 'cover_url': cover_url,
  'epub_url': CASE WHEN uid % 2 = 0 THEN '/media/' || uid || '/book.epub' END, 'epub_size': CASE WHEN uid % 2 = 0 THEN epub_size END, 'chapters': CASE WHEN uid % 3 <> 1 THEN headings END}) AS VARCHAR)"""


def _serialized(spark, d, key: int | None = None) -> DataFrame:
    """Published books, or one of them, with the fields that the view lacks: an e-book for even ids, data kept for two of three."""
    uid = F.col("uid")
    b = li.published(views.books(spark, d))
    b = b if key is None else li.by_key(b, "uid", key)  # on the stored column, so that the scan is pruned
    b = b.join(bl.counts(views.blocks(spark, d)), F.col("doc_id") == uid, "left")
    b = bl.chapters(b, uid % 3 != 1).withColumns({"description": F.lit(""), "epub_url": F.when(uid % 2 == 0, F.concat(F.lit("/media/"), uid.cast("string"), F.lit("/book.epub")))})
    return li.serialize(b)


@query("snk_json_list", sql("blocks books", f", {NO_BLOCKS} SELECT {JSON} AS json FROM books LEFT JOIN counts ON uid = doc_id WHERE is_published"))
def _(spark, d):
    return files.json_list(_serialized(spark, d), "*")


@query("snk_json_row", sql("blocks books", f", {NO_BLOCKS} SELECT {JSON} AS json FROM books LEFT JOIN counts ON uid = doc_id WHERE is_published AND uid = 3"))
def _(spark, d):
    return files.json_list(_serialized(spark, d, 3), "*")


CONVERSIONS = "SELECT doc_id, 'upload ' || doc_id AS name, n_chars * 4000 AS size, n_chars // 10 AS pages, doc_id % 3 AS step, substring(text, 1, 60) AS title, source AS author, lang AS language FROM documents"


@query("snk_json_conversion", sql("blocks book_notes", f""", {WITH_NOTES}, c AS ({CONVERSIONS})
  SELECT CAST(to_json({{'id': CAST(c.doc_id AS VARCHAR), 'name': name, 'size': size, 'pages': pages, 'status': list_extract(['reading', 'ready', 'failed'], step + 1), 'step': step, 'steps': CAST(3 AS BIGINT), 'error': CASE WHEN step = 2 THEN 'broken' ELSE '' END,
  'cover_url': CASE WHEN c.doc_id % 2 = 0 THEN '/media/' || c.doc_id END, 'book': CASE WHEN step = 1 THEN {{'title': title, 'author': author, 'language': language, 'headings': headings, 'paragraphs': paragraphs, 'notes': notes}} END,
  'created_at': strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c.doc_id), '%Y-%m-%dT%H:%M:%S') || CASE WHEN c.doc_id % 2 = 1 THEN '.500000' ELSE '' END || '+00:00'}}) AS VARCHAR) AS json FROM c LEFT JOIN summary s ON c.doc_id = s.doc_id"""))
def _(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", "concat('upload ', doc_id) AS name", "n_chars * 4000 AS size", "floor(n_chars / 10) AS pages", "doc_id % 3 AS step", "substring(text, 1, 60) AS title", "source AS author", "lang AS language")
    rows = rows.join(bl.counts(views.blocks(spark, d), views.book_notes(spark, d)).withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"), "left").drop("id")
    status = F.element_at(F.array(*map(F.lit, ("reading", "ready", "failed"))), (F.col("step") + 1).cast("int"))
    ready = {c: F.when(F.col("step") == 1, F.col(c)) for c in ("headings", "paragraphs", "notes")}
    made = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("doc_id") * 1000 + F.col("doc_id") % 2 * 500)
    rows = rows.withColumns(ready | {"status": status, "error": F.when(F.col("step") == 2, "broken").otherwise(""), "cover_url": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/media/"), F.col("doc_id").cast("string"))).otherwise(""), "created_at": made})
    return files.json_list(cv.records(rows.withColumnRenamed("doc_id", "id"), 3), "*")


CLAIM = "CASE rights WHEN 'public_domain' THEN 'Public domain' WHEN 'permission' THEN 'Has the rights or permission' WHEN 'unsure' THEN 'Not sure' ELSE rights END"
SUGGESTED = f"""SELECT doc_id, concat_ws(chr(10) || chr(10), nullif(CASE WHEN author <> '' THEN title || ' — ' || author ELSE title END, ''), nullif(note, ''),
  CASE WHEN has_pdf THEN 'PDF: ' || {CLAIM} || CASE WHEN holder <> '' THEN ' (' || holder || ')' ELSE '' END ELSE 'No PDF' END, 'https://s/admin/library/suggestion/' || doc_id || '/change/') AS body FROM suggestions"""
suggested = lambda: it.suggestion_body(*map(F.col, ("title", "author", "note", "has_pdf", "rights", "holder")), it.admin_url("https://s", "library", "suggestion", F.col("doc_id")))
on("suggestions", "snk_notice_body", SUGGESTED, lambda s: s.select("doc_id", suggested().alias("body")))
SENDER = "coalesce(nullif(name, ''), nullif(email, ''), 'Someone')"
NOTICE = f"""CASE WHEN link <> '' THEN 'About: ' || link || chr(10) || chr(10) ELSE '' END || text || chr(10) || chr(10) || '— ' || {SENDER} || ' ' || email || chr(10) || 'https://s/admin/contact/message/' || conv_id || '/change/'"""
notice = lambda: it.message_body(*map(F.col, ("text", "link", "name", "email")), it.admin_url("https://s", "contact", "message", F.col("conv_id")))
cols("snk_notice_message", "contact_posts", "conv_id turn", lambda: {"body": notice()}, {"body": NOTICE})
SUBJECT = f"CASE kind WHEN 'message' THEN 'Message from ' || {SENDER} WHEN 'problem' THEN 'Problem reported by ' || {SENDER} WHEN 'copyright' THEN 'Copyright concern from ' || {SENDER} END"
on("contact_posts", "snk_email", f"SELECT 'team@example.org' AS recipient, '[Books] ' || {SUBJECT} AS subject, {NOTICE} AS body, nullif(email, '') AS reply_to FROM contact_posts WHERE kind <> 'book'", lambda c: it.outbox(c.where("kind <> 'book'"), "team@example.org", it.message_subject(*map(F.col, ("kind", "name", "email"))), notice(), F.col("email"), "Books"))
on("suggestions", "snk_email_suggestion", f", s AS ({SUGGESTED}) SELECT doc_id, 'team@example.org' AS recipient, '[Books] Book suggested: ' || title AS subject, s.body, nullif(email, '') AS reply_to FROM suggestions JOIN s USING (doc_id)", lambda s: it.outbox(s, "team@example.org", it.suggestion_subject(F.col("title")), suggested(), F.col("email"), "Books", "doc_id"))
on("contact_posts", "prj_message_row", "SELECT conv_id, turn, CASE WHEN kind = 'message' THEN '' ELSE link END AS link FROM contact_posts", lambda c: it.message_row(c).select("conv_id", "turn", "link"))
cols("snk_admin_url", "documents", "doc_id", lambda: {"url": it.admin_url("https://s", "library", "book", F.col("doc_id"))}, {"url": "'https://s/admin/library/book/' || doc_id || '/change/'"})
on("events", "snk_info", "SELECT '1.0' AS engine, 'abcdef1234' AS commit, count(*) AS converted FROM events WHERE event_type <> 'error'", lambda e: files.info("1.0", "abcdef1234", it.total(e, F.col("event_type") != "error")))


@query("agg_counter_log", "SELECT event_type AS name, count(*) AS count FROM events WHERE event_type <> 'error' GROUP BY event_type")
def _(spark, d):
    """Counts from a log of three appends, two of them folded into a snapshot, one given twice."""
    done = table(spark, d, "events").where("event_type <> 'error'")
    folder, part = new_folder(spark, "counters"), lambda k: done.where(F.pmod("event_id", F.lit(3)) == k)
    ct.append(part(0), folder, 0, "event_type")
    ct.append(part(1), folder, 1, "event_type")
    ct.compact(spark, folder)
    ct.append(part(1), folder, 1, "event_type")
    ct.append(part(2), folder, 2, "event_type")
    return ct.totals(spark, folder)
cols("snk_preview", "events", "event_id", lambda: {"stale": files.stale(F.when(F.col("user_id") % 4 != 0, F.expr("timestamp'2024-01-15 00:00:00'")), F.col("ts"))}, {"stale": "(user_id % 4 = 0 OR TIMESTAMP '2024-01-15 00:00:00' < ts)"})
cols("snk_page_png", "documents", "doc_id", lambda: {"width": fn.clamp_width(F.lit(1600), F.col("doc_id") + 1, F.col("n_chars")).cast("long")}, {"width": CLAMP.format(w=1600, a="(doc_id + 1)", b="n_chars")})


def _epubs(spark, d) -> tuple[DataFrame, str]:
    """Each document as a zip file of three members, one in seven refused; (name, file, error) and the folder."""
    id_, folder = F.col("doc_id"), new_folder(spark, "epubs")
    members = F.create_map(F.lit("mimetype"), F.lit("application/epub+zip"), F.lit("text.xhtml"), F.col("text"), F.lit("style.css"), F.col("source"))
    problems = F.when(id_ % 7 == 0, F.array(F.lit("nothing to write"))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = table(spark, d, "documents").select(id_.cast("string").alias("name"), problems.alias("problems"), members.alias("members"))
    return hold(files.write_zips(rows, folder)), folder


@query("snk_epub", "SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 7 <> 0 THEN doc_id || '.epub' END AS file, CASE WHEN doc_id % 7 = 0 THEN 'nothing to write' END AS error FROM documents")
def _(spark, d):
    return _epubs(spark, d)[0].select("name", F.substring_index("file", "/", -1).alias("file"), "error")


@query("src_zip_member", """SELECT doc_id || '.epub' AS file, name, type, CAST(strlen(content) AS BIGINT) AS size, md5(content) AS md5 FROM (SELECT doc_id,
  unnest(['mimetype', 'text.xhtml', 'style.css']) AS name, unnest(['application/octet-stream', 'application/xhtml+xml', 'text/css']) AS type, unnest(['application/epub+zip', coalesce(text, ''), coalesce(source, '')]) AS content FROM documents WHERE doc_id % 7 <> 0)""")
def _(spark, d):
    """The members of the files that snk_epub writes, read back."""
    members = files.zip_members(spark, _epubs(spark, d)[1])
    return members.select(F.substring_index("path", "/", -1).alias("file"), "name", "type", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("md5"))


def _plain(members: dict) -> bytes:
    return (members["data"] or "").encode()


def _uploads(spark, d) -> DataFrame:
    """A file a document: one in nine no PDF."""
    data = F.concat(F.when(F.col("doc_id") % 9 == 0, "<html").otherwise("%PDF-"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.create_map(F.lit("data"), data).alias("members"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))


@query("src_pdf", "SELECT doc_id, 5 + strlen(coalesce(text, '')) AS size, CASE WHEN doc_id % 9 = 0 THEN 'not_pdf' END AS code FROM documents")
def _(spark, d):
    """Uploads written as files, then read: their size, and the code of the first rule that they break (page counts are not read here)."""
    folder = new_folder(spark, "uploads")
    hold(previews.refresh(_uploads(spark, d), folder, "doc_id", make=_plain, ending="pdf"))
    got = files.uploads(spark, folder)
    key = F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long")
    return got.select(key.alias("doc_id"), "size", it.pdf_code(F.col("size"), F.col("head").cast("string"), F.lit(1)).alias("code"))


@query("snk_preview_files", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 5 = 0")
def _(spark, d):
    """What a second run writes, when one book in five has changed since the first."""
    books, folder = _uploads(spark, d), new_folder(spark, "previews")
    hold(previews.refresh(books, folder, "doc_id", make=_plain))
    changed = books.withColumn("updated_at", F.when(F.col("doc_id") % 5 == 0, F.lit("2999-01-01").cast("timestamp")).otherwise(F.col("updated_at")))
    return hold(previews.refresh(changed, folder, "doc_id", make=_plain)).select("id")


def _picture(members: dict) -> bytes:
    """The head of a PNG or JPEG image of this width and height, or a text."""
    kind, width, height = members["data"].split(" ")
    w, h = int(width), int(height)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + bytes(5)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + bytes(10) + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, h, w) + bytes(10) + b"\xff\xd9"
    return {"png": png, "jpeg": jpeg, "cut": jpeg[:12]}.get(kind, b"no image")


@query("src_image", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'not_image' END AS error, CASE doc_id % 5 WHEN 1 THEN 'png' WHEN 0 THEN NULL ELSE 'jpeg' END AS kind,
  CASE WHEN doc_id % 5 IN (1, 2, 3) THEN CAST(n_chars % 3000 + 1 AS INTEGER) END AS width, CASE WHEN doc_id % 5 IN (1, 2, 3) THEN CAST(doc_id % 2000 + 1 AS INTEGER) END AS height FROM documents""")
def _(spark, d):
    """Covers of a size by document, written as files and read back; one in five is no image, one is cut off in its header."""
    kind = F.element_at(F.array(*map(F.lit, ("text", "png", "jpeg", "jpeg", "cut"))), (F.col("doc_id") % 5 + 1).cast("int"))
    data = F.concat_ws(" ", kind, F.col("n_chars") % 3000 + 1, F.col("doc_id") % 2000 + 1)
    folder = new_folder(spark, "covers")
    hold(previews.refresh(table(spark, d, "documents").select("doc_id", F.create_map(F.lit("data"), data).alias("members"), F.lit("2024-01-01").cast("timestamp").alias("updated_at")), folder, "doc_id", make=_picture, ending="img"))
    key = F.regexp_extract("path", r"(\d+)\.img$", 1).cast("long")
    return files.images(spark, folder).select(key.alias("doc_id"), "error", "kind", "width", "height")

"""Views that give the star-schema and text tables the shape of books, blocks, visits and posts; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line of a document: (doc_id, pos) with type, level, page, role and include."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n, pos = F.length("line"), F.col("pos")
    return d.select(
        "doc_id", pos.cast("long").alias("pos"), "line",
        F.when(n.between(1, 40), "heading").otherwise("text").alias("type"),
        (1 + n % 3).cast("long").alias("level"),
        F.when(pos % 17 == 0, 0).otherwise(1 + F.floor(pos / 20)).cast("long").alias("page"),
        F.when(pos == 0, "title-page").when(pos % 11 == 10, "back").otherwise("body").alias("role"),
        ((pos != 0) & (pos % 7 != 6)).alias("include"),
    )


BLOCKS = """blocks AS (SELECT doc_id, pos, line,
  CASE WHEN length(line) BETWEEN 1 AND 40 THEN 'heading' ELSE 'text' END AS type, CAST(1 + length(line) % 3 AS BIGINT) AS level,
  CAST(CASE WHEN pos % 17 = 0 THEN 0 ELSE 1 + pos // 20 END AS BIGINT) AS page,
  CASE WHEN pos = 0 THEN 'title-page' WHEN pos % 11 = 10 THEN 'back' ELSE 'body' END AS role, (pos <> 0 AND pos % 7 <> 6) AS include
  FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: uid, title, author, language, is_published, ord, epub_size, cover_url, summary fields."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    id_ = F.col("doc_id")
    return d.join(labels, "doc_id", "left").select(
        id_.alias("uid"), F.substring("text", 1, 60).alias("title"), F.col("source").alias("author"), F.col("lang").alias("language"),
        F.coalesce(F.col("quality") == 1, F.lit(True)).alias("is_published"), (id_ % 5).alias("ord"), (F.col("n_chars") * 1337).alias("epub_size"),
        F.when(id_ % 3 == 0, F.concat(F.lit("/media/"), id_.cast("string"), F.lit("/cover.jpg"))).alias("cover_url"),
    )


BOOKS = """books AS (SELECT d.doc_id AS uid, substring(text, 1, 60) AS title, source AS author, lang AS language, coalesce(quality = 1, true) AS is_published,
  d.doc_id % 5 AS ord, n_chars * 1337 AS epub_size, CASE WHEN d.doc_id % 3 = 0 THEN '/media/' || d.doc_id || '/cover.jpg' END AS cover_url
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def book_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of each book, and whether they are included: (doc_id, notes, include_notes)."""
    id_ = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.slice(F.array(*map(F.lit, "abc")), F.lit(1), (id_ % 4).cast("int")).alias("notes"), (id_ % 3 != 0).alias("include_notes"))


BOOK_NOTES = "book_notes AS (SELECT doc_id, doc_id % 4 AS n, doc_id % 3 <> 0 AS include_notes FROM documents)"


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: conversion id, kind seen or left, time."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), "event_id", "ts", F.when(F.col("event_type") == "error", "left").otherwise("seen").alias("kind"))


VISITS = "visits AS (SELECT user_id AS id, event_id, ts, CASE WHEN event_type = 'error' THEN 'left' ELSE 'seen' END AS kind FROM events)"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("form"), (F.col("user_id") % 50).alias("visitor"), "ts", "event_id", F.when(F.col("event_id") % 11 == 0, "spam").otherwise("").alias("website"))


POSTS = "posts AS (SELECT event_type AS form, user_id % 50 AS visitor, ts, event_id, CASE WHEN event_id % 11 = 0 THEN 'spam' ELSE '' END AS website FROM events)"


def contact_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turn, conv = F.col("turn"), F.col("conv_id")
    return c.select(
        "conv_id", "turn", F.element_at(F.array(*map(F.lit, ("message", "problem", "copyright", "book"))), (conv % 4 + 1).cast("int")).alias("kind"),
        F.when(turn % 5 == 4, "").otherwise(F.col("text")).alias("text"), F.col("role").alias("name"),
        F.when(turn % 2 == 1, "").otherwise("https://example.org/x").alias("link"), F.when(turn % 3 == 0, "").otherwise("a@example.org").alias("email"),
        F.when(conv % 13 == 0, "spam").otherwise("").alias("website"),
    )


CONTACT = """contact_posts AS (SELECT conv_id, turn, list_extract(['message', 'problem', 'copyright', 'book'], conv_id % 4 + 1) AS kind,
  CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS text, role AS name, CASE WHEN turn % 2 = 1 THEN '' ELSE 'https://example.org/x' END AS link,
  CASE WHEN turn % 3 = 0 THEN '' ELSE 'a@example.org' END AS email, CASE WHEN conv_id % 13 = 0 THEN 'spam' ELSE '' END AS website FROM conversations)"""


def pdf_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.col("n_chars") * 4000).alias("size"), F.when(F.col("doc_id") % 9 == 0, "<html").otherwise("%PDF-").alias("head"), F.floor(F.col("n_chars") / 10).alias("pages"))


PDFS = "pdf_heads AS (SELECT doc_id, n_chars * 4000 AS size, CASE WHEN doc_id % 9 = 0 THEN '<html' ELSE '%PDF-' END AS head, n_chars // 10 AS pages FROM documents)"


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, as a reader's suggestion of a book."""
    d, id_ = table(spark, sf_dir, "documents"), F.col("doc_id")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (id_ % len(names) + 1).cast("int"))
    return d.select(
        "doc_id", F.when(id_ % 11 == 0, "").otherwise(F.substring("text", 1, 30)).alias("title"), F.col("source").alias("author"), F.col("text").alias("note"),
        (id_ % 3 != 0).alias("has_pdf"), (F.col("n_chars") * 4000).alias("size"), F.when(id_ % 9 == 0, "<html").otherwise("%PDF-").alias("head"), F.floor(F.col("n_chars") / 10).alias("pages"),
        pick("public_domain", "permission", "unsure", "other", "permission").alias("rights"), F.when(id_ % 2 == 0, "Holder").otherwise("").alias("holder"),
        F.when(id_ % 7 == 0, "not an address").when(id_ % 4 == 0, "").otherwise("r@example.org").alias("email"), pick("en", "ka", "fr").alias("lang"),
        F.when(id_ % 17 == 0, "spam").otherwise("").alias("website"), pick("new", "accepted", "declined").alias("status"),
    )


SUGGESTIONS = """suggestions AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE substring(text, 1, 30) END AS title, source AS author, text AS note,
  doc_id % 3 <> 0 AS has_pdf, n_chars * 4000 AS size, CASE WHEN doc_id % 9 = 0 THEN '<html' ELSE '%PDF-' END AS head, n_chars // 10 AS pages,
  list_extract(['public_domain', 'permission', 'unsure', 'other', 'permission'], doc_id % 5 + 1) AS rights, CASE WHEN doc_id % 2 = 0 THEN 'Holder' ELSE '' END AS holder,
  CASE WHEN doc_id % 7 = 0 THEN 'not an address' WHEN doc_id % 4 = 0 THEN '' ELSE 'r@example.org' END AS email, list_extract(['en', 'ka', 'fr'], doc_id % 3 + 1) AS lang,
  CASE WHEN doc_id % 17 = 0 THEN 'spam' ELSE '' END AS website, list_extract(['new', 'accepted', 'declined'], doc_id % 3 + 1) AS status FROM documents)"""

def book_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book as JSON for each document, its lines as blocks; spoilt in one of eight ways unless doc_id mod 9 is 8."""
    block = lambda x, i: F.struct(F.when(F.length(x) <= 40, "heading").otherwise("text").alias("type"), (i % 7 != 6).alias("include"), x.alias("text"), F.lit(1.5).alias("width"))
    meta = F.struct(F.substring("text", 1, 60).alias("title"), F.col("source").alias("author"), F.col("lang").alias("language"))
    whole = F.struct(F.lit(1).alias("version"), meta.alias("metadata"), F.transform(F.split("text", "\n"), block).alias("blocks"), F.array(F.lit("a"), F.lit("b")).alias("notes"), (F.col("doc_id") % 2 == 0).alias("include_notes"))
    json, case = F.to_json(whole), F.col("doc_id") % 9
    spoilt = F.when(case == 0, F.substring(json, 1, F.length(json) - 1)).when(case == 1, F.concat(F.lit("["), json, F.lit("]"))).when(case == 2, "null")
    spoilt = spoilt.when(case == 3, F.regexp_replace(json, '^\\{"version":1,"metadata":', '{"version":1,"meta":')).when(case == 4, F.regexp_replace(json, '"notes":\\["a","b"\\]', '"notes":"a"'))
    spoilt = spoilt.when(case == 5, F.replace(json, F.lit('],"notes":["a"'), F.lit(',7],"notes":["a"'))).when(case == 6, F.regexp_replace(json, '^\\{"version":1', '{"version":1,"version":1'))
    spoilt = spoilt.when(case == 7, F.regexp_replace(json, '(?s)"blocks":\\[.*\\],"notes":\\["a"', '"blocks":"none","notes":["a"'))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(spoilt, json).alias("json"))


ALL = {"blocks": BLOCKS, "book_notes": BOOK_NOTES, "books": BOOKS, "visits": VISITS, "posts": POSTS, "contact_posts": CONTACT, "pdf_heads": PDFS, "suggestions": SUGGESTIONS}


def sql(names: str, body: str) -> str:
    """The body with the named views before it."""
    return "WITH " + ", ".join(ALL[n] for n in names.split()) + ("" if body.lstrip().startswith(",") else " ") + body

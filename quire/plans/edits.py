"""Queries that edit nested blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import edits as ed
from quire.plans.base import on, query
from quire.sources.views import sql
from quire.sources import views

def in_order(struct: str):
    """The group's structs as an array by their pos. (Blocks hold maps, which have no order of their own.)"""
    return F.array_sort(F.collect_list(struct), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))


def nested(blocks: DataFrame) -> DataFrame:
    """One row a book: the blocks as an ordered array."""
    head = F.col("type") == "heading"
    none = F.expr("cast(array() as array<string>)")
    b = ed.block(type=F.col("type"), id=F.concat(F.lit("b"), F.col("pos").cast("string")), page=F.col("page").cast("int"), role=F.col("role"), include=F.col("include"), level=F.when(head, F.col("level").cast("int")), label=F.when(head, F.col("line")), text=F.when(~head, F.col("line")), lines=F.when(~head, none), verse=F.when(~head, F.lit(False)), notes=F.when(~head, F.expr(ed.EMPTY_NOTES)))
    rows = blocks.select("doc_id", F.struct("pos", b.alias("b")).alias("p")).groupBy("doc_id").agg(in_order("p").alias("p"))
    return rows.select("doc_id", F.transform("p", lambda p: p["b"]).alias("blocks"))


def edited(name: str, change, body: str) -> None:
    """A query that edits every book and lists its blocks; body: SQL for rows (doc_id, pos, type, id, page, include, level, words)."""
    def make(b: DataFrame) -> DataFrame:
        out = nested(b).select("doc_id", change(F.col("blocks")).alias("blocks")).select("doc_id", F.posexplode("blocks").alias("pos", "b"))
        return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "b.type", "b.id", F.col("b.page").cast("long").alias("page"), "b.include", F.col("b.level").cast("long").alias("level"), F.coalesce("b.label", "b.text").alias("words"))

    on("blocks", name, f", n AS (SELECT doc_id, pos, type, 'b' || pos AS id, page, role, include, CASE WHEN type = 'heading' THEN level END AS level, line AS words FROM blocks) {body}", make)


def case(**new: str) -> str:
    return "SELECT " + ", ".join(f"{new[c]} AS {c}" if c in new else c for c in ("doc_id", "pos", "type", "id", "page", "include", "level", "words")) + " FROM n"


edited("edit_block", lambda b: ed.edit_block(b, 2, page=99, include=True), case(page="CASE WHEN pos = 2 THEN 99 ELSE page END", include="pos = 2 OR include"))
edited("edit_splice", lambda b: ed.splice(b, 1, 3, F.slice(b, F.lit(1), F.lit(1))), "SELECT doc_id, CASE WHEN pos >= 3 THEN pos - 1 ELSE pos END AS pos, type, id, page, include, level, words FROM n WHERE pos = 0 OR pos >= 3 UNION ALL SELECT doc_id, 1, type, id, page, include, level, words FROM n WHERE pos = 0")
edited("edit_include_set", lambda b: ed.include_set(b, F.array(F.lit(1), F.lit(4)), False), case(include="include AND pos NOT IN (1, 4)"))
edited("edit_include_role", lambda b: ed.include_role(b, "back", False), case(include="include AND role <> 'back'"))
WS = r"[\t\n\x0B\f\r\p{Zs}\x{2028}\x{2029}\x{FEFF}]+"
trimmed = lambda x: f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"
edited("edit_to_heading", lambda b: ed.set_type(b, 1, "heading", 2), case(type="CASE WHEN pos = 1 THEN 'heading' ELSE type END", level="CASE WHEN pos = 1 THEN 2 ELSE level END", words=f"CASE WHEN pos = 1 AND type = 'text' THEN coalesce(nullif({trimmed('words')}, ''), '…') ELSE words END"))
edited("edit_to_text", lambda b: ed.set_type(b, 1, "text"), case(type="CASE WHEN pos = 1 THEN 'text' ELSE type END", level="CASE WHEN pos <> 1 THEN level END"))
edited("edit_set_type", lambda b: ed.set_type(b, 0, "heading", 3), case(type="CASE WHEN pos = 0 THEN 'heading' ELSE type END", level="CASE WHEN pos = 0 THEN 3 ELSE level END", words=f"CASE WHEN pos = 0 AND type = 'text' THEN coalesce(nullif({trimmed('words')}, ''), '…') ELSE words END"))
edited("edit_heading_above", lambda b: ed.heading_above(b, 2, "new"), """, big AS (SELECT doc_id, max(pos) AS m, coalesce(arg_max(level, pos) FILTER (pos < 2 AND type = 'heading'), 1) AS l, max(page) FILTER (pos = 2) AS p FROM n GROUP BY doc_id)
  SELECT doc_id, CASE WHEN pos >= 2 THEN pos + 1 ELSE pos END AS pos, type, id, page, include, level, words FROM n UNION ALL SELECT doc_id, least(2, m + 1), 'heading', 'new', p, true, l, '…' FROM big""")
edited("edit_split", lambda b: ed.split_at(b, 0, 30, "new"), f""", c AS (SELECT doc_id FROM n WHERE pos = 0 AND type = 'text' AND {trimmed('substring(words, 1, 30)')} <> '' AND {trimmed('substring(words, 31)')} <> '')
  SELECT n.doc_id, CASE WHEN c.doc_id IS NOT NULL AND pos > 0 THEN pos + 1 ELSE pos END AS pos, type, id, page, include, level, CASE WHEN c.doc_id IS NOT NULL AND pos = 0 THEN {trimmed('substring(words, 1, 30)')} ELSE words END AS words FROM n LEFT JOIN c ON n.doc_id = c.doc_id
  UNION ALL SELECT n.doc_id, 1, type, 'new', page, include, level, {trimmed('substring(words, 31)')} FROM n JOIN c ON n.doc_id = c.doc_id WHERE pos = 0""")
edited("edit_join", lambda b: ed.join_at(b, 1), """, j AS (SELECT a.doc_id, a.words || ' ' || b.words AS words FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.pos = 1 AND b.pos = 2 AND a.type = 'text' AND b.type = 'text')
  SELECT n.doc_id, CASE WHEN j.doc_id IS NOT NULL AND pos > 2 THEN pos - 1 ELSE pos END AS pos, type, id, page, include, level, CASE WHEN j.doc_id IS NOT NULL AND pos = 1 THEN j.words ELSE n.words END AS words FROM n LEFT JOIN j ON n.doc_id = j.doc_id WHERE NOT (j.doc_id IS NOT NULL AND pos = 2)""")
edited("edit_verse_text", lambda b: ed.verse_text(b, 0, F.lit("one\ntwo")), "SELECT doc_id, pos, type, id, page, include, level, CASE WHEN pos = 0 AND type = 'text' THEN 'one two' ELSE words END AS words FROM n")
on("books", "edit_metadata", "SELECT uid, title || '!' AS title, CASE WHEN uid % 2 = 0 THEN NULL ELSE author END AS author FROM books", lambda b: b.select("uid", ed.metadata(F.struct("title", "author"), title=F.concat(F.col("title"), F.lit("!")), author=F.when(F.col("uid") % 2 == 0, "").otherwise(F.col("author"))).alias("m")).select("uid", "m.title", "m.author"))
on("books", "edit_cover", "SELECT uid, '' AS cover, 'none' AS cover_source FROM books", lambda b: ed.set_cover(b, None).select("uid", "cover", "cover_source"))


def _pictures(spark, d) -> tuple[DataFrame, DataFrame]:
    """Stored and incoming books where each third line is a picture; of the stored ones every second is known."""
    base = views.blocks(spark, d)
    pic = lambda keep: ed.block(type=F.when(F.col("pos") % 3 == 0, "picture").otherwise("text"), id=F.concat(F.lit("b"), F.col("pos").cast("string")), text="t", data=F.when(F.col("pos") % 3 == 0, keep))
    make = lambda rows, data: rows.select("doc_id", F.struct("pos", pic(data).alias("b")).alias("p")).groupBy("doc_id").agg(in_order("p").alias("p")).select("doc_id", F.transform("p", lambda p: p["b"]).alias("blocks"))
    return make(base, F.lit("sent")), make(base.where("pos % 2 = 0"), F.concat(F.lit("jpeg"), F.col("pos").cast("string")))


PICS = "SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN CASE WHEN pos % 2 = 0 THEN 'jpeg' || pos ELSE '' END END AS data{more} FROM blocks"


@query("edit_strip_pictures", sql("blocks", "SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN '' END AS data FROM blocks"))
def _(spark, d):
    incoming, _ = _pictures(spark, d)
    return incoming.select("doc_id", F.posexplode(ed.strip_pictures(F.col("blocks"))).alias("pos", "b")).select("doc_id", F.col("pos").cast("long").alias("pos"), "b.data")


@query("join_picture_restore", sql("blocks", PICS.format(more="")))
def _(spark, d):
    incoming, stored = _pictures(spark, d)
    return ed.picture_rows(incoming, stored).select("doc_id", F.col("pos").cast("long").alias("pos"), "b.data")


@query("edit_save_merge", sql("blocks", PICS.format(more=", CAST(NULL AS VARCHAR) AS cover, 'found' AS cover_source")))
def _(spark, d):
    incoming, stored = _pictures(spark, d)
    merged = ed.save_merge(incoming.withColumn("cover", F.lit("x")).withColumn("cover_source", F.lit("sent")), stored.withColumn("cover", F.lit("y")).withColumn("cover_source", F.lit("found")))
    return merged.select("doc_id", F.posexplode("blocks").alias("pos", "b"), "cover", "cover_source").select("doc_id", F.col("pos").cast("long").alias("pos"), "b.data", "cover", "cover_source")

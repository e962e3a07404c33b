"""Queries of rule chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import intake as it
from quire.plans.base import cols, on, query
from quire.sources import books as bk
from quire.sources import views

PDF = "CASE WHEN size > 104857600 THEN 'too_big' WHEN head <> '%PDF-' THEN 'not_pdf' WHEN pages = 0 THEN 'unreadable' WHEN pages > 2000 THEN 'too_many_pages' END"
pdf = lambda: it.pdf_code(F.col("size"), F.col("head"), F.col("pages"))
cols("chk_pdf", "pdf_heads", "doc_id", lambda: {"code": pdf()}, {"code": PDF})
cols("chk_upload", "pdf_heads", "doc_id", lambda: {"code": it.upload_code(F.col("doc_id") % 5 != 0, F.col("size"), F.col("head"), F.col("pages"))}, {"code": f"CASE WHEN doc_id % 5 = 0 THEN 'no_file' ELSE {PDF} END"})
cols("chk_pdf_client", "pdf_heads", "doc_id", lambda: {"code": it.pdf_client_code(F.when(F.col("head") == "%PDF-", "application/pdf").otherwise("text/html"), F.lit("a.txt"), F.col("size"))}, {"code": "CASE WHEN head <> '%PDF-' THEN 'not_pdf' WHEN size > 104857600 THEN 'too_big' END"})
MESSAGE = "CASE WHEN website <> '' THEN 'trap' WHEN turn > 8 THEN 'too_many' WHEN text = '' THEN 'no_text' WHEN length(text) > 1000 OR length(name) > 200 OR length(email) > 254 OR length(link) > 500 THEN 'too_long' WHEN kind = 'copyright' AND link = '' THEN 'no_link' WHEN kind = 'copyright' AND email = '' THEN 'no_email' END"
cols("chk_message", "contact_posts", "conv_id turn", lambda: {"code": it.message_code(F.col("turn") > 8, 1000)}, {"code": MESSAGE})
KIND = "CASE WHEN turn % 7 = 6 THEN '' WHEN turn % 7 = 5 THEN 'other' WHEN turn % 7 <> 4 THEN kind END"
BOOKED = "CASE WHEN website <> '' THEN 'trap' WHEN turn > 8 THEN 'too_many' WHEN text = '' THEN 'no_title' WHEN length(text) > 300 THEN 'too_long' END"


def _any_kind(c: DataFrame) -> DataFrame:
    """Posts of every kind, of none and of an unknown one, with the fields of a suggested book."""
    turn, empty = F.col("turn") % 7, F.lit("")
    kind = F.when(turn == 6, "").when(turn == 5, "other").when(turn != 4, F.col("kind"))
    return c.withColumns({"kind": kind, "title": F.col("text"), "author": empty, "note": empty, "holder": empty, "rights": empty, "has_pdf": F.lit(False), "size": F.lit(0), "head": empty, "pages": F.lit(0)})


on("contact_posts", "chk_contact", f"SELECT conv_id, turn, CASE WHEN {KIND} = 'book' THEN {BOOKED} WHEN coalesce({KIND}, 'message') NOT IN ('message', 'problem', 'copyright') THEN 'bad_kind' ELSE {MESSAGE.replace('kind =', f'{KIND} =')} END AS code FROM contact_posts", lambda c: _any_kind(c).select("conv_id", "turn", it.contact_code(F.col("turn") > 8, 1000).alias("code")))
SUGGEST = "CASE WHEN website <> '' THEN 'trap' WHEN doc_id % 50 = 49 THEN 'too_many' WHEN title = '' THEN 'no_title' WHEN length(note) > 2000 THEN 'too_long' WHEN email = 'not an address' THEN 'bad_email' WHEN NOT has_pdf THEN NULL WHEN size > 104857600 THEN 'too_big' WHEN head <> '%PDF-' THEN 'not_pdf' WHEN pages = 0 THEN 'unreadable' WHEN pages > 2000 THEN 'too_many_pages' WHEN rights = 'other' THEN 'no_rights' WHEN rights = 'permission' AND holder = '' THEN 'no_holder' END"
cols("chk_suggestion", "suggestions", "doc_id", lambda: {"code": it.suggestion_code(F.col("doc_id") % 50 == 49)}, {"code": SUGGEST})
on("suggestions", "prj_suggestion_row", "SELECT doc_id, CASE WHEN has_pdf THEN rights ELSE '' END AS rights, CASE WHEN has_pdf AND rights = 'permission' THEN holder ELSE '' END AS holder, CASE WHEN lang IN ('en', 'ka') THEN lang ELSE 'en' END AS lang FROM suggestions", lambda s: it.suggestion_row(s).select("doc_id", "rights", "holder", "lang"))
on("contact_posts", "chk_contact_client", "SELECT conv_id, turn, CASE WHEN kind = 'book' AND turn % 3 <> 2 THEN 'no_title' WHEN kind = 'book' AND turn % 4 < 2 AND turn % 5 = 0 THEN 'no_rights' WHEN kind = 'book' AND turn % 4 < 2 AND turn % 5 <> 1 THEN 'no_holder' WHEN kind = 'copyright' AND link = '' THEN 'no_link' WHEN kind <> 'book' AND (text = '' OR conv_id % 3 = 0) THEN 'no_text' WHEN kind = 'copyright' AND email = '' THEN 'no_email' END AS code FROM contact_posts",
    lambda c: c.withColumn("text", F.when(F.col("conv_id") % 3 == 0, "\t \ufeff\n").otherwise(F.col("text"))).withColumn("link", F.when(F.col("link") == "", " ").otherwise(F.col("link"))).select("conv_id", "turn", it.contact_client_code(F.expr("element_at(array('', '  ', 'title'), cast(turn % 3 + 1 as int))"), F.col("turn") % 4 < 2, F.expr("element_at(array('', 'unsure', 'permission', 'permission', 'permission'), cast(turn % 5 + 1 as int))"), F.lit("  ")).alias("code")))
sent_fields = lambda: it.client_fields({"message": ["name", "email"], "problem": ["name", "link"], "copyright": ["name", "link", "email"], "book": ["name"]})
cols("prj_contact_client", "contact_posts", "conv_id turn", lambda: {"sent": F.array_join(F.sort_array(F.map_keys(sent_fields())), ",")}, {"sent": "concat_ws(',', CASE WHEN kind IN ('message', 'copyright') AND email <> '' THEN 'email' END, CASE WHEN kind IN ('problem', 'copyright') AND link <> '' THEN 'link' END, 'name')"})
cols("chk_cover", "pdf_heads", "doc_id", lambda: {"code": it.cover_code(F.col("doc_id") % 6 != 0, F.col("size"), F.col("head") != "%PDF-")}, {"code": "CASE WHEN doc_id % 6 = 0 THEN 'no_file' WHEN size > 10485760 THEN 'too_big' WHEN head = '%PDF-' THEN 'not_image' END"})
query("chk_book_put", "SELECT doc_id, CASE WHEN doc_id % 9 <> 8 THEN 'bad_book' END AS code FROM documents")(
    lambda s, d: bk.read_books(views.book_texts(s, d), "json").select("doc_id", it.book_code(F.col("metadata"), F.col("blocks")).alias("code")))
flag = lambda n: F.col("doc_id") % n == 0
book_form = lambda: it.book_form(flag(3), flag(2), flag(4), flag(5), flag(10), flag(11), F.when(flag(7), "").otherwise("t"), F.when(flag(14), "").otherwise("from data"))
DATA = "(doc_id % 3 = 0 OR doc_id % 4 = 0)"
TITLE = f"CASE WHEN doc_id % 7 <> 0 THEN 't' WHEN {DATA} AND doc_id % 14 <> 0 THEN 'from data' ELSE '' END"
ERR = f"CASE WHEN doc_id % 3 = 0 AND doc_id % 2 <> 0 THEN 'data_file' WHEN NOT {DATA} AND doc_id % 5 <> 0 THEN 'epub' WHEN {TITLE} = '' THEN 'title' END"
cols("chk_book_form", "documents", "doc_id", lambda: {x: book_form()[x] for x in ("error", "title", "rewrite")}, {"error": ERR, "title": TITLE, "rewrite": f"({ERR}) IS NULL AND {DATA} AND (doc_id % 3 = 0 OR doc_id % 11 = 0 OR doc_id % 10 <> 0)"})
cols("chk_library_add", "orders", "o_orderkey", lambda: {"result": it.library_add(F.when(F.col("o_orderstatus") == "F", "ready").otherwise("reading"), F.col("o_orderkey") % 3)}, {"result": "CASE WHEN o_orderstatus <> 'F' THEN 'not_ready' WHEN o_orderkey % 3 > 0 THEN 'unwritable' ELSE 'added' END"})

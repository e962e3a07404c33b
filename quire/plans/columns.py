"""Queries of column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalar as fn
from quire.operators import blocks as bl
from quire.plans.base import cols, on, query
from quire.plans.parts import CLAMP, WITH_NOTES
from quire.sources.views import sql
from quire.sources import views

cols("fn_file_size", "documents", "doc_id", lambda: {"size": fn.file_size(F.col("n_chars") * 997)}, {"size": "CASE WHEN n_chars * 997 < 1048576 THEN greatest(1, (n_chars * 997 * 2 + 1024) // 2048) || ' KB' ELSE ((n_chars * 997 * 20 + 1048576) // 2097152) // 10 || '.' || ((n_chars * 997 * 20 + 1048576) // 2097152) % 10 || ' MB' END"})
cols("fn_fill", "documents", "doc_id", lambda: {"text": fn.fill(F.lit("{source} has {n} and {other} {"), F.create_map(F.lit("source"), F.col("source"), F.lit("n"), F.col("n_chars").cast("string")))}, {"text": "source || ' has ' || n_chars || ' and {other} {'"})
cols("fn_heading_text", "books", "uid", lambda: {"text": fn.heading_text(F.col("author"), F.when(F.col("uid") % 3 == 0, F.col("title")).when(F.col("uid") % 3 == 1, ""))}, {"text": "CASE WHEN uid % 3 = 0 AND title <> '' THEN author || ': ' || title ELSE author END"})
cols("fn_str_book", "books", "uid", lambda: {"text": fn.book_name(F.col("title"), F.when(F.col("uid") % 4 == 0, "").otherwise(F.col("author")))}, {"text": "CASE WHEN uid % 4 = 0 THEN title ELSE title || ' — ' || author END"})
cols("fn_str_message", "contact_posts", "conv_id turn", lambda: {"text": fn.message_name(F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("name")), F.col("email"), F.col("text"))}, {"text": "coalesce(CASE WHEN turn % 2 = 0 THEN NULL ELSE nullif(name, '') END, nullif(email, ''), 'Someone') || ': ' || substring(text, 1, 60)"})
cols("fn_str_conversion", "orders", "o_orderkey", lambda: {"text": fn.conversion_name("Order", F.col("o_orderkey"), F.col("o_orderstatus"))}, {"text": "'Order ' || o_orderkey || ' (' || o_orderstatus || ')'"})
cols("fn_coalesce_title", "books", "uid", lambda: {"title": fn.either(F.when(F.col("uid") % 2 == 0, F.col("title")), F.col("author"))}, {"title": "CASE WHEN uid % 2 = 0 AND title <> '' THEN title ELSE author END"})
cols("fn_visitor", "events", "event_id", lambda: {"visitor": fn.either(F.when(F.col("user_id") % 2 == 0, "").otherwise(F.col("user_id").cast("string")), F.when(F.col("user_id") % 3 == 0, F.col("event_type")))}, {"visitor": "coalesce(CASE WHEN user_id % 2 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END, CASE WHEN user_id % 3 = 0 THEN event_type END, '')"})
cols("fn_stem", "pages", "page_id", lambda: {"stem": fn.stem(F.col("url"))}, {"stem": r"regexp_replace(url, '^(.+)\.[^.]*$', '\1')"})
cols("fn_url_quote", "documents", "doc_id", lambda: {"quoted": fn.url_quote(F.col("text"))}, {"quoted": "replace(url_encode(text), '%2F', '/')"})
FILE = "concat(url, CASE page_id % 5 WHEN 1 THEN '.css' WHEN 2 THEN '.CSS' WHEN 3 THEN '/.jpg' WHEN 4 THEN '.x.xhtml' ELSE '' END)"
TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fn.MEDIA_TYPES.items())
cols("fn_media_type", "pages", "page_id", lambda: {"type": fn.media_type(F.expr(FILE))}, {"type": rf"CASE regexp_extract({FILE}, '[^/]\.([^./]+)$', 1) {TYPES} ELSE 'application/octet-stream' END"})
cols("fn_label_or_code", "books", "uid", lambda: {"label": fn.label_or_code(F.col("language"), {"en": "English", "fr": "French"})}, {"label": "CASE language WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE language END"})
cols("fn_error_code", "events", "event_id", lambda: {"code": fn.error_code(F.col("event_type"), ["error", "signup"])}, {"code": "CASE WHEN event_type IN ('error', 'signup') THEN event_type ELSE 'server' END"})
cols("fn_plural", "documents", "doc_id", lambda: {"text": fn.plural(F.col("n_chars"), "one character", "{n} characters")}, {"text": "CASE WHEN n_chars = 1 THEN 'one character' ELSE n_chars || ' characters' END"})
cols("fn_percent", "lineitem", "l_orderkey l_linenumber l_partkey", lambda: {"percent": fn.percent(F.col("l_discount"))}, {"percent": "CAST(floor(l_discount * 100 + 0.5) AS BIGINT)"})
cols("fn_clamp_width", "documents", "doc_id", lambda: {"width": fn.clamp_width(F.lit(700), F.lit(600), F.col("n_chars")).cast("long")}, {"width": CLAMP.format(w=700, a="600", b="n_chars")})
WIDTHS = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'x1' WHEN 3 THEN CAST(n_chars AS VARCHAR) END"
cols("fn_width_ok", "documents", "doc_id", lambda: {"width": fn.width_ok(F.expr(WIDTHS.replace("VARCHAR", "STRING")))}, {"width": "CASE WHEN doc_id % 4 = 2 THEN 700 WHEN doc_id % 4 = 3 AND n_chars BETWEEN 100 AND 1600 THEN CAST(n_chars AS INTEGER) END"})
cols("fn_cover_version", "events", "event_id", lambda: {"url": fn.cover_version(F.when(F.col("user_id") % 2 == 0, "/c.jpg"), F.col("ts"))}, {"url": "CASE WHEN user_id % 2 = 0 THEN '/c.jpg?v=' || CAST(floor(epoch(ts)) AS BIGINT) END"})
cols("fn_is_email", "suggestions", "doc_id", lambda: {"ok": fn.is_email(F.col("email"))}, {"ok": "email = 'r@example.org'"})
cols("fn_too_long", "suggestions", "doc_id", lambda: {"long": fn.too_long({"note": 2000, "title": 300})}, {"long": "(length(note) > 2000 OR length(title) > 300)"})
cols("fn_base_href", "pages", "page_id", lambda: {"html": fn.base_href(F.col("html"), F.col("url"))}, {"html": r"""regexp_replace(html, '^(.*?<head(\s[^>]*)?>)', '\1<base href="' || regexp_extract(url, '^(.*/)', 1) || '">', 'is')"""})
cols("fn_before_head_end", "pages", "page_id", lambda: {"html": fn.before_head_end(F.col("html"), "<style>p{}</style>")}, {"html": r"regexp_replace(html, '(</head>)', '<style>p{}</style>\1', 'i')"})
cols("fn_notes_in", "documents", "doc_id", lambda: {"notes": F.array_join(F.sort_array(F.map_keys(fn.notes_in(F.create_map(F.lit("1"), F.lit("a"), F.lit("2"), F.lit("b"), F.col("lang"), F.lit("c")), F.concat(F.lit("see [1] and ["), F.col("lang"), F.lit("]"))))), ",")}, {"notes": "'1,' || lang"})
disposition = lambda: F.concat(F.lit("attachment; filename"), F.element_at(F.array(F.concat(F.lit("*=UTF-8''C++%20"), F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))), F.lit("=plain.epub"), F.lit("*=UTF-8''%zz"), F.concat(F.lit("*=UTF-8''"), F.col("source"), F.lit(".epub; x=1"))), (F.col("doc_id") % 4 + 1).cast("int")))
NAMES = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  ' ELSE concat(' ', source, ' ') END"
cols("fn_epub_name", "documents", "doc_id", lambda: {"name": fn.epub_name(F.expr(NAMES), F.expr("CASE WHEN doc_id % 8 > 3 THEN lang ELSE ' ' END")), "header": fn.attachment(F.concat(F.col("source"), F.lit(" é.epub")))}, {"name": "CASE WHEN doc_id % 4 = 3 THEN source WHEN doc_id % 4 = 2 OR doc_id % 8 <= 3 THEN 'book' ELSE lang END", "header": "'attachment; filename*=UTF-8' || chr(39) || chr(39) || url_encode(source || ' é.epub')"})
cols("fn_filename_header", "documents", "doc_id", lambda: {"name": fn.header_filename(disposition(), "book.epub")}, {"name": "CASE doc_id % 4 WHEN 0 THEN 'C++ ' || text WHEN 3 THEN source || '.epub' ELSE 'book.epub' END"})
cookies = lambda: F.element_at(F.array(F.concat(F.lit("a=1;  token="), F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20")), F.lit("+; z=2")), F.concat(F.lit("token="), F.col("lang"), F.lit("; token=second")), F.lit("mytoken=1; token2=2"), F.lit("token=%zz"), F.lit("a=1; token=")), (F.col("doc_id") % 5 + 1).cast("int"))
cols("fn_cookie", "documents", "doc_id", lambda: {"token": fn.cookie(cookies(), "token")}, {"token": "CASE doc_id % 5 WHEN 0 THEN text || '+' WHEN 1 THEN lang ELSE '' END"})
cols("fn_rows", "documents", "doc_id", lambda: {"rows": fn.rows_for(F.col("text")).cast("long")}, {"rows": "CAST(least(12, greatest(3, ceil(length(text) / 70.0))) AS BIGINT)"})
cols("fn_thousands", "documents", "doc_id", lambda: {"text": fn.thousands(F.col("n_chars"))}, {"text": "format('{:,}', n_chars)"})
cols("fn_text_links", "documents", "doc_id", lambda: {"links": F.array_join(F.transform(fn.text_links(F.concat(F.lit("go ["), F.col("lang"), F.lit("](/x) or [b](http://y)."))), lambda x: F.concat_ws("|", x["text"], x["label"], x["target"], x["internal"].cast("string"))), ";")}, {"links": "'go |' || lang || '|/x|true; or |b|http://y|false;.'"})
commit = lambda: F.when(F.col("doc_id") % 3 != 0, F.md5(F.col("doc_id").cast("string")))
COMMIT = "CASE WHEN doc_id % 3 <> 0 THEN md5(CAST(doc_id AS VARCHAR)) END"
cols("fn_version", "documents", "doc_id", lambda: {"version": fn.version_label(F.concat(F.lit("1."), F.col("doc_id").cast("string"), F.lit("+abc+d"))), "commit": fn.commit_label(commit()), "link": fn.code_link(commit(), "https://c")}, {"version": "'1.' || doc_id", "commit": f"substring(coalesce({COMMIT}, ''), 1, 7)", "link": f"coalesce('https://c/tree/' || {COMMIT}, 'https://c')"})
cols("fn_page_title", "documents", "doc_id", lambda: {"title": fn.page_title(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""), "Site")}, {"title": "CASE WHEN doc_id % 2 = 0 THEN source || ' · Site' ELSE 'Site' END"})
cols("fn_facts", "books", "uid", lambda: {"facts": F.array_join(F.transform(fn.facts(("language", F.col("language")), ("chapters", F.col("ord")), ("size", fn.file_size(F.col("epub_size")))), lambda x: F.concat(x["label"], F.lit("="), x["value"])), ";")}, {"facts": "'language=' || language || CASE WHEN ord = 0 THEN '' ELSE ';chapters=' || ord END || ';size=' || CASE WHEN epub_size < 1048576 THEN greatest(1, (epub_size * 2 + 1024) // 2048) || ' KB' ELSE ((epub_size * 20 + 1048576) // 2097152) // 10 || '.' || ((epub_size * 20 + 1048576) // 2097152) % 10 || ' MB' END"})


@query("fn_contents_line", sql("blocks book_notes", f", {WITH_NOTES} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'No book data: the EPUB is the uploaded file.' ELSE headings || ' headings, ' || paragraphs || ' paragraphs, ' || notes || ' notes' END AS line FROM summary"))
def _(spark, d):
    kept = F.col("doc_id") % 5 != 0
    return bl.counts(views.blocks(spark, d), views.book_notes(spark, d)).select("doc_id", fn.contents_line(*[F.when(kept, F.col(c)) for c in ("headings", "paragraphs", "notes")]).alias("line"))


cols("fn_has_pdf", "pages", "page_id", lambda: {"has_pdf": fn.has_file(F.col("url"))}, {"has_pdf": "url <> ''"})
on("documents", "fn_slug", None, lambda d: d.select("doc_id", fn.slug(F.col("text")).alias("slug")))
RUNS = r"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS run, piece AS text, italic, bold FROM (
 SELECT page_id, n, piece, coalesce(last_value(CASE WHEN n % 2 = 1 AND piece IN ('i>', '/i>') THEN piece = 'i>' END IGNORE NULLS) OVER w, false) AS italic,
  coalesce(last_value(CASE WHEN n % 2 = 1 AND piece IN ('b>', '/b>') THEN piece = 'b>' END IGNORE NULLS) OVER w, false) AS bold, n % 2 = 1 AND regexp_matches(piece, '^/?[ib]>$') AS tag
 FROM (SELECT page_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS piece FROM (SELECT page_id, string_split(regexp_replace(html, '<(/?)([ib])>', chr(1) || '\1\2>' || chr(1), 'g'), chr(1)) AS l FROM pages))
 WINDOW w AS (PARTITION BY page_id ORDER BY n ROWS UNBOUNDED PRECEDING)) WHERE NOT tag AND piece <> ''"""
on("pages", "fn_styled_runs", RUNS, lambda p: bl.styled_runs(p, "page_id", "html"))

"""Cases that the driver's tables do not hold."""

from pyspark.sql import functions as F

from quire.functions import scalar as fn
from quire.operators import blocks as bl
from quire.operators import edits as ed
from quire.operators import intake as it
from quire.operators import library as li
from quire.operators import presence as pr
from quire.operators import tables as tb
from quire.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_sizes_and_strings(spark):
    size = lambda n: fn.file_size(F.lit(n).cast("long"))
    assert one(spark, size(300), size(240 * 1024), size(1572864), size(0)) == ("1 KB", "240 KB", "1.5 MB", "1 KB")
    assert one(spark, fn.strip(F.lit("\t a  ")), fn.strip(F.lit(None).cast("string"))) == ("a", "")
    assert one(spark, fn.heading_text(F.lit("I"), F.lit("")), fn.heading_text(F.lit("I"), F.lit("One"))) == ("I", "I: One")
    assert one(spark, fn.stem(F.lit("a.b.pdf")), fn.stem(F.lit(".hidden")), fn.url_quote(F.lit("a b/é~*"))) == ("a.b", ".hidden", "a%20b/%C3%A9~%2A")
    assert one(spark, fn.slug(F.lit("Ａ  Book! ა")), fn.slug(F.lit("!!"))) == ("a-book-ა.epub", "book.epub")


def test_fill_reads_inserted_values_once(spark):
    values = F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("x"))
    assert one(spark, fn.fill(F.lit("{a} {b} {c} {"), values)) == ("{b} x {c} {",)


def test_head_insertions_take_the_first(spark):
    html = F.lit("<HEAD lang='x'></HEAD><head></head>")
    assert one(spark, fn.base_href(html, F.lit("http://s/a/b"))) == ("<HEAD lang='x'><base href=\"http://s/a/\"></HEAD><head></head>",)
    assert one(spark, fn.before_head_end(html, "!"), fn.before_head_end(F.lit("none"), "!")) == ("<HEAD lang='x'>!</HEAD><head></head>", "none")


def test_styled_runs(spark):
    df = spark.createDataFrame([(1, "a<i>b<b>c</i>d</u></b>e<i>")], "k int, t string")
    got = [tuple(r)[2:] for r in bl.styled_runs(df, "k", "t").orderBy("run").collect()]
    assert got == [("a", False, False), ("b", True, False), ("c", True, True), ("d</u>", False, True), ("e", False, False)]


def test_email_and_limits(spark):
    assert one(spark, fn.is_email(F.lit("a.b@c.de")), fn.is_email(F.lit("a@b")), fn.is_email(F.lit("a b@c.de"))) == (True, False, False)
    assert one(spark, *[fn.width_ok(F.lit(w).cast("string")) for w in ("", None, "99", "1600", "1601", "x", "700.5")]) == (None, 700, None, 1600, None, None, None)


def test_cookies_and_file_names_as_a_browser_reads_them(spark):
    token = lambda header: fn.cookie(F.lit(header), "token")
    got = one(spark, *map(token, ("token=a+b%20c; token=second", "mytoken=1;\ttoken=%C3%A9", "x=1", "token=", "token=%zz", "token=%C3")), fn.cookie(F.lit(None).cast("string"), "token"))
    assert got == ("a+b c", "é", "", "", "", "", "")
    name = lambda header: fn.header_filename(F.lit(header), "book.epub")
    assert one(spark, *map(name, ("attachment; filename*=UTF-8''C++%20book.epub; x=1", "attachment; filename=a.epub", "filename*=UTF-8''%zz"))) == ("C++ book.epub", "book.epub", "book.epub")


def test_blank_fields_are_missing(spark):
    def code(kind, title="t", **more):
        row = {"kind": kind, "link": "l", "text": "t", "email": "e"} | more
        return spark.createDataFrame([tuple(row.values())], "kind string, link string, text string, email string").select(it.contact_client_code(F.lit(title), F.lit(True), F.lit("permission"), F.lit("\u3000"))).first()[0]

    assert [code("book", "  "), code("book"), code("copyright", link=" \t"), code("message", text="\ufeff"), code("copyright", email=" "), code("message", email="")] == ["no_title", "no_holder", "no_link", "no_text", "no_email", None]


def test_media_rules(spark):
    rule = lambda p: li.media_rule(F.lit(p))
    paths = ("conversions/x.pdf", "conversions/1/cover.jpg", "conversions/1/source.pdf", "conversions/1/", "conversions/1/a/cover.jpg", "conversions/cover.jpg", "suggestions/a.pdf", "covers/a.jpg")
    assert one(spark, *[rule(f"/media/{p}") for p in paths]) == ("attachment", "serve", "deny", "deny", "deny", "serve", "attachment", "serve")


def test_info_has_the_whole_commit(spark):
    row = files.info("1.0", "0123456789abcdef", spark.createDataFrame([(3,)], "count long")).first()
    assert row.asDict() == {"engine": "1.0", "commit": "0123456789abcdef", "converted": 3}


def test_search_has_no_wildcards_and_spans_the_seam(spark):
    b = spark.createDataFrame([(1, "One", "Ada", 0), (2, "100%", "Éva", 0)], "uid int, title string, author string, ord int")
    assert [r.uid for r in li.search(b, "e a").collect()] == [1]
    assert [r.uid for r in li.search(b, "%").collect()] == [2]
    assert li.search(b, "o_e").count() == 0 and li.search(b, "").count() == 2
    assert li.search(b, "éva").count() == 1 and li.admin_search(b, "éva", ["author"]).count() == 0


def text_block(text, **more):
    fields = {"type": "text", "id": "t", "page": 1, "role": "body", "include": True, "text": text, "lines": F.expr("cast(array() as array<string>)"), "verse": False, "notes": F.expr(ed.EMPTY_NOTES)}
    return ed.block(**(fields | more))


def test_split_and_join(spark):
    b = text_block("one two [1]", notes=F.create_map(F.lit("1"), F.lit("n1"), F.lit("2"), F.lit("n2")))
    (parts,) = one(spark, ed.split(b, 4, "new"))
    assert [(p.text, p.id, p.notes) for p in parts] == [("one", "t", {}), ("two [1]", "new", {"1": "n1"})]
    (joined,) = one(spark, ed.join(F.lit(None) if False else F.get(ed.split(b, 4, "new"), 0), F.get(ed.split(b, 4, "new"), 1)))
    assert (joined.text, joined.notes) == ("one two [1]", {"1": "n1"})
    assert one(spark, ed.split(b, 0, "new")) == (None,)
    verse = text_block("a b c", verse=True, lines=F.array(*map(F.lit, "abc")))
    (parts,) = one(spark, ed.split(verse, 2, "new"))
    assert [(p.text, p.lines) for p in parts] == [("a", ["a"]), ("b c", ["b", "c"])]


def test_browser_trim(spark):
    odd = "\t\u00a0\u3000\ufeff x\u0085\u2028\n "
    b = text_block(odd)
    (h,) = one(spark, ed.to_heading(b, 2))
    assert h.label == "x\u0085" and one(spark, fn.trim(F.lit(None).cast("string"))) == (None,)
    assert one(spark, ed.split(text_block("a \t\u00a0"), 1, "new"))[0] is None
    (parts,) = one(spark, ed.split(text_block("a\u00a0\tb", verse=True), 2, "new"))  # verse without lines is prose
    assert [(p.text, p.lines) for p in parts] == [("a", []), ("b", [])]
    verse = text_block("", verse=True, lines=F.array(F.lit(""), F.lit("b")))
    assert [p.text for p in one(spark, ed.split(verse, 1, "new"))[0]] == ["", "b"]
    assert one(spark, ed.split(verse, 0, "new")) == (None,)


def test_pictures_without_id(spark):
    pic = lambda i, d: ed.block(type="picture", id=F.lit(i).cast("string"), data=d)
    books = lambda d: spark.range(1).select(F.lit(1).alias("doc_id"), F.array(pic(None, d), pic("p", d), pic("q", d)).alias("blocks"))
    stored = spark.range(1).select(F.lit(1).alias("doc_id"), F.array(pic(None, "a"), pic("p", "b")).alias("blocks"))
    assert [b.data for b in ed.restore_pictures(books("sent"), stored).first().blocks] == ["", "b", ""]


def test_problems_of_pictures(spark):
    rows = [(1, 0, "picture", "p1", True, "/9ggcGljdHVyZQ==", 30, 20), (1, 1, "picture", "p2", False, "", 30, 20), (1, 2, "picture", "p3", True, "/9ggcGljdHVyZQ==", 30, None), (2, 0, "text", "t", False, None, None, None), (3, 0, "picture", "p", True, "not base64!", 1, 1)]
    got = {r.doc_id: r.problems for r in bl.problems(spark.createDataFrame(rows, "doc_id long, pos long, type string, id string, include boolean, data string, width int, height int")).collect()}
    bad = "block '{}': a picture must be a JPEG image with its width and height"
    assert got == {1: [bad.format("p2"), bad.format("p3")], 2: ["nothing to write"], 3: [bad.format("p")]}


def test_notes_count_if_included(spark):
    b = spark.createDataFrame([(i, 0, "heading", True) for i in range(4)], "doc_id long, pos long, type string, include boolean")
    n = spark.createDataFrame([(0, ["a", "b"], True), (1, ["a"], False), (2, None, True)], "doc_id long, notes array<string>, include_notes boolean")
    assert {r.doc_id: r.notes for r in bl.counts(b, n).collect()} == {0: 2, 1: 0, 2: 0, 3: 0}


def test_contact_kinds(spark):
    rows = [("", ""), (None, ""), ("x", ""), ("book", ""), ("problem", "spam")]
    c = spark.createDataFrame([(k, "t", "n", "l", "", w, "T", "", "", "", "", False, 0, None, None) for k, w in rows], "kind string, text string, name string, link string, email string, website string, title string, author string, note string, rights string, holder string, has_pdf boolean, size long, head string, pages long")
    assert [r.c for r in c.select(it.contact_code(F.lit(False)).alias("c")).collect()] == ["bad_kind", None, "bad_kind", None, "trap"]
    assert [r.link for r in it.message_row(c).collect()] == ["l", "", "l", "l", "l"]
    pdf = c.limit(1).withColumns({"has_pdf": F.lit(True), "rights": F.lit("unsure"), "head": F.lit(None).cast("string")})
    assert pdf.select(it.suggestion_code(F.lit(False)).alias("c")).first().c == "not_pdf"
    assert pdf.withColumn("head", F.lit("%PDF-")).select(it.suggestion_code(F.lit(False)).alias("c")).first().c == "unreadable"


def test_notices(spark):
    body = it.message_body(F.lit("hi"), F.lit(""), F.lit(""), F.lit("a@b.cd"), F.lit("u"))
    assert one(spark, body, it.message_subject(F.lit("problem"), F.lit(""), F.lit(""))) == ("hi\n\n— a@b.cd a@b.cd\nu", "Problem reported by Someone")
    assert one(spark, it.suggestion_body(*map(F.lit, ("T", "", "", True, "permission", "H", "u"))), it.suggestion_body(*map(F.lit, ("T", "A", "n", False, "", "", "u")))) == ("T\n\nPDF: Has the rights or permission (H)\n\nu", "T — A\n\nn\n\nNo PDF\n\nu")


def test_mail_without_a_fallback_keeps_all_rows(spark):
    rows = spark.createDataFrame([(1, "fr"), (2, "de"), (3, None)], "k int, lang string")
    t = spark.createDataFrame([("fr", "Bonjour", "x")], "lang string, subject string, text string")
    assert [(r.k, r.subject) for r in it.accepted_mail(rows, t).orderBy("k").collect()] == [(1, "Bonjour"), (2, None), (3, None)]


def test_book_form(spark):
    got = lambda *flags, title="", data="D": it.book_form(*map(F.lit, flags), F.lit(title), F.lit(data))
    forms = [got(True, False, False, False, False, False), got(False, True, True, True, True, False), got(False, True, True, True, True, True), got(False, True, False, True, True, True, title="t"), got(False, True, False, False, False, False, title="t"), got(False, True, True, False, False, False, data="")]
    assert [(r.error, r.title, r.rewrite) for r in one(spark, *forms)] == [("data_file", "D", False), (None, "D", False), (None, "D", True), (None, "t", False), ("epub", "t", False), ("title", "", False)]


def test_media_types_and_widths(spark):
    names = ("a/b.css", "A.CSS", "x.html", ".css", "a.b/c", "x.jpg")
    assert one(spark, *[fn.media_type(F.lit(n)) for n in names]) == ("text/css", *["application/octet-stream"] * 4, "image/jpeg")
    n = lambda w, h, k=1: fn.clamp_width(F.lit(700), F.lit(w), F.lit(h), number=F.lit(k), pages=F.lit(3))
    assert one(spark, n(600, 0), n(0, 0), n(1, 10**7, 4), n(1, 10**7), n(600, 800)) == (700, 700, 700, 1, 700)


def test_places_in_the_order_of_all_rows(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 11) for i in range(200)], "uid long, ord long").repartition(3)
    want = {u: k + 1 for k, (_, u) in enumerate(sorted(((i * 37) % 11, i) for i in range(200)))}
    assert {r.uid: r.place for r in li.places(rows, "ord", "uid").collect()} == want and li.places(rows.limit(0), "ord", "uid").count() == 0


def test_shelf_and_first_value(spark):
    b = spark.createDataFrame([(1, "a", 0, None), (2, "b", 0, "/c"), (3, "c", 0, "/d")], "uid long, title string, ord long, cover_url string")
    assert [(r.slot, r.uid) for r in li.shelf(b).orderBy("slot").collect()] == [(0, 2), (1, 3), (2, None), (3, None)]
    assert li.first_or(b.where("uid > 9"), "uid", "title", "none").first().title == "none" and li.first_or(b, "uid", "title", "none").first().title == "a"
    assert li.random_pick(b, 3).first().uid in (1, 2, 3) and li.random_pick(b.limit(0), 3).count() == 0


def test_styled_runs_of_any_character(spark):
    df = spark.createDataFrame([(1, "a\u0001b<i>\u0001</i>i>"), (2, None), (3, "")], "k int, t string")
    assert [tuple(r) for r in bl.styled_runs(df, "k", "t").orderBy("run").collect()] == [(1, 0, "a\u0001b", False, False), (1, 1, "\u0001", True, False), (1, 2, "i>", False, False)]


def test_delete_dirs(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/f").write_text("1")
    rows = spark.createDataFrame([(f"{tmp_path}/x",), (f"file://{tmp_path}/none",), ("",), (None,)], "folder string")
    assert {(r.folder.rpartition("/")[2], r.deleted) for r in files.delete_dirs(rows, "folder").collect()} == {("x", True), ("none", False)}
    assert not (tmp_path / "x").exists()


def test_join_takes_notes_from_the_right(spark):
    a = text_block("a", notes=F.create_map(F.lit("1"), F.lit("old")))
    b = text_block("b", notes=F.create_map(F.lit("1"), F.lit("new")))
    (j,) = one(spark, ed.join(a, b))
    assert j.notes == {"1": "new"}


def test_book_json(spark):
    ok = files.parse_book(F.lit('{"version":1,"blocks":[{"type":"text"}]}'))
    got = one(spark, ok["blocks"], *[files.parse_book(F.lit(t)) for t in ("[1,2]", '{"version":1}', '{"blocks":"no"}', "x", "")])
    assert got[0][0].type == "text" and got[1:] == (None,) * 5


def test_page_file_keeps_long_numbers(spark):
    assert one(spark, bl.page_file(F.lit(7)), bl.page_file(F.lit(12345))) == ("0007.xhtml", "12345.xhtml")


def test_retention_is_strict(spark):
    t = lambda x: F.lit(x).cast("timestamp")
    now = t("2024-01-01 12:00:00")
    gone = lambda seen, status, made, keep=False: pr.expired(F.lit(keep), t(seen), F.lit(status), t(made), now)
    assert one(spark, gone("2024-01-01 11:45:00", "ready", "2024-01-01"), gone("2024-01-01 11:44:59", "ready", "2024-01-01"), gone("2024-01-01 11:00:00", "reading", "2024-01-01 11:00:00"), gone("2024-01-01 11:00:00", "reading", "2024-01-01 10:59:59"), gone("2024-01-01", "ready", "2024-01-01", True)) == (False, True, False, True, False)


def test_rate_limit(spark):
    rows = [("m", "a", 1), ("m", "a", 2), ("m", "a", 3), ("m", "b", 4)]
    p = spark.createDataFrame([(f, v, i, i) for f, v, i in rows], "form string, visitor string, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.refused for r in pr.rate_limit(p, 2).orderBy("event_id").collect()] == [False, False, True, False]


def test_trapped_posts_do_not_count(spark):
    p = spark.createDataFrame([("m", "a", i, i, "x" if i in (1, 2) else None) for i in range(1, 6)], "form string, visitor string, event_id long, s long, website string").withColumn("ts", F.timestamp_seconds("s"))
    assert [(r.nth, r.refused) for r in pr.rate_limit(p, 2, trap="website").orderBy("event_id").collect()] == [(None, False), (None, False), (1, False), (2, False), (3, True)]
    assert tuple(pr.hourly_totals(p, 2, trap="website").first())[-2:] == (2, 1)


def test_update_and_delete_keep_rows_of_unknown_state(spark):
    d = spark.createDataFrame([(1, None), (2, True), (3, False)], "k int, t boolean")
    assert [r.k for r in tb.delete_where(d, F.col("t")).orderBy("k").collect()] == [1, 3]
    assert [r.k for r in tb.update_where(d, F.col("t"), k=9).orderBy("k").collect()] == [1, 3, 9]


def test_rules_in_order(spark):
    code = it.pdf_code(F.lit(200 << 20), F.lit("x"), F.lit(0))
    client = it.pdf_client_code(F.lit("text/html"), F.lit("a.txt"), F.lit(200 << 20))
    assert one(spark, code, client) == ("too_big", "not_pdf")


def test_zip_members_and_images(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("x.css", "p{}")
    (tmp_path / "b.epub").write_bytes(b"no zip")
    got = {(r.name, r.type, r.error) for r in files.zip_members(spark, str(tmp_path)).collect()}
    assert got == {("x.css", "text/css", None), (None, None, "not_zip")}
    out = tmp_path / "out"
    books = spark.createDataFrame([("t", [], {"x": "1"}), ("../é", [], {"x": "1"}), ("u", ["nothing to write"], {})], "name string, problems array<string>, members map<string,string>")
    assert {(r.name, r.error) for r in files.write_zips(books, str(out)).collect()} == {("t", None), ("../é", None), ("u", "nothing to write")}
    assert sorted(p.name for p in out.iterdir()) == ["..%2F%C3%A9.epub", "t.epub"]
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.jpg").write_bytes(b"\xff\xd8\xff\xe0abc")
    (tmp_path / "img/b.jpg").write_bytes(b"text")
    assert {r.error for r in files.images(spark, str(tmp_path / "img")).collect()} == {None, "not_image"}


def test_streams_equal_batch(spark, tmp_path):
    from quire.streaming import posts as st

    rows = [("m", v % 2, 1_700_000_000 + 1000 * i, i) for i, v in enumerate(range(40))]
    df = spark.createDataFrame(rows, "form string, visitor long, s long, event_id long").select("form", "visitor", F.timestamp_seconds("s").alias("ts"), "event_id").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = st.rate_limit(stream, 1).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.event_id, r.nth, r.refused) for r in spark.table("decided").collect()}
    assert got == {(r.event_id, r.nth, r.refused) for r in pr.rate_limit(df, 1).collect()}
    q = st.hourly_totals(stream, 1).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.accepted for r in spark.table("totals").collect()) == sum(r.accepted for r in pr.hourly_totals(df, 1).collect())


def test_slug_query_reads_whole_texts(spark, tmp_path):
    from quire.plans import registry

    spark.createDataFrame([(1, "word " * 40 + "Ａ end!")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.QUERIES["fn_slug"](spark, str(tmp_path)).first().slug == "word-" * 40 + "a-end.epub"

"""Joins by sorted streams, pointer doubling, click logs, counters, previews, JSON books and locale orders, against plain loops."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks as bl
from quire.operators import counter as ct
from quire.operators import edits as ed
from quire.operators import intake as it
from quire.operators import library as li
from quire.operators import picking as pk
from quire.operators import presence as pr
from quire.operators import tables as tb
from quire.sources import books as bk
from quire.sources import files, previews

T0 = datetime(2024, 5, 1, 12)


def page_of(sizes, paragraph):
    """sizes: (page, paragraphs) of a section in order."""
    if not sizes:
        return 1
    if paragraph is None:
        return sizes[0][0]
    for page, n in sizes:
        if paragraph < n:
            return page
        paragraph -= n
    return sizes[-1][0]


def test_pages_of_paragraphs(spark):
    r = random.Random(1)
    sizes, places, number = [], [], {}
    for doc in range(6):
        number[doc] = 0
        for section in range(5):
            pages = []
            for _ in range(r.randint(0, 5) if section else 1):
                number[doc] += 1
                pages.append((doc, section, number[doc], r.choice([0, 0, 1, 2, 5])))
            sizes += pages
            places += [(doc, section, p, page_of([x[2:] for x in pages], p)) for p in [None, *range(14)]]
        places.append((doc, None, None, 1))
    df = spark.createDataFrame([(d, 100 * i, s, p) for i, (d, s, p, _) in enumerate(places)], "doc_id long, pos long, section long, paragraph long").repartition(3)
    got = bl.preview_pages(df, spark.createDataFrame(sizes, "doc_id long, section long, page_no long, paragraphs int")).collect()
    assert {r.pos: r.page_no for r in got} == {100 * i: x[3] for i, x in enumerate(places)} and len(got) == len(places)
    assert got[0].__fields__ == ["doc_id", "pos", "section", "paragraph", "page_no", "file"]


def test_a_section_of_many_pages(spark):
    n = 100_000
    sizes = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("section"), F.col("id").alias("page_no"), F.lit(2).alias("paragraphs"))
    places = spark.range(0, 2 * n, 997).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("pos"), F.lit(0).cast("long").alias("section"), F.col("id").alias("paragraph"))
    got = bl.preview_pages(places, sizes)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert got.where("page_no <> floor(paragraph / 2) + 1").count() == 0 and got.count() == places.count()


def runs(calls, every):
    """calls: (key, order, ts); the ones that run."""
    last, out = {}, []
    for k, o, t in sorted((c for c in calls if c[2] is not None), key=lambda c: (str(c[0]), c[2], c[1])):
        if k not in last or (t - last[k]).total_seconds() >= every:
            last[k] = t
            out.append((k, o, t))
    return sorted(out, key=str)


CALLS = "user_id long, event_id long, ts timestamp"


@pytest.mark.parametrize("every", [60, 0.5, 0])
def test_throttle(spark, every):
    r = random.Random(6)
    calls = [(r.choice([1, 2, 3, None]), i, T0 + timedelta(seconds=r.randint(0, 3000))) for i in range(400)] + [(1, 1000, None), (9, 1001, T0)]
    calls += [(4, 2000 + i, T0 + timedelta(seconds=60 * i)) for i in range(70)] + [(5, 3000 + i, T0) for i in range(20)]
    df = spark.createDataFrame(calls, CALLS).repartition(4)
    assert sorted(map(tuple, pr.throttle(df, every).collect()), key=str) == runs(calls, every)
    assert pr.throttle(df.limit(0), every).collect() == []


def test_throttle_of_repeated_calls(spark):
    calls = [(1, 7, T0)] * 3 + [(1, 7, T0 + timedelta(seconds=60))] * 2
    assert sorted(map(tuple, pr.throttle(spark.createDataFrame(calls, CALLS), 60).collect())) == [(1, 7, T0), (1, 7, T0 + timedelta(seconds=60))]


def test_one_key_lies_in_many_tasks(spark, monkeypatch):
    """All calls of one key: no task holds more than a share of them, and no Python worker runs."""
    n, seen = 20_000, []
    real = pr.hold

    def hold(df):
        out = real(df)
        if "_range" in out.columns:
            seen.append(out.groupBy("_range").count().agg(F.max("count")).first()[0])
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(pr, "hold", hold)
    df = spark.range(n).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 7)).alias("ts"))
    got = [x.event_id for x in pr.throttle(df, 60).orderBy("event_id").collect()]
    assert got == list(range(0, n, 9)) and max(seen) < n


def picks(clicks):
    """As the editor does it, one click after the other: (session, n, at, shift)."""
    state, anchor = {}, {}
    for s, _, at, shift in sorted(clicks):
        now = state.setdefault(s, set())
        if shift and anchor.get(s) is not None:
            now |= set(range(min(anchor[s], at), max(anchor[s], at) + 1))
        else:
            now ^= {at}
        anchor[s] = at
    return sorted((s, at) for s, now in state.items() for at in now)


def test_picking(spark):
    r = random.Random(9)
    clicks = [(s, n, r.randint(0, 25), r.random() < 0.3) for s in range(40) for n in range(r.randint(1, 25))]
    clicks += [(99, 0, 5, True), (99, 1, 5, True), (99, 2, 5, False), (98, 0, 3, False), (98, 1, 3, False)]
    df = spark.createDataFrame(clicks, "session long, n int, at long, shift boolean").repartition(3)
    assert sorted(map(tuple, pk.picked(df).collect())) == picks(clicks)
    wide = spark.createDataFrame([(1, 0, 10, False), (1, 1, 3_000_000_000, True)], "session long, n int, at long, shift boolean")
    assert [tuple(r) for r in pk.covered(pk.acts(wide).where("low is not null")).collect()] == [(1, 10, 3_000_000_001)]
    assert pk.picked(df.limit(0)).count() == 0


def test_counter_outlives_its_rows(spark, tmp_path):
    folder = f"{tmp_path}/counters"
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    assert ct.total(spark, folder, "converted") == 0
    ct.append(rows("converted", "converted", None, "seen"), folder, 0)
    books = spark.createDataFrame([(1, True), (2, False)], "uid int, gone boolean")
    assert tb.delete_where(books, F.col("gone")).count() == 1 and ct.total(spark, folder, "converted") == 2
    for _ in range(2):  # also a second time
        ct.compact(spark, folder)
        assert ct.total(spark, folder, "converted") == 2
    ct.append(rows("converted"), folder, 0)  # given again after the snapshot
    ct.append(rows("converted"), folder, 1)
    ct.append(rows("converted"), folder, 1)  # and before it
    assert {r["name"]: r["count"] for r in ct.totals(spark, folder).collect()} == {"converted": 3, "seen": 1}
    ct.compact(spark, folder)
    assert ct.total(spark, folder, "converted") == 3 and sorted(os.listdir(f"{folder}/snapshots")) == ["upto=1"] and os.listdir(f"{folder}/log") == []


def test_a_snapshot_that_a_crash_left_half_counts_nothing(spark, tmp_path):
    folder = f"{tmp_path}/counters"
    ct.append(spark.createDataFrame([("a",)], "name string"), folder, 0)
    os.makedirs(f"{folder}/snapshots/upto=0")  # no _SUCCESS
    assert ct.total(spark, folder, "a") == 1
    ct.compact(spark, folder)
    assert ct.total(spark, folder, "a") == 1


def test_counter_from_a_stream(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("a",)], "name string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        s = spark.readStream.schema("name string").parquet(f"{tmp_path}/in")
        assert s.writeStream.foreachBatch(ct.sink(f"{tmp_path}/c")).option("checkpointLocation", f"{tmp_path}/cp{_}").trigger(availableNow=True).start().awaitTermination(60)
    assert ct.total(spark, f"{tmp_path}/c", "a") == 2


def test_previews_are_written_where_they_are_stale(spark, tmp_path):
    folder, now = f"{tmp_path}/previews", datetime.now()
    old = now - timedelta(days=1)
    frame = lambda rows: spark.createDataFrame(rows, "id string, updated_at timestamp, last_seen timestamp, members map<string,string>")
    books = [(f"b/{i} é", old, old, {"x.txt": f"v{i}"}) for i in range(5)] + [(None, old, old, {})]
    written = lambda rows: sorted(r.id for r in previews.refresh(frame(rows), folder).collect())
    assert written(books) == sorted(b[0] for b in books[:5])
    assert written(books) == []
    heartbeat = [(i, u, now + timedelta(hours=1), m) for i, u, _, m in books]
    assert written(heartbeat) == []
    changed = [*books[:2], (books[2][0], now + timedelta(hours=1), old, {"x.txt": "new"}), *books[3:]]
    assert written(changed) == [books[2][0]]
    assert not [f for f in os.listdir(folder) if not f.endswith((".epub", ".crc"))]
    got = {r.content for r in files.zip_members(spark, folder).collect()}
    assert {bytes(c) for c in got} == {b"v0", b"v1", b"new", b"v3", b"v4"}


GOOD = {"version": 1, "metadata": {"title": "T", "author": None, "language": "ka"}, "blocks": [{"type": "heading", "include": True, "label": "I"}, {"type": "text", "include": True, "text": "a"}, {"type": "text", "include": False, "page": "nine"}], "notes": ["n"], "include_notes": True}


def test_books_and_refused_texts(spark):
    less = lambda k: {a: b for a, b in GOOD.items() if a != k}
    block = lambda b: json.dumps(GOOD | {"blocks": [*GOOD["blocks"], b]})
    cases = [
        (json.dumps(GOOD), None), (json.dumps(GOOD | {"blocks": [], "more": {"x": 1}}), None), (None, "no_text"), ("", "not_json"), ("{", "not_json"), ('{"a":1,"a":2}', "not_json"),
        ("[1]", "not_object"), ("null", "not_object"), ("7", "not_object"), ('"{}"', "not_object"), (json.dumps(less("metadata")), "no_metadata"), (json.dumps(GOOD | {"metadata": []}), "no_metadata"),
        (json.dumps(less("blocks")), "no_blocks"), (json.dumps(GOOD | {"blocks": None}), "no_blocks"), (json.dumps(GOOD | {"blocks": {"0": 1}}), "no_blocks"),
        (block(5), "bad_block"), (block(None), "bad_block"), (block({"type": "text"}), "bad_block"), (block({"include": True}), "bad_block"), (block({"type": 3, "include": True}), "bad_block"), (block({"type": "text", "include": "yes"}), "bad_block"),
        (json.dumps(less("notes")), "no_notes"), (json.dumps(less("include_notes")), "no_notes"), (json.dumps(GOOD | {"include_notes": 1}), "no_notes"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "k int, text string")
    got = {r.k: r for r in bk.counts(bk.read_books(df)).collect()}
    assert {k: r.error for k, r in got.items()} == {i: e for i, (_, e) in enumerate(cases)}
    assert {r.at for r in got.values() if r.error == "bad_block"} == {3} and all(r.at is None for r in got.values() if r.error != "bad_block")
    assert all(r.refused == (cases[k][0] if r.error else None) for k, r in got.items())
    assert (got[0].metadata.title, got[0].metadata.author, got[0].headings, got[0].paragraphs, got[0].n_notes, got[0].blocks[2].page) == ("T", None, 1, 1, 1, None)
    assert (got[1].headings, got[1].paragraphs, got[2].headings) == (0, 0, None)


def test_locale_orders(spark):
    titles = ["zebra", "Äpfel", "apfel", "Apfel", "éclair", "Eclair", "ბ", "ა", "я", "а", "1", " x", "Zoo", ""]
    rows = [(i, 0, t, "éa" if i % 2 else "ez") for i, t in enumerate(titles)]
    b = spark.createDataFrame(rows, "uid long, ord long, title string, author string").repartition(5)
    want = ["", " x", "1", "apfel", "Apfel", "Äpfel", "Eclair", "éclair", "zebra", "Zoo", "а", "я", "ა", "ბ"]
    assert [r.title for r in b.orderBy(*li.title_order()).collect()] == want
    assert [r.title for r in li.places(b, *li.title_order()).orderBy("place").collect()] == want
    assert [r.title for r in b.orderBy(*li.title_order(locale=False)).collect()] == sorted(titles)
    assert [r.author for r in li.places(b, *li.author_order()).orderBy("place").collect()] == ["éa"] * 7 + ["ez"] * 7
    assert [r.title for r in li.places(b, *li.author_order()).where("author = 'ez'").orderBy("place").collect()] == [t for t in want if titles.index(t) % 2 == 0]


def test_offsets_of_a_browser(spark):
    from quire.functions import scalar as fn

    text = "a\U0001f600b\nc\U00010000"
    place = lambda n: fn.utf16_place(F.lit(text), F.lit(n))
    got = tuple(spark.range(1).select(*[place(n).alias(f"c{n}") for n in range(-1, 10)], fn.utf16_place(F.lit(""), F.lit(3)).alias("e")).first())
    assert got == (0, 0, 1, 1, 2, 3, 4, 5, 5, 6, 6, 0)  # a cut inside a pair falls before it


def _block(**fields):
    base = {"type": "text", "id": "t", "page": 1, "role": "body", "include": True, "text": "", "lines": F.expr("cast(array() as array<string>)"), "verse": False, "notes": F.expr(ed.EMPTY_NOTES)}
    return ed.block(**(base | fields))


def test_splits_at_offsets_of_a_browser(spark):
    prose, verse = F.array(_block(text="\U0001f600 one two")), F.array(_block(verse=True, lines=F.array(F.lit("\U0001f600\U0001f600"), F.lit("two"))))
    parts = lambda blocks, at, utf16: F.transform(ed.split_at(blocks, 0, at, "new", utf16), lambda b: b["text"])
    columns = [parts(prose, 7, True), parts(prose, 7, False), parts(verse, 5, True), parts(verse, 4, True)]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    assert tuple(got)[:2] == (["\U0001f600 one", "two"], ["\U0001f600 one t", "wo"])
    assert got[2] == ["\U0001f600\U0001f600", "two"] and len(got[3]) == 1  # offset 4 is still on the first line


def test_pictures_meet_by_book_and_id(spark):
    pic = lambda i, data, kind="picture": _block(type=kind, id=F.lit(i).cast("string"), data=data)
    row = lambda doc, *blocks: spark.range(1).select(F.lit(doc).alias("doc_id"), F.array(*blocks).alias("blocks"), F.lit("x").alias("cover"))
    incoming = row(1, pic("a", "sent"), pic("b", "sent"), pic(None, "sent"), pic("a", "kept", "text"), pic("a", None)).unionByName(row(2, pic("a", "sent")))
    incoming = incoming.unionByName(spark.range(1).select(F.lit(3).alias("doc_id"), F.expr(f"cast(array() as array<{ed.BLOCK}>)").alias("blocks"), F.lit("x").alias("cover")))
    stored = row(1, pic("a", "first"), pic("a", "last"), pic(None, "none"), pic("b", "text", "text")).unionByName(row(9, pic("a", "other")))
    got = {r.doc_id: [b.data for b in r.blocks] for r in ed.restore_pictures(incoming, stored).collect()}
    assert got == {1: ["last", "", "", "kept", "last"], 2: [""], 3: []}
    assert {(r.doc_id, r.pos): r.b.data for r in ed.picture_rows(incoming, stored).collect()} == {(d, i): x for d, xs in got.items() for i, x in enumerate(xs)}
    assert ed.restore_pictures(incoming, stored).columns == ["doc_id", "blocks", "cover"]


def test_messages_for_the_owner(spark):
    rows = spark.createDataFrame([(1, "T", "a@example.org"), (2, "U", "")], "doc_id int, title string, email string")
    mail = lambda to, site: it.outbox(rows, to, it.suggestion_subject(F.col("title")), F.lit("b"), F.col("email"), site, "doc_id")
    got = [tuple(r) for r in mail("team@example.org", "Site").orderBy("doc_id").collect()]
    assert got == [(1, "team@example.org", "[Site] Book suggested: T", "b", "a@example.org"), (2, "team@example.org", "[Site] Book suggested: U", "b", None)]
    assert mail("", "Site").count() == 0 and mail("x", "").first().subject == "Book suggested: T"
    none = rows.limit(0)
    waiting = it.waiting({"messages": (rows, "/m"), "nothing": (none, "/n"), "books": (rows.limit(1), "/b")})
    assert tuple(it.review(waiting).first()) == (3, "3 waiting for review", "2 messages:\n/m\n\n1 books:\n/b")
    assert it.review(it.waiting({"nothing": (none, "/n")})).count() == 0


def test_conversions_of_suggestions_and_promotion(spark):
    rows = spark.createDataFrame([(1, "T", True, 9, 2), (2, "U", False, None, None)], "doc_id int, title string, has_pdf boolean, size long, pages int")
    assert [tuple(r) for r in tb.convert_suggestions(rows).orderBy("doc_id").collect()] == [(1, "T", "T.pdf", 9, 2, "reading", True, None), (2, None, None, None, None, None, None, "no_pdf")]
    done = spark.createDataFrame([(1, "ready", "", "up", None, "ka", "{}", "c.jpg"), (2, "failed", "t", "up", None, None, None, None)], "id int, status string, title string, name string, author string, language string, data string, cover string")
    assert [r.asDict() for r in tb.promote(done).collect()] == [{"uid": 1, "title": "up", "author": "", "language": "ka", "is_published": False, "data": "{}", "cover": "c.jpg"}]
    assert tb.promote(done.drop("data", "cover")).columns == ["uid", "title", "author", "language", "is_published"]


def test_uids_stay(spark, tmp_path):
    rows = tb.backfill_uid(spark.range(20), f"{tmp_path}/uids")
    first, again = ({r.id: r.uid for r in rows.collect()} for _ in range(2))
    assert first == again and len(set(first.values())) == 20 and all(len(u) == 36 for u in first.values())


def test_uploads_forms_and_members(spark, tmp_path):
    import zipfile

    (tmp_path / "up").mkdir()
    (tmp_path / "up/a.pdf").write_bytes(b"%PDF-1.7 rest")
    (tmp_path / "up/b.pdf").write_bytes(b"abc")
    (tmp_path / "up/empty.pdf").write_bytes(b"")  # no row
    got = {os.path.basename(r.path): (r["size"], bytes(r["head"])) for r in files.uploads(spark, f"{tmp_path}/up").collect()}
    assert got == {"a.pdf": (13, b"%PDF-"), "b.pdf": (3, b"abc")}
    form = F.create_map(F.lit("name"), F.lit("\u00a0 A b \n"))
    assert tuple(spark.range(1).select(files.form_field(form, "name"), files.form_field(form, "none")).first()) == ("A b", "")
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        z.writestr("a.css", "p{}")
        z.writestr("b.xhtml", "<p>")
    assert [(r.name, r.type, bytes(r.content)) for r in files.zip_member(spark, f"{tmp_path}/x.epub", "b.xhtml").collect()] == [("b.xhtml", "application/xhtml+xml", b"<p>")]


def test_conversion_records(spark):
    from quire.operators import conversions as cv

    rows = spark.createDataFrame([(7, "n", 1, 2, "ready", 2, "", "", datetime(2024, 1, 2, 3, 4, 5, 60), "T", None, "ka", 1, 2, 3), (8, "m", 1, 2, "reading", 0, "", "/c", datetime(2024, 1, 2), None, None, None, None, None, None)], "id int, name string, size int, pages int, status string, step int, error string, cover_url string, created_at timestamp, title string, author string, language string, headings int, paragraphs int, notes int")
    a, b = cv.records(rows, 3).orderBy("id").collect()
    assert a.__fields__ == ["id", "name", "size", "pages", "status", "step", "steps", "error", "cover_url", "book", "created_at"]
    assert (a.id, a.steps, a.cover_url, a.book.asDict(), a.created_at) == ("7", 3, None, {"title": "T", "author": None, "language": "ka", "headings": 1, "paragraphs": 2, "notes": 3}, "2024-01-02T03:04:05.000060+00:00")
    assert (b.book, b.cover_url, b.created_at) == (None, "/c", "2024-01-02T00:00:00+00:00")


def test_sizes_of_images():
    from quire.plans.sources import _picture
    from quire.sources.files import _image_size

    assert _image_size(_picture({"data": "png 640 480"})) == _image_size(_picture({"data": "jpeg 640 480"})) == (640, 480)
    jpeg = _picture({"data": "jpeg 7 9"})
    assert _image_size(jpeg[:2] + b"\xff\xff" + jpeg[2:]) == (7, 9)  # fill bytes before a marker
    assert [_image_size(x) for x in (None, b"", b"\xff\xd8\xff", jpeg[:24], _picture({"data": "png 1 1"})[:20], b"\x89PNG\r\n\x1a\n" + bytes(30))] == [None] * 6

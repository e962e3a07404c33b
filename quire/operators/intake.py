"""Incoming posts: ordered rule chains (the first rule that fails gives the code), projections, outgoing messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scalar import book_name, filled, is_email, label_or_code, too_long, trim

KINDS = ("message", "problem", "copyright")
RIGHTS = ("public_domain", "permission", "unsure")


def chain(*rules: tuple[Column, str]) -> Column:
    """Code of the first rule that holds, else null."""
    out = F.when(rules[0][0], rules[0][1])
    for test, code in rules[1:]:
        out = out.when(test, code)
    return out


def pdf_code(size: Column, head: Column, pages: Column, most_bytes: int = 100 << 20, most_pages: int = 2000) -> Column:
    return chain((size > most_bytes, "too_big"), (F.coalesce(~head.startswith("%PDF-"), F.lit(True)), "not_pdf"), (F.coalesce(pages, F.lit(0)) == 0, "unreadable"), (pages > most_pages, "too_many_pages"))


def upload_code(has_file: Column, size: Column, head: Column, pages: Column) -> Column:
    return F.when(~has_file, "no_file").otherwise(pdf_code(size, head, pages))


def pdf_client_code(kind: Column, name: Column, size: Column, most: int = 100 << 20) -> Column:
    """The browser's order: the type before the size."""
    return chain((~is_pdf_client(kind, name), "not_pdf"), (size > most, "too_big"))


def is_pdf_client(kind: Column, name: Column) -> Column:
    return (kind == "application/pdf") | F.lower(name).endswith(".pdf")


def message_code(over_limit: Column, longest: int = 5000) -> Column:
    """"trap" stands for an answer that looks like success, with nothing stored."""
    limits = {"text": longest, "name": 200, "email": 254, "link": 500}
    return chain(
        (F.col("website") != "", "trap"), (over_limit, "too_many"), (F.col("text") == "", "no_text"), (too_long(limits), "too_long"),
        ((F.col("email") != "") & ~is_email(F.col("email")), "bad_email"),
        ((F.col("kind") == "copyright") & (F.col("link") == ""), "no_link"), ((F.col("kind") == "copyright") & (F.col("email") == ""), "no_email"),
    )


def contact_code(over_limit: Column, longest: int = 5000, book: Column | None = None) -> Column:
    """Dispatch by kind: a book's code is that of the suggestion chain (given as `book`); no kind is a message, an unknown or empty one is refused first."""
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    book = suggestion_code(over_limit) if book is None else book
    return F.when(kind == "book", book).when(~kind.isin(*KINDS), "bad_kind").otherwise(message_code(over_limit, longest))


def message_row(rows: DataFrame) -> DataFrame:
    """What is stored of a message: one of kind message (or none) has no link."""
    plain = F.coalesce(F.col("kind"), F.lit("message")) == "message"
    return rows.withColumn("link", F.when(plain, "").otherwise(F.col("link")))


def suggestion_code(over_limit: Column) -> Column:
    limits = {"title": 300, "author": 200, "note": 2000, "holder": 200, "email": 254}
    pdf = F.col("has_pdf")
    fields = chain(
        (F.col("website") != "", "trap"), (over_limit, "too_many"), (F.col("title") == "", "no_title"), (too_long(limits), "too_long"),
        ((F.col("email") != "") & ~is_email(F.col("email")), "bad_email"),
    )
    rights = chain((pdf & ~F.coalesce(F.col("rights").isin(*RIGHTS), F.lit(False)), "no_rights"), (pdf & (F.col("rights") == "permission") & (F.col("holder") == ""), "no_holder"))
    return F.coalesce(fields, F.when(pdf, pdf_code(F.col("size"), F.col("head"), F.col("pages"))), rights)


def suggestion_row(rows: DataFrame) -> DataFrame:
    """What is stored: rights only with a PDF, a holder only with permission, language en or ka."""
    rights = F.when(F.col("has_pdf"), F.col("rights")).otherwise("")
    return rows.withColumn("rights", rights).withColumn("holder", F.when(F.col("rights") == "permission", F.col("holder")).otherwise("")).withColumn("lang", F.when(F.col("lang").isin("en", "ka"), F.col("lang")).otherwise("en"))


def contact_client_code(book_title: Column, has_pdf: Column, rights: Column, holder: Column) -> Column:
    """What the browser finds missing before it posts; texts of white space alone are missing too. rights is a choice and is taken as it is."""
    book, blank = F.col("kind") == "book", lambda c: trim(F.coalesce(c, F.lit(""))) == ""
    return chain(
        (book & blank(book_title), "no_title"), (book & has_pdf & (rights == ""), "no_rights"), (book & has_pdf & (rights == "permission") & blank(holder), "no_holder"),
        (~book & (F.col("kind") == "copyright") & blank(F.col("link")), "no_link"), (~book & blank(F.col("text")), "no_text"), (~book & (F.col("kind") == "copyright") & blank(F.col("email")), "no_email"),
    )


def client_fields(names: dict[str, list[str]]) -> Column:
    """Map of the fields of the row's kind, without empty values."""
    every = sorted({n for v in names.values() for n in v})
    fit = lambda n: F.col("kind").isin([k for k, v in names.items() if n in v])
    m = F.map_from_arrays(F.array(*map(F.lit, every)), F.array(*[F.when(fit(n), F.col(n)) for n in every]))
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def cover_code(has_file: Column, size: Column, is_image: Column) -> Column:
    return chain((~has_file, "no_file"), (size > 10 << 20, "too_big"), (~is_image, "not_image"))


def book_code(parsed: Column, blocks: Column) -> Column:
    return F.when(parsed.isNull() | blocks.isNull(), "bad_book")


def book_form(upload: Column, upload_ok: Column, stored: Column, epub: Column, saved_epub: Column, new_cover: Column, title: Column, data_title: Column) -> Column:
    """First error of an admin's book form, its title, and whether its EPUB is written anew.

    upload, stored: is book data uploaded, or kept with the book; epub, saved_epub: has the form, or the saved book, an EPUB. An EPUB
    is written only from data, after an upload or a change of the cover, or where there is none yet. An empty title is the data's.
    """
    data = upload | stored
    title = F.coalesce(filled(title), F.when(data, filled(data_title)), F.lit(""))
    error = chain((upload & ~upload_ok, "data_file"), (~data & ~epub, "epub"), (title == "", "title"))
    return F.struct(error.alias("error"), title.alias("title"), (error.isNull() & data & (upload | new_cover | ~saved_epub)).alias("rewrite"))


def library_add(status: Column, n_problems: Column) -> Column:
    return F.when(status != "ready", "not_ready").when(n_problems > 0, "unwritable").otherwise("added")


def field_limits(fields: DataFrame, columns: DataFrame, overrides: dict[str, int]) -> DataFrame:
    """Limit of each form field: the call's, else its column's maximum. Both sides have one row a field name."""
    given = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    return fields.join(columns, "field", "left").select("field", F.coalesce(F.element_at(given, F.col("field")), F.col("max_length")).alias("most"))


#: Subjects of the messages, and how a claim of rights reads.
SUBJECTS = {"book": "Book suggested: {title}", "message": "Message from {sender}", "problem": "Problem reported by {sender}", "copyright": "Copyright concern from {sender}"}
CLAIMS = {"public_domain": "Public domain", "permission": "Has the rights or permission", "unsure": "Not sure"}


def sender(name: Column, email: Column) -> Column:
    return F.coalesce(filled(name), filled(email), F.lit("Someone"))


def message_subject(kind: Column, name: Column, email: Column) -> Column:
    """The subject by kind; null for a kind without one."""
    subject = F.element_at(F.create_map(*[F.lit(x) for k, v in SUBJECTS.items() if k != "book" for x in (k, v)]), kind)
    return F.replace(subject, F.lit("{sender}"), sender(name, email))


def suggestion_subject(title: Column) -> Column:
    return F.replace(F.lit(SUBJECTS["book"]), F.lit("{title}"), title)


def message_body(text: Column, link: Column, name: Column, email: Column, url: Column) -> Column:
    about = F.when(filled(link).isNotNull(), F.concat(F.lit("About: "), link, F.lit("\n\n"))).otherwise("")
    return F.concat(about, text, F.lit("\n\n— "), sender(name, email), F.lit(" "), F.coalesce(email, F.lit("")), F.lit("\n"), url)


def suggestion_body(title: Column, author: Column, note: Column, has_pdf: Column, rights: Column, holder: Column, link: Column) -> Column:
    claim = label_or_code(rights, CLAIMS)
    pdf = F.concat(F.lit("PDF: "), claim, F.when(filled(holder).isNotNull(), F.concat(F.lit(" ("), holder, F.lit(")"))).otherwise(""))
    return F.concat_ws("\n\n", filled(book_name(title, author)), filled(note), F.when(has_pdf, pdf).otherwise("No PDF"), link)


def admin_url(site: str, app: str, model: str, key: Column) -> Column:
    return F.concat(F.lit(f"{site}/admin/{app}/{model}/"), key.cast("string"), F.lit("/change/"))


def outbox(rows: DataFrame, recipient: str, subject: Column, body: Column, reply_to: Column, site: str = "", *keys: str) -> DataFrame:
    """Rows to send; without a recipient there are none. An empty address to answer to is null; site: a name in brackets before each subject; keys: columns to keep.

    Delivery: streaming.mail.
    """
    named = F.concat(F.lit(f"[{site}] "), subject) if site else subject
    out = rows.select(*keys, F.lit(recipient).alias("recipient"), named.alias("subject"), body.alias("body"), filled(reply_to).alias("reply_to"))
    return out if recipient else out.limit(0)


def accepted_mail(rows: DataFrame, templates: DataFrame, fallback: str = "en") -> DataFrame:
    """Subject and text by language, else the fallback's, else null. templates: (lang, subject, text), one row a language."""
    base = templates.where(F.col("lang") == fallback).agg(F.first("subject").alias("_s"), F.first("text").alias("_t"))  # always one row
    return rows.join(templates, "lang", "left").crossJoin(F.broadcast(base)).select(*rows.columns, F.coalesce("subject", "_s").alias("subject"), F.coalesce("text", "_t").alias("text"))


def unread(messages: DataFrame, read: Column) -> DataFrame:
    return messages.where(~read)


def new_suggestions(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'new'")


def unpublished(books: DataFrame) -> DataFrame:
    return books.where("not is_published")


def with_email(rows: DataFrame) -> DataFrame:
    return rows.where("email <> ''")


def affected(rows: DataFrame) -> DataFrame:
    """How many rows an action changes, and how many people it tells: one row (n, told)."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("email") != "").alias("told"))


def total(rows: DataFrame, test: Column) -> DataFrame:
    return rows.where(test).agg(F.count("*").alias("count"))


def waiting(sets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(place, what, n, url) for each set with rows, place by the order of the sets; each set: (rows, url)."""
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(i).alias("place"), F.lit(what).alias("what"), "n", F.lit(url).alias("url")) for i, (what, (rows, url)) in enumerate(sets.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


def review(waiting_: DataFrame) -> DataFrame:
    """One message about all that waits, (total, subject, body), its lines in order; no row where nothing waits."""
    line = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("what"), F.lit(":\n"), F.col("url"))
    every = waiting_.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("_lines"))  # a row a set
    return every.where("total > 0").select("total", F.concat(F.col("total").cast("string"), F.lit(" waiting for review")).alias("subject"), F.array_join(F.transform("_lines", lambda x: x["line"]), "\n\n").alias("body"))

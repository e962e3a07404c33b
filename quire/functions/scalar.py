"""Column functions on text, numbers, maps and addresses. All are built from built-in functions unless they say otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The types of the members that an e-book has.
MEDIA_TYPES = {"xhtml": "application/xhtml+xml", "css": "text/css", "ttf": "font/ttf", "jpg": "image/jpeg", "ncx": "application/x-dtbncx+xml", "opf": "application/oebps-package+xml"}
#: White space that a browser trims: Unicode separators, line ends and the byte order mark, not U+0085.
TRIMMED = r"[\t\n\x0B\f\r\p{Zs}\x{2028}\x{2029}\x{FEFF}]"
#: Fixed value: a link in a legal text, [label](target).
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z0-9-]{0,61}[A-Za-z]$"


def filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends; null: empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def trim(c: Column) -> Column:
    """As a browser trims a string; null stays null."""
    return F.regexp_replace(c, f"^{TRIMMED}+|{TRIMMED}+$", "")


def file_size(size: Column) -> Column:
    """Bytes as "n KB" (at least 1) or "n.d MB", in exact integer arithmetic with halves up."""
    kb = F.greatest(F.lit(1), F.floor((size * 2 + 1024) / 2048))
    tenths = F.floor((size * 20 + 1048576) / 2097152)
    mb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))
    return F.when(size < 1048576, F.concat(kb.cast("string"), F.lit(" KB"))).otherwise(mb)


def fill(template: Column, values: Column) -> Column:
    """One pass of {name} substitution from a map; unknown names stay as they are, inserted values are not read again."""
    pieces = F.regexp_extract_all(template, F.lit(r"(?s)(\{\w+\}|[^{]+|\{)"), F.lit(1))
    name = lambda p: F.regexp_extract(p, r"^\{(\w+)\}$", 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\{\w+\}$"), F.coalesce(F.element_at(values, name(p)), p)).otherwise(p)), "")


def heading_text(label: Column, title: Column) -> Column:
    return F.when(filled(title).isNotNull(), F.concat(label, F.lit(": "), title)).otherwise(label)


def book_name(title: Column, author: Column) -> Column:
    return F.when(filled(author).isNotNull(), F.concat(title, F.lit(" — "), author)).otherwise(title)


def message_name(name: Column, email: Column, text: Column) -> Column:
    return F.concat(F.coalesce(filled(name), filled(email), F.lit("Someone")), F.lit(": "), F.substring(text, 1, 60))


def either(a: Column, b: Column) -> Column:
    """a unless it is empty or null, else b, else empty."""
    return F.coalesce(filled(a), b, F.lit(""))


def stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def url_quote(c: Column) -> Column:
    """Percent-encoded UTF-8, slash kept."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def label_or_code(code: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), code), code)


def media_type(name: Column) -> Column:
    """By the suffix as it is written; a leading dot of a name is no suffix."""
    suffix = F.regexp_extract(name, r"[^/]\.([^./]+)$", 1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), suffix), F.lit("application/octet-stream"))


def error_code(code: Column, known: list[str]) -> Column:
    return F.when(code.isin(known), code).otherwise("server")


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(F.replace(F.lit(many), F.lit("{n}"), n.cast("string")))


def percent(share: Column) -> Column:
    return F.floor(share * 100 + 0.5)


def clamp_width(width: Column, page_w: Column, page_h: Column, most: int = 8_000_000, number: Column | None = None, pages: Column | None = None) -> Column:
    """Narrower where the page would have over `most` pixels; as asked where its size is not positive, or number is no page of the book."""
    known = (page_w > 0) & (page_h > 0)
    if number is not None:
        known = known & number.between(F.lit(1), pages)
    page_h = F.when(page_h > 0, page_h)  # no division by zero
    return F.when(~F.coalesce(known, F.lit(False)), width).otherwise(F.least(width, F.greatest(F.lit(1), F.floor(F.sqrt(F.lit(float(most)) * page_w / page_h)))))


def width_ok(value: Column) -> Column:
    """The width asked for, 700 where none is (null), null where it is no integer from 100 to 1600: an empty value is none."""
    n = F.coalesce(value, F.lit("700")).try_cast("int")
    return F.when(n.between(100, 1600) & ~F.coalesce(value, F.lit("")).contains("."), n)


def cover_version(url: Column, updated: Column) -> Column:
    return F.concat(url, F.lit("?v="), F.unix_timestamp(updated).cast("string"))


def is_email(c: Column) -> Column:
    """Close to, not the same as, the usual web-framework rule: no quoted local parts, no address literals."""
    return c.rlike(EMAIL)


def too_long(fields: dict[str, int]) -> Column:
    test = F.lit(False)
    for name, most in fields.items():
        test = test | (F.length(name) > most)
    return test


def base_href(html: Column, url: Column) -> Column:
    """A <base> right after the first <head>, up to the last slash of the url."""
    base = F.regexp_extract(url, r"^(.*/)", 1)
    head = F.regexp_extract(html, r"(?is)^(.*?<head(?:\s[^>]*)?>)", 1)
    return F.when(head == "", html).otherwise(F.concat(head, F.lit('<base href="'), base, F.lit('">'), F.substring(html, F.length(head) + 1, F.length(html))))


def before_head_end(html: Column, block: str) -> Column:
    front = F.regexp_extract(html, r"(?is)^(.*?)</head>", 1)
    found = html.rlike("(?i)</head>")
    return F.when(found, F.concat(front, F.lit(block), F.substring(html, F.length(front) + 1, F.length(html)))).otherwise(html)


def notes_in(notes: Column, text: Column) -> Column:
    """The notes whose [mark] stands in the text."""
    return F.map_filter(notes, lambda k, v: F.contains(text, F.concat(F.lit("["), k, F.lit("]"))))


def percent_decoded(text: Column) -> Column:
    """Percent-encoded text as a browser's decodeURIComponent reads it: a plus stays a plus. Null where an escape is no byte of UTF-8."""
    decoded, mark = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), chr(0xFFFD)  # the mark stands for broken bytes
    meant = F.upper(text).contains("%EF%BF%BD") | text.contains(mark)
    return F.when(~decoded.contains(mark) | meant, decoded)


def epub_name(title: Column, upload: Column) -> Column:
    """The e-book's name: its title, else the upload's name, without white space at the ends, else `book`."""
    return F.coalesce(filled(strip(F.coalesce(filled(title), upload))), F.lit("book"))


def attachment(name: Column) -> Column:
    """The header that offers a download under this name."""
    return F.concat(F.lit("attachment; filename*=UTF-8''"), url_quote(name))


def utf16_place(text: Column, units: Column) -> Column:
    """How many code points of the text stand before an offset in UTF-16 units, as a browser counts; a cut inside a pair falls before it."""
    wide = r"[\x{10000}-\x{10FFFF}]"
    marks = F.regexp_replace(F.regexp_replace(text, wide.replace("[", "[^", 1), "a"), wide, "bc")  # a letter a unit
    head = F.substring(marks, F.lit(1), F.greatest(units.cast("int"), F.lit(0)))
    pairs = F.length(head) - F.length(F.replace(head, F.lit("c"), F.lit("")))
    return F.length(head) - pairs - F.endswith(head, F.lit("b")).cast("int")


def header_filename(header: Column, default: str) -> Column:
    """The file name that a download's header gives, or the default; also for a name that cannot be decoded."""
    name = F.regexp_extract(header, r"filename\*=UTF-8''([^;]+)", 1)
    return F.coalesce(percent_decoded(filled(name)), F.lit(default))


def cookie(header: Column, name: str) -> Column:
    """The first cookie of this name, decoded; empty where there is none, it is empty, or it cannot be decoded."""
    found = F.regexp_extract(header, rf"(?:^|;\s*){re.escape(name)}=([^;]+)", 1)
    return F.coalesce(percent_decoded(found), F.lit(""))


def rows_for(text: Column) -> Column:
    return F.least(F.lit(12), F.greatest(F.lit(3), F.ceil(F.length(text) / 70)))


def text_links(text: Column) -> Column:
    """Plain text and [label](target) links in turn: array of (text, label, target, internal)."""
    pattern = LINK
    parts = F.split(text, pattern)
    labels, goals = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    zipped = F.arrays_zip(parts.alias("text"), labels.alias("label"), goals.alias("target"))
    return F.transform(zipped, lambda x: F.struct(x["text"], x["label"], x["target"], x["target"].startswith("/").alias("internal")))


def version_label(version: Column) -> Column:
    return F.substring_index(version, "+", 1)


def code_link(commit: Column, site: str) -> Column:
    """Address of the code at a commit, or of the code where the commit is empty or null."""
    return F.when(filled(commit).isNotNull(), F.concat(F.lit(f"{site}/tree/"), commit)).otherwise(site)


def commit_label(commit: Column) -> Column:
    return F.substring(F.coalesce(commit, F.lit("")), 1, 7)


def conversion_name(kind: str, key: Column, status: Column) -> Column:
    return F.concat(F.lit(f"{kind} "), key.cast("string"), F.lit(" ("), status, F.lit(")"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def has_file(name: Column) -> Column:
    """Is a file stored: its name is neither empty nor null."""
    return F.coalesce(name != "", F.lit(False))


#: Fixed value: what an e-book without book data says of itself.
NO_DATA = "No book data: the EPUB is the uploaded file."


def contents_line(headings: Column, paragraphs: Column, notes: Column) -> Column:
    """What goes into the e-book, or that there is no book data (null counts)."""
    line = F.concat(headings.cast("string"), F.lit(" headings, "), paragraphs.cast("string"), F.lit(" paragraphs, "), notes.cast("string"), F.lit(" notes"))
    return F.coalesce(line, F.lit(NO_DATA))


def page_title(title: Column, site: str) -> Column:
    return F.when(filled(title).isNotNull(), F.concat(title, F.lit(f" · {site}"))).otherwise(site)


def facts(*pairs: tuple[str, Column]) -> Column:
    """Label and value list, without empty and zero values."""
    return F.filter(F.array(*[F.struct(F.lit(k).alias("label"), v.cast("string").alias("value")) for k, v in pairs]), lambda x: x["value"].isNotNull() & ~x["value"].isin("", "0"))


def slug(c: Column) -> Column:
    """Unicode slug: NFKC, lower case, word characters and single hyphens; empty: book. A pandas UDF, as NFKC has no built-in."""
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        import re
        import unicodedata

        tidy = s.fillna("").map(lambda x: re.sub(r"[^\w\s-]", "", unicodedata.normalize("NFKC", x).lower()))
        return tidy.map(lambda x: re.sub(r"[-\s]+", "-", x).strip("-_") or "book") + ".epub"

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}  # as objects: names of this scope cannot be resolved later
    return F.pandas_udf(run, "string")(c)

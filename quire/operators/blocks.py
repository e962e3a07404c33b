"""Ordered blocks of books: sections, pages, counts. Rows are (doc_id, pos, type, level, page, role, include ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def book_order():
    return Window.partitionBy("doc_id").orderBy("pos")


def so_far():
    return book_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def is_heading():
    return F.col("type") == "heading"


def counts(blocks: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Headings and paragraphs (text blocks, no pictures) among included blocks, one row a book.

    notes: (doc_id, notes array, include_notes), one row a book; adds `notes`, their number where they are included, else 0.
    """
    shown = F.col("include")
    if notes is not None:
        n = notes.select("doc_id", F.when(F.col("include_notes"), F.size(F.coalesce("notes", F.array()))).otherwise(0).cast("long").alias("notes"))
        return counts(blocks).join(n, "doc_id", "left").withColumn("notes", F.coalesce("notes", F.lit(0)))
    return blocks.groupBy("doc_id").agg(F.count_if(shown & is_heading()).alias("headings"), F.count_if(shown & (F.col("type") == "text")).alias("paragraphs"))


def role_counts(blocks: DataFrame) -> DataFrame:
    """Roles other than body: blocks, and whether all are included."""
    return blocks.where("role <> 'body'").groupBy("doc_id", "role").agg(F.count("*").alias("n"), F.bool_and("include").alias("all_included"))


def page_range(blocks: DataFrame, *by: str) -> DataFrame:
    known = F.when(F.col("page") > 0, F.col("page"))
    return blocks.groupBy(*(by or ("doc_id",))).agg(F.min(known).alias("first_page"), F.max(known).alias("last_page"))


def with_section(blocks: DataFrame) -> DataFrame:
    """Adds section, from 0: one opens at each heading, and one before the first heading if blocks stand there."""
    before = F.first(~is_heading()).over(so_far()).cast("long")
    return blocks.withColumn("section", F.sum(is_heading().cast("long")).over(so_far()) - 1 + before)


def sections(blocks: DataFrame) -> DataFrame:
    s = with_section(blocks)
    return s.groupBy("doc_id", "section").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.bool_or("include").alias("any_included"), F.min(F.when(F.col("page") > 0, F.col("page"))).alias("first_page"), F.min_by("type", "pos").alias("opens_with"))


def level_at(blocks: DataFrame) -> DataFrame:
    """Level of the nearest heading before each block, else 1."""
    before = book_order().rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("level_at", F.coalesce(F.last(F.when(is_heading(), F.col("level")), ignorenulls=True).over(before), F.lit(1)).cast("long"))


def preview_places(blocks: DataFrame) -> DataFrame:
    """Adds section and paragraph of the preview; null before anything is included. An excluded block takes the place before it."""
    shown, head = F.col("include"), F.col("include") & is_heading()
    b = blocks.withColumn("_k", F.sum(shown.cast("long")).over(so_far())).withColumn("_h", F.sum(head.cast("long")).over(so_far()))
    lead = F.max(((F.col("_k") == 1) & shown & ~is_heading()).cast("long")).over(so_far())
    b = b.withColumn("section", F.when(F.col("_k") > 0, F.col("_h") - 1 + lead))
    part = Window.partitionBy("doc_id", "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum((shown & ~is_heading()).cast("long")).over(part) - 1
    return b.withColumn("paragraph", F.when((F.col("_k") > 0) & (n >= 0), n)).drop("_k", "_h")


def preview_pages(places: DataFrame, sizes: DataFrame) -> DataFrame:
    """Page of each block. sizes: (doc_id, section, page_no, paragraphs), pages of a book numbered in order.

    A paragraph's page is the first whose running count of the section exceeds it, past the end the section's last; a heading's the
    section's first; with no place it is page 1. File names have at least four digits.

    Pages and blocks are one sorted stream of a section: a page opens at the count of paragraphs before it, and each block
    takes the page opened last. So a section of any number of pages is sorted (and spilled), never held in one row.
    """
    by = ["doc_id", "section"]
    pages = Window.partitionBy(*by).orderBy("page_no")
    before = F.coalesce(F.sum("paragraphs").over(pages.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opens = F.when(F.row_number().over(pages) == 1, -1).otherwise(before).cast("long")  # the first one, before headings
    cuts = sizes.select(*by, opens.alias("_at"), F.lit(0).alias("_block"), F.col("page_no").alias("_page"))
    asked = places.withColumn("_at", F.coalesce("paragraph", F.lit(-1)).cast("long")).withColumn("_block", F.lit(1))
    stream = Window.partitionBy(*by).orderBy("_at", "_block", "_page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    page = F.coalesce(F.last("_page", ignorenulls=True).over(stream), F.lit(1)).cast("long")
    both = asked.unionByName(cuts, allowMissingColumns=True).withColumn("page_no", page).where("_block = 1")
    return both.withColumn("file", page_file(F.col("page_no"))).drop("_at", "_block", "_page")


def page_file(n):
    s = n.cast("string")
    return F.concat(F.when(F.length(s) < 4, F.lpad(s, 4, "0")).otherwise(s), F.lit(".xhtml"))


def open_section(blocks: DataFrame) -> DataFrame:
    """The first section with an included block, else 0."""
    s = with_section(blocks)
    return s.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("include"), F.col("section"))), F.lit(0)).cast("long").alias("open_section"))


def open_page(blocks: DataFrame) -> DataFrame:
    """Page of the first included block whose page is known, else 1."""
    fit = F.col("include") & (F.col("page") > 0)
    return blocks.groupBy("doc_id").agg(F.coalesce(F.min_by("page", F.when(fit, F.col("pos"))), F.lit(1)).cast("long").alias("open_page"))


def can_join(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("can_join", (F.col("type") == "text") & F.coalesce(F.lead("type").over(book_order()) == "text", F.lit(False)))


def neighbours(sections_: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("section")
    return sections_.select("doc_id", "section", F.lag("section").over(w).alias("previous"), F.lead("section").over(w).alias("next"))


def styled_runs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of text with their italic and bold state; only <i> </i> <b> </b> count, empty runs go. (key, run, text, italic, bold)

    Texts and tags alternate: what stands between tags, whatever its characters, and the tags themselves.
    """
    pattern = r"</?[ib]>"
    texts, tags = F.split(F.col(text), pattern), F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    zipped = F.flatten(F.transform(F.arrays_zip(texts.alias("t"), tags.alias("g")), lambda x: F.array(x["t"], F.substring(x["g"], 2, 3))))
    parts = rows.select(key, F.posexplode(zipped).alias("n", "piece")).where(F.col("piece").isNotNull())
    tag = F.col("n") % 2 == 1
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = lambda c: F.coalesce(F.last(F.when(tag & F.col("piece").isin(f"{c}>", f"/{c}>"), ~F.col("piece").startswith("/")), ignorenulls=True).over(w), F.lit(False))
    parts = parts.withColumn("italic", state("i")).withColumn("bold", state("b")).where(~tag & (F.col("piece") != ""))
    return parts.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1).cast("long").alias("run"), F.col("piece").alias("text"), "italic", "bold")


def chapters(summary: DataFrame, kept: Column) -> DataFrame:
    """Adds chapters: the headings of books that are kept with their data, else null."""
    return summary.withColumn("chapters", F.when(kept, F.col("headings")))


def contents_count(blocks: DataFrame) -> DataFrame:
    """Entries of the table of contents: all headings, included or not."""
    return blocks.groupBy("doc_id").agg(F.count_if(is_heading()).alias("n"))


def section_page(blocks: DataFrame, fallback: int) -> DataFrame:
    """First known page of each section, else the fallback."""
    return sections(blocks).select("doc_id", "section", F.coalesce("first_page", F.lit(fallback)).alias("page"))


def included(blocks: DataFrame) -> DataFrame:
    return blocks.where("include")


def page_known(blocks: DataFrame) -> DataFrame:
    return blocks.where("page > 0")


def non_body(blocks: DataFrame) -> DataFrame:
    return blocks.where("role <> 'body'")


#: Reasons why a book cannot be written.
NOTHING, NO_PICTURE = "nothing to write", "a picture must be a JPEG image with its width and height"


def problems(blocks: DataFrame) -> DataFrame:
    """Reasons why a book cannot be written, in the order of its blocks; an empty list means it can. (doc_id, problems)

    Known reasons: nothing is included; a picture (data in base64, width, height) is no JPEG image with its width and height.
    """
    jpeg = F.hex(F.substring(F.try_to_binary(F.coalesce("data", F.lit("")), F.lit("base64")), 1, 2)) == "FFD8"
    sound = F.coalesce(jpeg & (F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    bad = F.when((F.col("type") == "picture") & ~sound, F.struct("pos", F.concat(F.lit("block '"), F.col("id"), F.lit(f"': {NO_PICTURE}")).alias("text")))
    b = blocks.groupBy("doc_id").agg(F.count_if(F.col("include")).alias("n"), F.sort_array(F.collect_list(bad)).alias("bad"))
    nothing = F.array_compact(F.array(F.when(F.col("n") == 0, NOTHING)))
    return b.select("doc_id", F.concat(nothing, F.transform("bad", lambda x: x["text"])).alias("problems"))

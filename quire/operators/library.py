"""The catalogue: filters, searches, facets, orders and top rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.storage import hold

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = ["ord", "title", "uid"]


def published(books: DataFrame) -> DataFrame:
    return books.where("is_published")


def by_key(rows: DataFrame, column: str, value) -> DataFrame:
    """The row of a unique key, or none."""
    return rows.where(F.col(column) == value).limit(1)


def of_language(books: DataFrame, language: str) -> DataFrame:
    return books.where(F.col("language") == language) if language else books


def search(books: DataFrame, query: str) -> DataFrame:
    """Public search: one contiguous part of lower-cased "title author"; no wildcards. Empty: all."""
    q = query.strip().lower()
    return books.where(F.contains(F.lower(F.concat("title", F.lit(" "), "author")), F.lit(q))) if q else books


def admin_search(rows: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Each term in at least one field; case folded for ASCII letters only."""
    fold = lambda c: F.translate(c, UPPER, LOWER)
    for term in query.split():
        t = term.translate(str.maketrans(UPPER, LOWER))
        rows = rows.where(reduce(Column.__or__, [F.contains(fold(F.col(f)), F.lit(t)) for f in fields]))
    return rows


def facet(rows: DataFrame, **chosen) -> DataFrame:
    for name, value in chosen.items():
        rows = rows.where(F.col(name) == value)
    return rows


def facet_values(rows: DataFrame, *names: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [rows.groupBy(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")).agg(F.count("*").alias("n")) for n in names])


def library_order(books: DataFrame) -> DataFrame:
    return books.orderBy(*ORDER)


def places(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds place, from 1, in an order of all rows (it should be total). No task holds more than a range of them.

    Rows are range-sorted and held once; counts of ranges (one row each) give each range its first place.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = hold(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    counts = counts.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("place", inside).join(counts, F.col("_range") == F.col("_r")).withColumn("place", (F.col("place") + F.col("_base")).cast("long")).drop("_range", "_r", "_base")


def recent_order() -> list[Column]:
    return [F.desc("ts"), F.desc("event_id")]


def title_order(locale: bool = True) -> list[Column | str]:
    """By title in the root collation (letters before case, accents between them; any script), then as the library; without locale by code points.

    The order is of collation keys, so it holds across range partitions as well (places) and for a sort of the whole (orderBy).
    """
    return [F.collate("title", "UNICODE") if locale else F.col("title"), *ORDER]


def author_order(locale: bool = True) -> list[Column | str]:
    """By author, then title; see title_order."""
    return [F.collate("author", "UNICODE") if locale else F.col("author"), *title_order(locale)]


def first(books: DataFrame, n: int = 4) -> DataFrame:
    """The first n in library order: a top-n, not a sort."""
    return books.orderBy(*ORDER).limit(n)


def without(rows: DataFrame, column: str, value) -> DataFrame:
    """All rows but the one of this key."""
    return rows.where(F.col(column) != value)


def serialize(books: DataFrame) -> DataFrame:
    """The nine fields of a published book, in their order. epub_size is null without an e-book, chapters without kept data."""
    size = F.when(F.col("epub_url").isNotNull(), F.col("epub_size"))
    return books.select("title", F.col("uid").cast("string").alias("id"), "author", "language", "description", "cover_url", "epub_url", size.alias("epub_size"), "chapters")


def not_ready(status: Column, ready: str = "ready") -> Column:
    """The code for a conversion that is not read yet, else null."""
    return F.when(status != ready, "not_ready")


def media_rule(path: Column) -> Column:
    """serve, deny or attachment, by the first rule that holds: of a conversion's folder only its cover is served; PDFs elsewhere are downloads."""
    return F.when(path.rlike(r"^/media/conversions/[^/]+/(?!cover\.jpg$)"), "deny").when(path.rlike(r"^/media/.*\.pdf$"), "attachment").otherwise("serve")


def is_page(path: Column) -> Column:
    """Does the path go to a page, not to the interface, the admin, or files."""
    return ~path.rlike("^(api|admin|media|static)/")


def others(books: DataFrame, uid, n: int = 4) -> DataFrame:
    return first(without(books, "uid", uid), n)


def shelf(books: DataFrame, n: int = 4) -> DataFrame:
    """n slots with the first books that have a cover; empty slots at the end."""
    top = first(books.where(F.col("cover_url").isNotNull()), n).withColumn("slot", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ORDER)) - 1)
    return books.sparkSession.range(n).select(F.col("id").alias("slot")).join(top, "slot", "left")


def random_pick(books: DataFrame, seed: int) -> DataFrame:
    return books.orderBy(F.rand(seed)).limit(1)


def first_or(rows: DataFrame, order: str, column: str, default) -> DataFrame:
    """One row: the column of the first row, or the default."""
    return rows.orderBy(order).limit(1).agg(F.coalesce(F.first(column), F.lit(default)).alias(column))


def languages(books: DataFrame) -> DataFrame:
    """Distinct languages in the order in which library order meets them, if there are more than one.

    The first place of a language is the smallest (ord, title, uid) that has it, so no sort of all books is needed.
    """
    seen = books.where("language <> ''").groupBy("language").agg(F.min(F.struct(*ORDER)).alias("first"))
    w = Window.partitionBy(F.lit(0))  # one row a language
    ranked = seen.withColumn("rank", F.row_number().over(w.orderBy("first"))).withColumn("n", F.count("*").over(w))
    return ranked.where("n > 1").select("language", F.col("rank").cast("long").alias("rank"))

"""Conversions: uploads on their way to a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scalar import filled


def iso(ts: Column) -> Column:
    """A moment in UTC with its offset; microseconds only where there are some."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    micro = F.date_format(utc, "SSSSSS")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""), F.lit("+00:00"))


def records(conversions: DataFrame, steps: int) -> DataFrame:
    """What a reading page asks for, eleven fields in their order.

    conversions: id, name, size, pages, status, step, error, cover_url, created_at, and of the book title, author, language, headings, paragraphs,
    notes (null headings: no book yet). steps: how many steps reading has. An empty cover_url is null.
    """
    book = F.struct("title", "author", "language", "headings", "paragraphs", "notes")
    return conversions.select(
        F.col("id").cast("string").alias("id"), "name", "size", "pages", "status", "step", F.lit(steps).cast("long").alias("steps"), "error",
        filled(F.col("cover_url")).alias("cover_url"), F.when(F.col("headings").isNotNull(), book).alias("book"), iso(F.col("created_at")).alias("created_at"),
    )

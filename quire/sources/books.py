"""Books as JSON text: parsed once to VARIANT, checked there, refused texts kept with their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OBJECT = "map<string,variant>"
#: Fields of a block that are read as columns.
_FIELDS = "struct<type:string,id:string,page:int,role:string,include:boolean,level:int,label:string,title:string,text:string>"


def _bad(block: Column) -> Column:
    """Is this no block: an object with a text `type` and a flag `include`."""
    kind = F.schema_of_variant(F.coalesce(F.try_variant_get(block, "$.include", "variant"), F.parse_json(F.lit("null"))))
    name = F.schema_of_variant(F.coalesce(F.try_variant_get(block, "$.type", "variant"), F.parse_json(F.lit("null"))))
    return (kind != "BOOLEAN") | (name != "STRING")


def read_books(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows plus error, at, refused, metadata, blocks, notes, include_notes; the columns after error are of one parse of `text`.

    error, the first that holds: no_text (null), not_json (also for an object with a key twice), not_object, no_metadata (no object there), no_blocks
    (no list), bad_block (the place of the first is `at`, from 0), no_notes (no list, or include_notes no flag); null for a book. refused: the text of a
    refused row. Fields of another type than the schema's are null.
    """
    v = F.col("_v")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    parsed = rows.withColumn("_v", F.try_parse_json(text))
    opened = parsed.withColumns({"_whole": get("$", _OBJECT), "_meta": get("$.metadata", _OBJECT), "_blocks": get("$.blocks", "array<variant>"), "_notes": get("$.notes", "array<variant>"), "_flag": get("$.include_notes", "variant")})
    places = F.filter(F.transform("_blocks", lambda b, i: F.when(F.coalesce(_bad(b), F.lit(True)), i)), lambda i: i.isNotNull())
    found = opened.withColumn("at", F.get(places, 0).cast("long"))
    error = F.when(F.col(text).isNull(), "no_text").when(v.isNull(), "not_json").when(F.col("_whole").isNull(), "not_object").when(F.col("_meta").isNull(), "no_metadata")
    error = error.when(F.col("_blocks").isNull(), "no_blocks").when(F.col("at").isNotNull(), "bad_block")
    error = error.when(F.col("_notes").isNull() | F.coalesce(F.schema_of_variant("_flag") != "BOOLEAN", F.lit(True)), "no_notes")
    checked = found.withColumn("error", error)
    ok = F.col("error").isNull()
    return checked.select(
        *rows.columns, "error", F.when(F.col("error") == "bad_block", F.col("at")).alias("at"), F.when(~ok, F.col(text)).alias("refused"),
        F.when(ok, get("$.metadata", "struct<title:string,author:string,language:string,identifier:string>")).alias("metadata"),
        F.when(ok, F.transform("_blocks", lambda b: F.try_variant_get(b, "$", _FIELDS))).alias("blocks"),
        F.when(ok, F.transform("_notes", lambda n: F.try_variant_get(n, "$", "string"))).alias("notes"), F.when(ok, get("$.include_notes", "boolean")).alias("include_notes"),
    )


def counts(books: DataFrame) -> DataFrame:
    """books plus headings, paragraphs and notes that go into the e-book; null for a refused row."""
    shown = lambda kind: F.size(F.filter("blocks", lambda b: b["include"] & (b["type"] == kind))).cast("long")
    ok = F.col("error").isNull()
    return books.withColumns({"headings": F.when(ok, shown("heading")), "paragraphs": F.when(ok, shown("text")), "n_notes": F.when(ok, F.when(F.col("include_notes"), F.size("notes").cast("long")).otherwise(0))})

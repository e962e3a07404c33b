"""Edits of a book's nested blocks: columns in, columns out. Indexes count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scalar import filled, heading_text, notes_in, trim, utf16_place
from quire.sources.schemas import BLOCK

EMPTY_NOTES = "cast(map() as map<string,string>)"


def block(**fields) -> Column:
    """A block with the given fields, the others null."""
    names = [x.split(":")[0] for x in _fields(BLOCK)]
    put = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[put(fields.get(n)).alias(n) for n in names]).cast(BLOCK)


def _fields(kind: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in kind[len("struct<") : -1]:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out, now = [*out, now], ""
        else:
            now += c
    return [*out, now]


def _with(b: Column, **fields) -> Column:
    for k, v in fields.items():
        b = b.withField(k, v if isinstance(v, Column) else F.lit(v))
    return b


def edit_block(blocks: Column, at: Column | int, **fields) -> Column:
    return F.transform(blocks, lambda b, i: F.when(i == at, _with(b, **fields)).otherwise(b))


def splice(blocks: Column, start: Column | int, stop: Column | int, new: Column) -> Column:
    start, stop = (x if isinstance(x, Column) else F.lit(x) for x in (start, stop))
    return F.concat(F.slice(blocks, F.lit(1), start), new, F.slice(blocks, stop + 1, F.greatest(F.size(blocks) - stop, F.lit(0))))


def include_set(blocks: Column, at: Column, value: bool) -> Column:
    return F.transform(blocks, lambda b, i: F.when(F.array_contains(at, i), _with(b, include=value)).otherwise(b))


def include_role(blocks: Column, role: str, value: bool) -> Column:
    return F.transform(blocks, lambda b: F.when(b["role"] == role, _with(b, include=value)).otherwise(b))


def to_heading(b: Column, level: Column | int) -> Column:
    label = F.coalesce(filled(trim(b["text"])), F.lit("…"))
    return block(type="heading", id=b["id"], page=b["page"], role=b["role"], include=b["include"], level=level, label=label)


def to_text(b: Column) -> Column:
    text = heading_text(b["label"], b["title"])
    return block(type="text", id=b["id"], page=b["page"], role=b["role"], include=b["include"], text=text, lines=F.expr("cast(array() as array<string>)"), verse=False, epigraph=False, attribution=False, notes=F.expr(EMPTY_NOTES))


def set_type(blocks: Column, at: int, kind: str, level: int = 1) -> Column:
    def one(b: Column) -> Column:
        if kind == "heading":
            return F.when(b["type"] == "heading", _with(b, level=level)).when(b["type"] == "text", to_heading(b, level)).otherwise(b)
        return F.when(b["type"] == "heading", to_text(b)).otherwise(b)

    return F.transform(blocks, lambda b, i: F.when(i == at, one(b)).otherwise(b))


def heading_above(blocks: Column, at: int, new_id: str) -> Column:
    """A "…" heading before block `at`, with its page and the level of the nearest heading before, else 1."""
    before = F.filter(F.slice(blocks, F.lit(1), F.lit(at)), lambda b: b["type"] == "heading")
    level = F.coalesce(F.try_element_at(before, F.lit(-1))["level"], F.lit(1))
    new = block(type="heading", id=new_id, page=F.get(blocks, at)["page"], role="body", include=True, level=level, label="…")
    return splice(blocks, at, at, F.array(new))


def split(b: Column, offset: Column | int, new_id: str) -> Column:
    """Array of the two parts of a text block cut at a character offset (code points); null if a part is empty.

    Prose, and verse without lines, is cut there and trimmed. Verse is cut before the line that holds the offset, and its text is its
    lines joined by spaces.
    """
    o = offset if isinstance(offset, Column) else F.lit(offset)
    lines = b["lines"]
    verse = F.coalesce(b["verse"] & (F.size(lines) > 0), F.lit(False))
    ends = F.transform(lines, lambda x, i: F.aggregate(F.slice(lines, F.lit(1), i + 1), F.lit(0), lambda a, y: a + F.length(y) + 1))
    n = F.least(F.size(F.filter(ends, lambda e: e <= o)), F.size(lines) - 1)
    one = F.when(verse, F.array_join(F.slice(lines, F.lit(1), n), " ")).otherwise(trim(F.substring(b["text"], F.lit(1), F.greatest(o, F.lit(0)))))
    two = F.when(verse, F.array_join(F.slice(lines, n + 1, F.greatest(F.size(lines) - n, F.lit(0))), " ")).otherwise(trim(F.substring(b["text"], o + 1, F.length(b["text"]))))
    part = lambda text, l, id_: _with(b, text=text, lines=F.when(verse, l).otherwise(lines), notes=notes_in(b["notes"], text), id=id_)  # noqa: E731, E741
    parts = F.array(part(one, F.slice(lines, F.lit(1), n), b["id"]), part(two, F.slice(lines, n + 1, F.greatest(F.size(lines) - n, F.lit(0))), F.lit(new_id)))
    whole = F.when(verse, (n > 0) & (n < F.size(lines))).otherwise((one != "") & (two != ""))
    return F.when((b["type"] == "text") & whole, parts)


def split_at(blocks: Column, at: int, offset: Column | int, new_id: str, utf16: bool = False) -> Column:
    """utf16: the offset is in UTF-16 units, as a browser counts; else in code points."""
    b = F.get(blocks, at)
    if utf16:
        verse = F.coalesce(b["verse"] & (F.size(b["lines"]) > 0), F.lit(False))
        offset = utf16_place(F.when(verse, F.array_join(b["lines"], "\n")).otherwise(b["text"]), offset if isinstance(offset, Column) else F.lit(offset))
    parts = split(b, offset, new_id)
    return F.when(parts.isNotNull(), splice(blocks, at, at + 1, parts)).otherwise(blocks)


def join(a: Column, b: Column) -> Column:
    """Two text blocks as one: texts joined by a space, lines only if both are verse, notes with the right side winning."""
    verse = F.coalesce(a["verse"] & b["verse"], F.lit(False))
    left = F.map_filter(a["notes"], lambda k, v: ~F.map_contains_key(b["notes"], k))
    lines = F.when(verse, F.concat(a["lines"], b["lines"])).otherwise(F.expr("cast(array() as array<string>)"))
    return _with(a, text=F.concat_ws(" ", a["text"], b["text"]), lines=lines, verse=verse, notes=F.map_concat(left, b["notes"]))


def join_at(blocks: Column, at: int) -> Column:
    """Block `at` joined with the next, if both are text."""
    a, b = F.get(blocks, at), F.get(blocks, at + 1)
    fit = F.coalesce((a["type"] == "text") & (b["type"] == "text"), F.lit(False))
    return F.when(fit, splice(blocks, at, at + 2, F.array(join(a, b)))).otherwise(blocks)


def verse_text(blocks: Column, at: int, text: Column) -> Column:
    lines = F.split(text, "\n")
    return edit_block(blocks, at, lines=lines, text=F.array_join(lines, " "))


def metadata(m: Column, **fields) -> Column:
    """Title, author, language; an empty author is null."""
    out = _with(m, **fields)
    return out.withField("author", filled(out["author"]))


def strip_pictures(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.when(b["type"] == "picture", _with(b, data="")).otherwise(b))


def picture_rows(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The blocks of incoming books, one a row (doc_id, pos, b), with picture data from the stored ones, joined on (doc_id, block id).

    No picture of that id, or a null id: empty; several: the last. Both: (doc_id, blocks). Only stored pictures meet the incoming rows, each by itself.
    """
    pics = stored.select("doc_id", F.posexplode("blocks").alias("pos", "b")).where("b.type = 'picture' and b.id is not null")
    pics = pics.groupBy("doc_id", F.col("b.id").alias("_id")).agg(F.max_by("b.data", "pos").alias("_data"))
    rows = incoming.select("doc_id", F.posexplode("blocks").alias("pos", "b"))
    picture = F.col("b.type") == "picture"
    rows = rows.withColumn("_id", F.when(picture, F.col("b.id"))).join(pics, ["doc_id", "_id"], "left")
    return rows.select("doc_id", "pos", F.when(picture, F.col("b").withField("data", F.coalesce("_data", F.lit("")))).otherwise(F.col("b")).alias("b"))


def restore_pictures(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming with the picture data of the stored books in its blocks, one row a book; see picture_rows."""
    by_place = lambda a, b: F.when(a["pos"] < b["pos"], -1).otherwise(1)
    books = picture_rows(incoming, stored).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "b")), by_place).alias("_rows"))
    joined = incoming.join(books, "doc_id", "left")
    return joined.withColumn("blocks", F.coalesce(F.transform("_rows", lambda r: r["b"]), "blocks")).drop("_rows").select(*incoming.columns)


def save_merge(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """What is stored after a save: pictures restored, cover null, cover_source of the stored row. Both: (doc_id, blocks, cover, cover_source)."""
    kept = stored.select("doc_id", F.col("cover_source").alias("_source"))
    merged = restore_pictures(incoming, stored).join(kept, "doc_id", "left")
    return merged.withColumn("cover", F.lit(None).cast("string")).withColumn("cover_source", F.col("_source")).drop("_source")


def set_cover(rows: DataFrame, file: Column | None) -> DataFrame:
    if file is None:
        return rows.withColumn("cover", F.lit("")).withColumn("cover_source", F.lit("none"))
    return rows.withColumn("cover", file).withColumn("cover_source", F.lit("given"))

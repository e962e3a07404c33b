"""Files: uploads, zip members, JSON books, images; and sinks."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.scalar import MEDIA_TYPES, strip
from quire.sources.schemas import BOOK
from quire.sources.storage import file_system, put_file


def table(spark: SparkSession, path: str, *order: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.orderBy(*order) if order else rows


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, head): length and first five bytes. Page counts need a PDF library, which is not here.

    Spark's reader passes over files without a byte; an upload that has no row here is such a file (not_pdf) or none at all (no_file).
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.substring("content", 1, 5).alias("head"))


def parse_book(text: Column) -> Column:
    """A book, or null: no JSON, no object, or no list of blocks. An array at the top would parse to a struct of nulls, so it is refused first."""
    parsed = F.from_json(text, BOOK)
    blocks = F.get_json_object(text, "$.blocks")
    fit = F.btrim(text, F.lit(" \t\r\n")).startswith("{") & blocks.startswith("[") & parsed["blocks"].isNotNull()
    return F.when(F.coalesce(fit, F.lit(False)), parsed)


def form_field(fields: Column, name: str) -> Column:
    return strip(F.element_at(fields, name))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, type, content) of each member of each zip file; a file that is no zip gives one row with an error."""
    schema = "path string, name string, type string, content binary, error string"

    def members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in zip(part["path"], part["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for n in z.namelist():
                            kind = MEDIA_TYPES.get(PurePosixPath(n).suffix[1:], "application/octet-stream")
                            yield pd.DataFrame([(p, n, kind, z.read(n), None)], columns=["path", "name", "type", "content", "error"])
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(p, None, None, None, "not_zip")], columns=["path", "name", "type", "content", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, schema)


def zip_member(spark: SparkSession, path: str, name: str) -> DataFrame:
    return zip_members(spark, path).where(F.col("name") == name)


def image_kind(content: Column) -> Column:
    """jpeg or png by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head == "89504E470D0A1A0A", "png")


def _image_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) of a PNG or JPEG image from its header, else None. A JPEG's size stands in the first frame segment."""
    if data is None:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24]) if data[12:16] == b"IHDR" and len(data) >= 24 else None
    at = 2 if data[:3] == b"\xff\xd8\xff" else len(data)
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        if kind == 0xFF:  # a fill byte
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # without a length
            at += 2
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def image_size(content: Column) -> Column:
    """struct<width int, height int> from an image's header; null where none can be read. A pandas UDF, as a JPEG is a chain of segments."""

    def run(contents: pd.Series) -> pd.DataFrame:
        sizes = [_image_size(None if c is None else bytes(c)) or (None, None) for c in contents]
        return pd.DataFrame({k: pd.array([x[i] for x in sizes], "Int32") for i, k in enumerate(("width", "height"))})

    run.__annotations__ = {"contents": pd.Series, "return": pd.DataFrame}  # as objects: names of this scope cannot be resolved later
    size = F.pandas_udf(run, "width int, height int")(content)
    return F.when(size["width"].isNotNull(), size)


def images(spark: SparkSession, path: str, most: int = 10 << 20) -> DataFrame:
    """(path, size, error, content, kind, width, height): error is too_big, or not_image by the first bytes; the rest is null then, width and height also where the header is damaged."""
    files = spark.read.format("binaryFile").load(path)
    kind = image_kind(F.col("content"))
    code = F.when(F.col("length") > most, "too_big").when(kind.isNull(), "not_image")
    good = files.select("path", F.col("length").alias("size"), code.alias("error"), F.when(code.isNull(), F.col("content")).alias("content"), F.when(code.isNull(), kind).alias("kind"))
    return good.withColumn("_px", image_size(F.col("content"))).select("*", "_px.width", "_px.height").drop("_px")


def zipped(members: dict[str, str]) -> bytes:
    """A zip file of the members, in order of their names; a null one is empty."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for k, v in sorted(members.items()):
            z.writestr(k, v or "")
    return data.getvalue()


def write_zips(books: DataFrame, folder: str) -> DataFrame:
    """One zip a row of (name, problems, members map<string,string>) in folder, in storage that all executors share; rows with problems are
    refused. (name, file, error)

    The layout of a real e-book is not known here; members are written as given. Names are percent-encoded where they could leave the folder.
    Files appear by a move, so a task that runs again leaves whole files. The rows are written when the result is read, each time.
    """
    schema = "name string, file string, error string"

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import quote

        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if len(r.problems):
                    out.append((r.name, None, "; ".join(r.problems)))
                    continue
                file = f"{folder}/{quote(r.name or 'book', safe=' ')}.epub"
                put_file(file, zipped(dict(r.members)))
                out.append((r.name, file, None))
            yield pd.DataFrame(out, columns=["name", "file", "error"])

    return books.select("name", "problems", "members").mapInPandas(write, schema)


def delete_dirs(rows: DataFrame, column: str) -> DataFrame:
    """Deletes the folder that each row names, in shared storage; (folder, deleted). A folder that is not there or cannot go is no error."""

    def drop(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for folder in part["folder"]:
                try:
                    fs, path = file_system(folder)
                    fs.delete_dir(path)
                    done.append(True)
                except OSError:
                    done.append(False)
            yield pd.DataFrame({"folder": part["folder"], "deleted": done})

    return rows.where(F.col(column) != "").select(F.col(column).alias("folder")).distinct().mapInPandas(drop, "folder string, deleted boolean")


def json_list(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON object a row, nulls kept."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def stale(made: Column, updated: Column) -> Column:
    """Is a derived file missing or older than its source."""
    return made.isNull() | (made < updated)


def info(engine: str, commit: str, total: DataFrame) -> DataFrame:
    """One record: the engine's version, the whole commit that runs (a page cuts it, see commit_label), the total."""
    return total.select(F.lit(engine).alias("engine"), F.lit(commit).alias("commit"), F.col("count").alias("converted"))

"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about frame_bytes; a bundle ends with a seek table in a skippable
frame (the published seekable format: compressed and decompressed size of each frame, then a 9-byte footer). An index
maps each record to its bundle, frame and place in the frame, so one record costs one small ranged read. Records whose
payload stands elsewhere are revisit records, without payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut, join_by_key, new_folder, open_fs, put_file

#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

_INDEX = "record_id string, bundle string, frame int, at long, size long"


def record_name(page_id: int | None, digest: str) -> str:
    return f"urn:x-page:{'null-' + digest if page_id is None else page_id}"


def _head(fields: list[tuple[str, str]]) -> bytes:
    clean = [(k, " ".join(v.split("\r\n")).replace("\r", " ").replace("\n", " ")) for k, v in fields]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the digest and length of the payload, not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = payload if kind == "response" else b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_name(page_id, digest)}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_name(refers_to, digest)}>")]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return _head(fields) + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut off")
    return fields, rest[:n]


class Bundle:
    """Frames in memory; close() gives the whole file."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frame_bytes, self.open, self.done, self.sizes = frame_bytes, bytearray(), bytearray(), []

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, place in it) of the record."""
        if self.open and len(self.open) + len(data) > self.frame_bytes:
            self._end()
        at = len(self.sizes), len(self.open)
        self.open += data
        return at

    def _end(self) -> None:
        frame = self.pack(bytes(self.open))
        self.sizes.append((len(frame), len(self.open)))
        self.done += frame
        self.open = bytearray()

    def close(self) -> bytes:
        if self.open:
            self._end()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return bytes(self.done) + struct.pack("<II", SKIPPABLE, len(table)) + table


def frames(f, size: int) -> list[tuple[int, int, int]]:
    """(place, compressed, decompressed) of each frame, from the seek table at the end of the file."""
    n, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    table = f.read_at(n * entry, size - 9 - n * entry)
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", table, i * entry)
        out.append((at, c, d))
        at += c
    return out


def decide(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = 0) -> DataFrame:
    """pages plus _type and _refers_to: of equal payloads of at least `least` bytes, the largest id is the response.

    Only digests that occur twice or more are joined back; their table has one row a digest, and the payload of a frequent one
    is not gathered in one task. Null payload: empty. Null ids refer to the largest id; a group of null ids only has no
    revisits. Rows of equal id and payload are all responses.
    """
    data = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.withColumn("_sha", F.sha1(data)).withColumn("_n", F.octet_length(data))
    groups = rows.where(F.col("_n") >= least).groupBy("_sha").agg(F.max(id_col).alias("_top"), F.count("*").alias("_copies"))
    many = cut(groups.where("_copies > 1 and _top is not null"))
    out = join_by_key(rows, many.select("_sha", "_copies", "_top"), "_sha", "_copies", pages.count())
    again = F.col("_top").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_top"))
    return out.withColumn("_type", F.when(again, "revisit").otherwise("response")).withColumn("_refers_to", F.when(again, F.col("_top")))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 64 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write folder/bundles/*.warc.zst and folder/index/ (Parquet), in storage that executors share.

    A task streams its rows into bundles of about bundle_bytes, so its memory has a bound however many rows it has (a single
    page is held whole). A task that is run again leaves further bundles that no index row names. Null url: no target
    field. An empty table gives an empty index. Other columns are not written.
    """
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, rows = Bundle(frame_bytes, level), uuid.uuid4().hex, []

        def end() -> pa.RecordBatch:
            put_file(f"{folder}/bundles/{name}.warc.zst", now.close())
            return pa.RecordBatch.from_pylist(rows, pa.schema([("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("size", pa.int64())]))

        for b in batches:
            for page, url, text, kind, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = text or b""
                data = record(page, url, payload, kind, to, date)
                frame, at = now.add(data)
                rows.append({"record_id": record_name(page, base64.b32encode(hashlib.sha1(payload).digest()).decode()), "bundle": name, "frame": frame, "at": at, "size": len(data)})
                if len(now.done) >= bundle_bytes:
                    yield end()
                    now, name, rows = Bundle(frame_bytes, level), uuid.uuid4().hex, []
        if rows:
            yield end()

    out = decide(pages, id_col, text_col, least).select(F.col(id_col).cast("long"), url_col, F.encode(F.coalesce(text_col, F.lit("")), "UTF-8"), "_type", F.col("_refers_to").cast("long"))
    out.mapInArrow(bundle, _INDEX).write.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (record_id, page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload): every record in the index.

    payload is null for revisits. A payload that does not match its digest is an error.
    """
    schema = "record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    number = lambda x: None if x is None or "null-" in x else int(x.strip("<>").rpartition(":")[2])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        places: dict[str, list] = {}
        last, data = None, b""
        for b in batches:
            rows = b.to_pylist()
            for i in range(0, len(rows), 200):
                out = []
                for r in sorted(rows[i : i + 200], key=lambda r: (r["bundle"], r["frame"], r["at"])):
                    fs, path = open_fs(f"{folder}/bundles/{r['bundle']}.warc.zst")
                    if last != (r["bundle"], r["frame"]):
                        with fs.open_input_file(path) as f:
                            if r["bundle"] not in places:
                                places[r["bundle"]] = frames(f, f.size())
                            at, c, d = places[r["bundle"]][r["frame"]]
                            data = unpack(f.read_at(c, at), max_output_size=d)
                        last = r["bundle"], r["frame"]
                    head, body = parse(data[r["at"] : r["at"] + r["size"]])
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    if kind == "response" and (base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != int(head["X-Payload-Length"])):
                        raise ValueError(f"record {r['record_id']} does not match its digest")
                    out.append({"record_id": r["record_id"], "page_id": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": kind, "payload_digest": digest, "payload_bytes": int(head["X-Payload-Length"]), "refers_to": number(head.get("WARC-Refers-To")), "payload": body if kind == "response" else None})
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema(list(zip(out[0], kinds, strict=True))))

    return spark.read.parquet(f"{folder}/index").mapInArrow(fetch, schema)


def archive(pages: DataFrame, **options) -> tuple[str, DataFrame]:
    """Write to a new folder under the shared folder and open it: (folder, read(folder))."""
    folder = new_folder(pages.sparkSession, "warc")
    write(pages, folder, **options)
    return folder, read(pages.sparkSession, folder)

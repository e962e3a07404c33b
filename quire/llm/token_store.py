"""Token ids in a content-addressed store.

Each document's id stream is cut into chunks where a rolling hash of the last 16 ids says so, so equal passages give
equal chunks wherever they stand. A chunk's address is its 128-bit digest. Folder layout:

  packs/<name>.ids    unique chunks, back to back, as little-endian ids (2 bytes below 65,536 ids, else 4)
  recipes/            Parquet, files and rows in ascending doc_id: doc_id, start, n_tokens, root, parts (pack, offset, n, digest), range
  manifest/           Parquet: for each recipe range its ids, rows, tokens and Merkle root
  top                 number of ranges and the Merkle root of their roots

A document's root is the Merkle root of its chunk digests, a range's that of its documents' places and roots in order. read() first checks
the manifest against the top, and the roots of all recipes, grouped by range, against the manifest; then each chunk and
document as it is rebuilt. So a lost or changed file or byte is an error, not another id, however Spark splits the files.

Writing: encoding and cutting happen once and are staged in the shared folder; owners of chunks are chosen from the
digests alone (no ids are shuffled); each staged file then becomes one pack with the chunks it owns, so every
distinct chunk is stored once. Reading is sequential in a document's own pack.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import drop_folder, join_by_key, n_ranges, new_folder, open_fs, prefix_starts, put_file, slices
from quire.llm.substring_dedup import _rolling
from quire.llm.tokens import encoder

LEAST, MEAN, MOST, SPAN = 128, 512, 4096, 16


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over the leaves; an odd last node is carried up."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cuts(ids: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """For each of the documents that stand in ids one after another, the ends of its chunks.

    A chunk ends where the rolling hash has zeros, at least LEAST and at most MOST ids after the one before, and with the document.
    """
    h = _rolling((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), SPAN)
    marks = np.flatnonzero(h & np.uint64(MEAN - 1) == 0) + SPAN
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first, last = np.searchsorted(marks, starts + SPAN), np.searchsorted(marks, ends, "right")  # windows inside the document
    out = []
    for i, n in enumerate(sizes):
        done, end = [], 0
        for m in [*(marks[first[i] : last[i]] - starts[i]).tolist(), n]:
            while m - end > MOST:
                end += MOST
                done.append(end)
            if m - end >= LEAST or m == n:
                if m > end:
                    done.append(m)
                end = m
        out.append(done)
    return out


def _stage(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, folder: str) -> None:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        end = np.array([end_id], e.kind).tobytes()
        kinds = {"n_tokens": pa.int64(), "ids": pa.binary(), "root": pa.binary(), "chunks": pa.list_(pa.struct([("digest", pa.binary()), ("at", pa.int64()), ("n", pa.int64())]))}
        for whole in batches:
            for at, rows in slices(pa.compute.fill_null(pa.compute.binary_length(whole.column(1)), 0).to_pylist(), 1 << 20):  # texts may be long
                b = whole.slice(at, rows)
                streams = [e.ids(t or "") + end for t in b.column(1).to_pylist()]
                wide = e.kind.itemsize
                sizes = [len(x) // wide for x in streams]
                chunks, roots = [], []
                for data, found in zip(streams, cuts(np.frombuffer(b"".join(streams), e.kind), sizes), strict=True):
                    digests = [digest(data[a * wide : z * wide]) for a, z in zip([0, *found], found, strict=False)]
                    chunks.append([{"digest": d, "at": a, "n": z - a} for d, a, z in zip(digests, [0, *found], found, strict=False)])
                    roots.append(merkle(digests))
                out = {"n_tokens": sizes, "ids": streams, "root": roots, "chunks": chunks}
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[k], kind) for k, kind in kinds.items())], names=["doc_id", *kinds])

    schema = "doc_id long, n_tokens long, ids binary, root binary, chunks array<struct<digest binary, at long, n long>>"
    staged = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(encode, schema)
    staged.write.option("compression", "zstd").parquet(folder)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 50_000, range_parts: int = 1_000_000) -> None:
    """Write the store of the documents' ids, each with end_id appended, to folder (in storage that executors share).

    A range of recipes has about range_rows documents, or fewer, so that it has about range_parts chunks on average; a chunk takes some 70 bytes there.

    Null or empty text: the end id alone. Null ids come first; rows of equal id stand side by side, in an order that
    does not change between reruns on the same input. Other columns are not read. An empty table gives an empty store.
    """
    spark, stage = docs.sparkSession, f"{folder}/stage"
    _stage(docs, id_col, text_col, tokenizer, end_id, stage)
    staged = spark.read.parquet(stage)
    # part-<task>-<job>-<count>.<ending>: task and count tell the files of one write apart
    sample = next(iter(staged.inputFiles()), "").rpartition("/")[2]
    name = F.col("_metadata.file_name")
    file = F.concat(F.substring_index(F.substring_index(name, "-", 2), "-", -1), F.lit("-"), F.substring_index(F.substring_index(name, "-", -1), ".", 1))
    rows = staged.select(file.alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "n_tokens", "root", "chunks")
    parts = rows.select("file", "row", F.posexplode("chunks").alias("k", "c")).select("file", "row", "k", "c.*")
    owners = parts.groupBy("digest").agg(F.min(F.struct("file", "row", "k", "at", "n")).alias("o"), F.count("*").alias("copies")).select("digest", "copies", "o.*")

    def pack(key, table):
        import pyarrow.parquet as pq

        name = key[0].as_py()
        task, count = name.split("-")
        job, ending = sample.split("-", 2)[2].rpartition("-")[0], sample.rpartition("-")[2].partition(".")[2]
        fs, path = open_fs(f"{stage}/part-{task}-{job}-{count}.{ending}")
        table = table.sort_by([("row", "ascending"), ("k", "ascending")])
        row, at, n = (table.column(c).to_pylist() for c in ("row", "at", "n"))
        size, out, offset, i, first = 2, bytearray(), [], 0, 0
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(256, columns=["ids", "n_tokens"]):
                ids, lengths = b.column(0), b.column(1)
                while i < len(row) and row[i] < first + len(b):
                    data = ids[row[i] - first].as_py()
                    size = len(data) // lengths[row[i] - first].as_py()
                    offset.append(len(out))
                    out += data[at[i] * size : (at[i] + n[i]) * size]
                    i += 1
                first += len(b)
        put_file(f"{folder}/packs/{name}.ids", bytes(out))
        return pa.table({"digest": table.column("digest"), "copies": table.column("copies"), "pack": pa.array([name] * len(row)), "offset": pa.array(offset, pa.int64())})

    owned = owners.groupBy("file").applyInArrow(pack, "digest binary, copies long, pack string, offset long")
    # the packs are written once, by this action; a task that is run again writes the same bytes
    places = f"{folder}/places"
    owned.write.parquet(places)
    found = spark.read.parquet(places)
    n_docs, n_parts = rows.count(), found.agg(F.sum("copies")).first()[0] or 0
    where = join_by_key(parts.select("file", "row", "k", "digest", "n"), found, "digest", "copies", n_parts)
    recipe = where.groupBy("file", "row").agg(F.sort_array(F.collect_list(F.struct("k", "pack", "offset", "n", "digest"))).alias("parts"))
    ranges = max(n_ranges(spark, n_docs, range_rows), n_parts // range_parts)
    # ranges of the running sum become the files, without another sample of the rows
    sizes = prefix_starts(rows.select("doc_id", "n_tokens", "root", "file", "row"), "doc_id", "n_tokens", ranges, keep="range")
    out = sizes.join(recipe, ["file", "row"]).drop("file", "row").repartitionById(ranges, F.col("range")).sortWithinPartitions("start")
    out.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _roots(spark, folder).write.parquet(f"{folder}/manifest")
    put_file(f"{folder}/top", json.dumps(_top(spark, folder)).encode())
    drop_folder(stage)
    drop_folder(places)


_RANGE = "range int, first_id long, last_id long, rows long, n_tokens long, root binary"


def _roots(spark: SparkSession, folder: str) -> DataFrame:
    """One row a range, from the recipes without their parts; a range's rows, a bounded number, are put in order here, wherever they were read."""

    def run(key, table):
        rows = sorted(zip(*(table.column(k).to_pylist() for k in ("start", "doc_id", "n_tokens", "root")), strict=True), key=lambda r: r[0])
        ids = [r[1] for r in rows if r[1] is not None]  # ascending
        leaves = [f"{doc} {start} {n} ".encode() + root for start, doc, n, root in rows]
        out = (key[0].as_py(), ids[0] if ids else None, ids[-1] if ids else None, len(rows), sum(r[2] for r in rows), merkle(leaves))
        kinds = (pa.int32(), *[pa.int64()] * 4, pa.binary())
        return pa.table([pa.array([v], t) for v, t in zip(out, kinds, strict=True)], names=["range", "first_id", "last_id", "rows", "n_tokens", "root"])

    thin = spark.read.parquet(f"{folder}/recipes").select("range", "doc_id", "start", "n_tokens", "root")
    return thin.groupBy("range").applyInArrow(run, _RANGE)


def _top(spark: SparkSession, folder: str) -> dict:
    rows = spark.read.parquet(f"{folder}/manifest").select("range", "root").orderBy("range").collect()  # two values a range
    return {"ranges": len(rows), "root": merkle([str(r["range"]).encode() + r["root"] for r in rows]).hex()}


def verify(spark: SparkSession, folder: str) -> None:
    """ValueError if the manifest does not match the top, or the recipes do not match the manifest, range by range."""
    fs, path = open_fs(f"{folder}/top")
    with fs.open_input_stream(path) as f:
        top = json.loads(f.read())
    if _top(spark, folder) != top:
        raise ValueError(f"{folder}: the manifest does not match its root")
    names = ["range", *(c.split()[0] for c in _RANGE.split(", ")[1:])]
    said = spark.read.parquet(f"{folder}/manifest").select("range", F.struct(*names[1:]).alias("said"))
    there = _roots(spark, folder).select(F.col("range").alias("r"), F.struct(*names[1:]).alias("there"))
    if not said.join(there, F.col("range") == F.col("r"), "full").where(~F.col("said").eqNullSafe(F.col("there"))).isEmpty():
        raise ValueError(f"{folder}: recipes are lost or changed")


class _Packs:
    """Chunks by (pack, offset, length in bytes). Neighbours are read in one go; up to 64 files stay open for a task."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, {}

    def _file(self, pack: str):
        if pack not in self.files:
            while len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            fs, path = open_fs(f"{self.folder}/packs/{pack}.ids")
            self.files[pack] = fs.open_input_file(path)
        return self.files[pack]

    def fetch(self, wanted: set[tuple[str, int, int]]) -> dict[tuple[str, int], bytes]:
        got, spans = {}, sorted(wanted)
        i = 0
        while i < len(spans):
            pack, first, _ = spans[i]
            j, end = i, first
            while j < len(spans) and spans[j][0] == pack and spans[j][1] <= end + 4096 and spans[j][1] - first < 4 << 20:
                end = max(end, spans[j][1] + spans[j][2])
                j += 1
            data = self._file(pack).read_at(end - first, first)
            for _, o, n in spans[i:j]:
                got[pack, o] = data[o - first : o - first + n]
            i = j
        return got


def read(spark: SparkSession, folder: str, id_bytes: int = 2) -> DataFrame:
    """Rows (doc_id, start, n_tokens, root, ids): ids as little-endian unsigned 32-bit numbers, checked against the digests.

    verify() runs at once, over all recipes but their parts; chunks and documents are checked as they are read.
    """
    verify(spark, folder)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs(folder)
        for whole in batches:
            for at, rows in slices(whole.column("n_tokens").to_pylist()):
                b = whole.slice(at, rows)
                ends = np.cumsum(pa.compute.list_value_length(b.column("parts")).to_numpy()).tolist()
                flat = b.column("parts").flatten()
                names, places, n, digests = (flat.field(k).to_pylist() for k in ("pack", "offset", "n", "digest"))
                got = packs.fetch(set(zip(names, places, [x * id_bytes for x in n], strict=True)))
                out, i = [], 0
                for doc, root, end in zip(b.column("doc_id").to_pylist(), b.column("root").to_pylist(), ends, strict=True):
                    pieces = [got[names[k], places[k]] for k in range(i, end)]
                    if any(digest(x) != digests[k] for k, x in enumerate(pieces, i)) or merkle(digests[i:end]) != root:
                        raise ValueError(f"document {doc}: its chunks do not match its recipe")
                    out.append(np.frombuffer(b"".join(pieces), f"<u{id_bytes}").astype("<u4").tobytes())
                    i = end
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "n_tokens", "root")), pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "root", "ids"])

    recipes = spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", "n_tokens", "root", "parts")
    return recipes.mapInArrow(rebuild, "doc_id long, start long, n_tokens long, root binary, ids binary")


def store_of(docs: DataFrame, tokenizer: str, **options) -> tuple[str, DataFrame]:
    """Write a store to a new folder under the shared folder and open it: (folder, read(folder))."""
    folder = new_folder(docs.sparkSession, "tokens")
    write(docs, folder, tokenizer, **options)
    wide = 2 if encoder(tokenizer).kind.itemsize == 2 else 4
    return folder, read(docs.sparkSession, folder, wide)

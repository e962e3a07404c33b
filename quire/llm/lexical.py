"""Ranked lexical search: compressed postings a shard, merged document at a time.

Index (Parquet in the shared folder), one row a term and shard: the term's documents in ascending doc_id as gaps of places, with
counts, in bytes of seven bits; and one row a shard (term null) with its documents' ids and lengths. A shard is a run of the
documents that one task reads, cut by bytes, so texts are not shuffled.

Search: the statistics of the whole corpus are sums over the shards' rows. Queries come in blocks of bounded size; for each block the postings of
its terms meet in one task a shard. There a heap merges a query's postings by place; the best documents so far are a bounded heap by score,
then doc_id. Lists that together cannot lift a document above the worst kept score leave the merge and are only looked up for
documents that the others bring, which changes no result. Shards' best rows are merged in two rounds.

A score is a sum of integers: w * ((10^9 tf) div (1000 tf + 20 m)), w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + (50 n N) div L.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from quire.llm.common import cut, new_folder, only, release

_INDEX = "shard long, term binary, df long, tokens long, with_terms long, postings binary, ids binary"

#: Bytes of terms, with A-Z in lower case; all others, of ASCII, end a term. Bytes of other characters are all above 127.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in order, all as UTF-8: runs of ASCII letters (in lower case), ASCII digits and characters beyond ASCII."""
    return (text or b"").translate(_FOLD).split()


def pack_numbers(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers >= 0 as bytes of seven bits, lowest first, the last one of a number without the high bit: (bytes, end of each number)."""
    v = v.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for shift in range(7, 64, 7):
        size += v >> np.uint64(shift) > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[(ends - size)[has] + k] = (v[has] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
    return out, ends


def unpack_numbers(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first)


class _Shard:
    """Documents of a shard as they come: for each its id, its length, and its terms as numbers with their counts."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.ids, self.lengths, self.sizes, self.codes, self.counts, self.held = [], array("q"), array("q"), array("I"), array("I"), 0

    def add(self, i: int | None, text: bytes) -> None:
        words = terms(text)
        c, numbers = Counter(words), self.numbers
        self.codes.extend([numbers.setdefault(t, len(numbers)) for t in c])
        self.counts.extend(c.values())
        self.ids.append(i)
        self.lengths.append(len(words))
        self.sizes.append(len(c))
        self.held += len(text) + 16

    def memory(self) -> int:
        """Bytes that the shard takes about: an entry of 150 bytes and the bytes of a term, 12 bytes a posting and its place."""
        return self.held + 150 * len(self.numbers) + 12 * len(self.codes)

    def rows(self, number: int, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
        """The index rows of the shard: that of its documents, then those of its terms, about `most` postings at a time, so that no copy of all is made."""
        docs, names = len(self.ids), list(self.numbers)
        order = sorted(range(docs), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        lengths = np.array(self.lengths, np.int64)[order]
        ids = np.array([self.ids[k] or 0 for k in order], "<i8").tobytes() + np.array([self.ids[k] is None for k in order], np.uint8).tobytes()
        packed = pack_numbers(lengths)[0].tobytes()
        yield _rows(number, [None], [docs], [packed], [int(lengths.sum())], [int((lengths > 0).sum())], [ids])
        place = np.empty(docs, np.int32)
        place[order] = np.arange(docs)
        code, tf, doc = np.asarray(self.codes), np.asarray(self.counts), np.repeat(place, self.sizes)
        df = np.bincount(code, minlength=len(names))
        ends, a = np.cumsum(df), 0
        while a < len(names):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            mine = np.flatnonzero((code >= a) & (code < z))
            mine = mine[np.argsort(code[mine].astype(np.int64) * docs + doc[mine])]
            last = np.cumsum(df[a:z])
            start, at = last - df[a:z], doc[mine].astype(np.int64)
            values = np.empty(2 * len(mine), np.int64)
            values[::2], values[1::2] = np.diff(at, prepend=0), tf[mine]
            values[2 * start] = at[start]
            data, bounds = pack_numbers(values)
            flat, bounds = data.tobytes(), [0, *bounds[2 * last - 1].tolist()]
            yield _rows(number, names[a:z], df[a:z].tolist(), [flat[x:y] for x, y in pairwise(bounds)])
            a = z


def _rows(number: int, names: list, df: list[int], packed: list[bytes], *of_docs: list) -> pa.RecordBatch:
    """Index rows; of_docs: tokens, with_terms, ids, which rows of terms lack."""
    columns = [[number] * len(names), names, df, *(of_docs[:2] or [[None] * len(names)] * 2), packed, of_docs[2] if of_docs else [None] * len(names)]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "term", "df", "tokens", "with_terms", "postings", "ids"])


def build(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 32 << 20) -> DataFrame:
    """Write the index of all documents to folder and open it. shard_bytes bounds a shard's texts, and four times it what the shard takes in memory, and
    so the memory of one task; a longer text is a shard of its own.

    Null texts have no terms. Null ids rank after all others of equal score; rows of equal id are documents of their own.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        part, k, shard = TaskContext.get().partitionId(), 0, _Shard()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                text = t.as_py() or b""
                if shard.held and (shard.held + len(text) > shard_bytes or shard.memory() > 4 * shard_bytes):
                    yield from shard.rows((part << 32) + k)
                    k, shard = k + 1, _Shard()
                    release()
                shard.add(i, text)
        if shard.held:
            yield from shard.rows((part << 32) + k)
        del shard
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col)).mapInArrow(shards, _INDEX)
    rows.write.option("compression", "zstd").parquet(folder)
    return open_index(docs.sparkSession, folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(folder)


class _Lists:
    """Postings of one shard as (places, scores without w), unpacked once for all queries."""

    def __init__(self, lengths: np.ndarray, n: int, total: int):
        self.m, self.lists, self.packed = 50 + 50 * lengths * n // max(total, 1), {}, {}

    def get(self, term: int) -> tuple[list[int], np.ndarray, int] | None:
        if term not in self.lists:
            if term not in self.packed:
                return None
            v = unpack_numbers(self.packed.pop(term))
            doc, tf = np.cumsum(v[::2]), v[1::2]
            part = 1_000_000_000 * tf // (1000 * tf + 20 * self.m[doc])
            self.lists[term] = doc.tolist(), part.tolist(), int(part.max())
        return self.lists[term]


def best_of(lists: list[tuple[list[int], list[int], int, int]], k: int) -> list[tuple[int, int]]:
    """(score, place) of the k best documents with a score above 0, best first, equal scores by ascending place.

    lists: for each term its ascending places, their scores, the largest of these, and the weight w.
    """
    lists = sorted((x for x in lists if x[2] * x[3] > 0), key=lambda x: x[2] * x[3])
    width = len(lists)
    places, parts, weight = [x[0] for x in lists], [x[1] for x in lists], [x[3] for x in lists]
    reach, total = [], 0  # what the lists up to this one give at most
    for x in lists:
        total += x[2] * x[3]
        reach.append(total)
    at, low = [0] * width, 0  # lists below `low` are looked up only
    heap = [places[i][0] * width + i for i in range(width)]
    heapify(heap)
    best: list[tuple[int, int]] = []  # (score, -place), worst first
    bar = 0
    while heap:
        place = heap[0] // width
        score, limit = 0, (place + 1) * width
        while heap and heap[0] < limit:
            i = heap[0] % width
            a = at[i]
            at[i] = a + 1
            if i >= low:
                score += parts[i][a] * weight[i]
                if a + 1 < len(places[i]):
                    heapreplace(heap, places[i][a + 1] * width + i)
                else:
                    heappop(heap)
            else:  # it left the merge with its next place still in the heap
                at[i] = a
                heappop(heap)
        for i in range(low - 1, -1, -1):
            if score + reach[i] <= bar:
                break
            a = at[i] = bisect_left(places[i], place, at[i])
            if a < len(places[i]) and places[i][a] == place:
                score += parts[i][a] * weight[i]
        if score > bar:
            if len(best) < k:
                heappush(best, (score, -place))
            else:
                heapreplace(best, (score, -place))
            if len(best) == k:
                bar = best[0][0]
                while low < width and reach[low] <= bar:
                    low += 1
                if low == width:  # no document can do better
                    break
    return [(s, -p) for s, p in sorted(best, reverse=True)]


def _blocks(queries: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, int | None, list[bytes]]]]:
    """Blocks of (number, id, distinct terms) of the queries, each of about block_bytes of text, one at a time on the driver."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted(set(terms(t))) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.binary()))], names=["q", "id", "terms"])

    rows = queries.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = cut(rows.mapInArrow(split, f"q long, id {dict(queries.dtypes)[id_col]}, terms array<binary>"))
    size = F.aggregate("terms", F.lit(64).cast("long"), lambda a, t: a + F.octet_length(t) + 8)
    n = -(-(rows.agg(F.sum(size)).first()[0] or 0) // block_bytes)
    for i in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("q"), F.lit(n)) == i).toLocalIterator()]


def search(index: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Rows (id_col, rank int, doc_id long, score long): the k documents with the highest score above 0 for each query, or all if they are fewer.

    Equal scores by ascending doc_id, null ids last. Each row of queries is a query; those without terms, or null, have no result. Empty tables
    give an empty result.
    """
    spark = index.sparkSession
    kind = queries.schema[id_col].dataType
    totals = index.where("term is null").agg(F.sum("with_terms"), F.sum("tokens"), F.count("*")).first()
    n, total, shards = totals[0] or 0, totals[1] or 0, totals[2]
    out = spark.createDataFrame([], f"q long, `{id_col}` {kind.simpleString()}, rank int, doc_id long, score long")
    for block in _blocks(queries, id_col, text_col, block_bytes):
        found = _search(index, block, k, n, total, to_arrow_type(kind))
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        # two rounds, so that a query's rows of all shards never meet at once
        for key in ([F.pmod(F.xxhash64("shard"), F.lit(shards // 64 + 1))], []):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q", *key).orderBy(*order))).where(F.col("rank") <= k)
        out = out.unionByName(found.select("q", F.col("id").alias(id_col), F.col("rank").cast("int"), "doc_id", "score"))
    return out.drop("q")


def _search(index: DataFrame, block: list[tuple], k: int, n: int, total: int, id_type: pa.DataType) -> DataFrame:
    """(q, id, shard, doc_id, score): each shard's k best documents of each query of the block."""
    spark = index.sparkSession
    names = sorted({t for _, _, ts in block for t in ts})
    numbers = {t: i for i, t in enumerate(names)}
    wanted = F.broadcast(spark.createDataFrame(list(numbers.items()), "term binary, number int"))  # the block's terms
    df = {r["number"]: r["df"] for r in index.join(wanted, "term").groupBy("number").agg(F.sum("df").alias("df")).collect()}
    weight = {i: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for i, d in df.items()}
    asked = spark.sparkContext.broadcast([(q, i, [(numbers[t], weight[numbers[t]]) for t in ts if numbers[t] in df]) for q, i, ts in block])

    long = pa.int64()
    kinds = [long, id_type, long, long, long]

    def run(key, table):
        whole = table.column("number").to_pylist()
        docs = whole.index(None)
        ids = table.column("ids")[docs].as_py()
        lists = _Lists(unpack_numbers(table.column("postings")[docs].as_py()), n, total)
        lists.packed = {t: p for t, p in zip(whole, table.column("postings").to_pylist(), strict=True) if t is not None}
        size = len(ids) // 9
        names, none = np.frombuffer(ids, "<i8", size).tolist(), np.frombuffer(ids, np.uint8, size, 8 * size).tolist()
        rows = []
        for q, i, ts in asked.value:
            mine = [(*got, w) for t, w in ts if (got := lists.get(t)) is not None]
            rows += [(q, i, key[0].as_py(), None if none[p] else names[p], s) for s, p in best_of(mine, k)]
        columns = zip(*rows, strict=True) if rows else ([],) * 5
        return pa.table([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=["q", "id", "shard", "doc_id", "score"])

    postings = index.join(wanted, "term", "left").where("number is not null or term is null").select("shard", "number", "postings", "ids")
    return postings.groupBy("shard").applyInArrow(run, f"q long, id {from_arrow_type(id_type).simpleString()}, shard long, doc_id long, score long")


def search_all(docs: DataFrame, queries: DataFrame, k: int = 50, **options) -> DataFrame:
    """Index docs in a new folder under the shared folder and search it."""
    return search(build(docs, new_folder(docs.sparkSession, "index")), queries, k, **options)

"""Substring dedup by fixed-block anchors.

Blocks of `block` words, at word positions 0, block, 2 * block ... of a document, are the reference index. Every rolling
window of `block` words probes it. A repeat of `window` = 2 * block - 1 words holds one whole reference block, whatever its
offset, so no repeat is missed. A hit is extended word by word: every window of full length that holds the hit block is compared by
a 64-bit hash of all its words, and repeated windows that overlap grow together into one span. A span is maximal: the words
before and after it are in no repeated window. It may join repeats of several earlier documents.

Documents are dealt into chunks of about chunk_bytes of text by ascending doc_id. Only bits have to travel back: "this
block stands in an earlier chunk" settles the question for a whole chunk, and inside a chunk the documents are at hand. A chunk sends
each distinct hash once, so a passage that a third of all documents share costs one entry a chunk and no pairs are ever made. Hashes
go to buckets by their high bits, 4 bytes each as sorted differences; collisions of these only cost extra comparisons, as a repeat
counts only after its full 64-bit window hash agrees.

The documents are shuffled once, by chunk; the three passes reread that exchange.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_bounds, only, range_of, release, text_bytes

_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_ASK = "bucket int, chunk long, kind int, blob binary"
_TOLD = "chunk long, kind int, bucket int, blob binary"
_LAST = np.iinfo(np.int64).max
MOST_CHUNKS = 400_000  # their bounds, 8 bytes each, are in the plan
ROW = 16  # bytes that a row counts besides its text


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_hash = _WordHash()


def _rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries of h; one for each start that has k. A polynomial: runs of a and b entries give those of a + b."""
    n = max(0, len(h) - k + 1)
    if not n:
        return h[:0].copy()
    power, reach, out, have = _MULTIPLY, 1, None, 0  # h holds the runs of `reach` entries, out those of `have`
    while True:
        if k & reach:
            if out is None:
                out = h.copy()
            else:
                m = min(len(out), len(h) - have)
                out = out[:m] * power + h[have : have + m]
            have += reach
        if have == k:
            break
        h = h[: max(0, len(h) - reach)] * power + h[reach:]
        power, reach = np.uint64(int(power) ** 2 % (1 << 64)), 2 * reach
    out = out[:n]
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


def _pack(values: np.ndarray) -> bytes:
    """Sorted values as the byte planes of their differences; planes of zeros shrink in the shuffle's compression."""
    d = np.diff(values, prepend=values.dtype.type(0))
    return d.view(np.uint8).reshape(-1, d.itemsize).T.tobytes()


def _unpack(blob: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    d = np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()
    return np.cumsum(d, dtype=kind)


def _any_of(flags: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of the first n starts: is one of the k flags from there set."""
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    c = np.concatenate([c, np.full(k, c[-1], np.int32)])
    return c[k : n + k] > c[:n]


class _Chunk:
    """The documents of a chunk in ascending id, their word hashes and block windows."""

    def __init__(self, table: pa.Table, window: int, block: int, buckets: int):
        only(_hash)
        release()  # of the chunk before
        ids, texts = table.column("_id").to_pylist(), table.column("_text").cast(pa.binary()).to_pylist()
        self.window, self.block, self.buckets = window, block, buckets
        self.table = table
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        # word objects outweigh the text many times, so they are held for one document at a time
        self.order, self.texts = order, [texts[i] or b"" for i in order]
        hashes = [np.fromiter(map(_hash.__getitem__, t.split()), np.uint64) for t in self.texts]
        self.lengths = np.array([len(x) for x in hashes], np.int64)
        total = int(self.lengths.sum())
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        del hashes
        doc = np.repeat(np.arange(len(order)), self.lengths)
        ends = np.cumsum(self.lengths)
        left = ends[doc] - np.arange(total) if total else np.zeros(0, np.int64)
        at = np.arange(total) - (ends - self.lengths)[doc] if total else left
        rank, last, ranks = -1, object(), []
        for i in order:  # equal ids have equal rank; none is smaller than the other
            if ids[i] is None or ids[i] != last:
                rank, last = rank + 1, ids[i]
            ranks.append(rank)
        known = np.array([ids[i] is not None for i in order], bool)
        self.rank = np.array(ranks, np.int64)[doc] if total else left
        fit = (self.lengths >= window) & known
        fit = fit[doc] if total else np.zeros(0, bool)
        self.starts = np.zeros(total, bool)  # where a whole window starts
        self.starts[:] = fit & (left >= window)
        self.h, self.total = h, total
        g = _rolling(h, block)
        self.probe = np.flatnonzero((fit & (left >= block))[: len(g)])
        self.aligned = at[self.probe] % block == 0
        g = g[self.probe]
        key = ((g >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF))
        self.keys, self.inverse = np.unique(key, return_inverse=True)
        self.parts = np.searchsorted(self.keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        self.is_block = np.zeros(len(self.keys), bool)
        self.is_block[self.inverse[self.aligned]] = True

    def ask(self, chunk: int) -> Iterator[tuple]:
        low = (self.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for b in range(self.buckets):
            i, j = self.parts[b], self.parts[b + 1]
            if j > i:
                yield b, chunk, 0, int(j - i).to_bytes(4, "little") + np.packbits(self.is_block[i:j]).tobytes() + _pack(low[i:j])

    def candidates(self, told: list[dict]) -> None:
        """Windows around hits, from the replies and from the chunk itself: where, key, first reference."""
        n = len(self.keys)
        hit, ref = np.zeros(n, bool), np.zeros(n, bool)
        for r in told:
            if r["kind"] == 0:
                i, j = self.parts[r["bucket"]], self.parts[r["bucket"] + 1]
                bits = np.unpackbits(np.frombuffer(r["blob"], np.uint8))
                m = (j - i + 7) // 8 * 8
                hit[i:j], ref[i:j] = bits[: j - i], bits[m : m + j - i]
        rank = self.rank[self.probe]
        first, last = np.full(n, _LAST), np.full(n, -1)
        a = np.flatnonzero(self.aligned)[::-1]
        first[self.inverse[a]] = rank[a]  # the last write is the smallest rank
        last[self.inverse] = rank
        far, near = np.zeros(self.total, bool), np.zeros(self.total, bool)
        far[self.probe], near[self.probe] = hit[self.inverse], first[self.inverse] < rank
        far_ref, near_ref = np.zeros(self.total, bool), np.zeros(self.total, bool)
        far_ref[self.probe] = ref[self.inverse] & self.aligned
        near_ref[self.probe] = (last[self.inverse] > rank) & self.aligned
        span = self.window - self.block + 1
        grown = [_any_of(x, span, self.total) & self.starts for x in (far, far_ref, near, near_ref)]
        self.where = np.flatnonzero(grown[0] | grown[1] | grown[2] | grown[3])
        full = _rolling(self.h, self.window)[self.where]
        self.windows, self.window_of = np.unique(full, return_inverse=True)
        asks, refs, near, near_ref = (x[self.where] for x in grown)
        m, rank = len(self.windows), self.rank[self.where]
        self.asks, self.refs = np.zeros(m, bool), np.zeros(m, bool)
        self.asks[self.window_of[asks]] = True
        self.refs[self.window_of[refs]] = True
        first = np.full(m, _LAST)
        a = np.flatnonzero(near_ref)[::-1]
        first[self.window_of[a]] = rank[a]
        self.repeated = near & (first[self.window_of] < rank)
        self.sent = np.flatnonzero(self.asks | self.refs)
        bucket = (self.windows[self.sent] >> np.uint64(7)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")  # in a bucket, values stay ascending
        self.sent, bucket = self.sent[order], bucket[order]
        first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(self.buckets)))
        self.sent_to = {int(bucket[i]): self.sent[i:j] for i, j in zip(first, [*first[1:], len(bucket)], strict=False)}

    def ask_windows(self, chunk: int) -> Iterator[tuple]:
        for b, i in self.sent_to.items():
            yield b, chunk, 1, len(i).to_bytes(4, "little") + np.packbits(self.asks[i]).tobytes() + np.packbits(self.refs[i]).tobytes() + _pack(self.windows[i])

    def removed(self, told: list[dict]) -> np.ndarray:
        """For each word: is it covered by a repeated window."""
        seen = np.zeros(len(self.windows), bool)
        for r in told:
            if r["kind"] == 1:
                i = self.sent_to[r["bucket"]]
                seen[i] = np.unpackbits(np.frombuffer(r["blob"], np.uint8))[: len(i)]
        # a window of this chunk's own first document counts as repeated only by an earlier chunk
        at = self.where[self.repeated | seen[self.window_of]]
        step = np.zeros(self.total + 1, np.int32)
        np.add.at(step, at, 1)
        np.add.at(step, at + self.window, -1)
        return np.cumsum(step)[:-1] > 0


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table({n: pa.array([r[k] for r in rows], kinds[schema.split(", ")[k].split()[1]]) for k, n in enumerate(names)})


def _answer(table):
    """One bucket: for each chunk's entries, does an earlier chunk have them as reference, and does a later chunk ask."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    kind = rows[0]["kind"]
    values, asks, refs, chunks, sizes = [], [], [], [], []
    for r in rows:
        blob = r["blob"]
        n = int.from_bytes(blob[:4], "little")
        m = (n + 7) // 8
        bits = lambda i, blob=blob, n=n, m=m: np.unpackbits(np.frombuffer(blob, np.uint8, m, 4 + i * m))[:n].astype(bool)
        sizes.append(n)
        chunks.append(np.full(n, r["chunk"], np.int64))
        asks.append(np.ones(n, bool) if kind == 0 else bits(0))
        refs.append(bits(0 if kind == 0 else 1))
        values.append(_unpack(blob[4 + m * (1 + kind) :], n, np.uint64 if kind else np.uint32))
    value, ask, ref, chunk = map(np.concatenate, (values, asks, refs, chunks))
    order = np.argsort(value, kind="stable")
    value, c = value[order], chunk[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    group = np.cumsum(np.concatenate([[True], value[1:] != value[:-1]])) - 1
    first = np.minimum.reduceat(np.where(ref[order], c, _LAST), start)[group]
    last = np.maximum.reduceat(np.where(ask[order], c, -1), start)[group]
    hit, wanted = np.zeros(len(value), bool), np.zeros(len(value), bool)
    hit[order], wanted[order] = (first < c) & ask[order], (last > c) & ref[order]
    out, i = [], 0
    for r, n in zip(rows, sizes, strict=True):
        h, w = hit[i : i + n], wanted[i : i + n]
        i += n
        if h.any() or w.any():
            out.append((r["chunk"], kind, r["bucket"], np.packbits(h).tobytes() + (b"" if kind else np.packbits(w).tobytes())))
    return _rows(out, _TOLD)


def without(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of the spans (start, end), each with the white space before it; other white space stays, but for any that would then stand first."""
    if not spans:
        return text
    ends = [0, *(m.end() for m in re.finditer(rb"[^\x20\t-\r]+", text))]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : ends[start]])
        at = ends[end]
    left = b"".join([*out, text[at:]])
    return left.lstrip() if spans[0][0] == 0 else left


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, chunk_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20, carry: tuple[str, ...] = (), layout: bool = False) -> DataFrame:
    """Words of each document that lie in a window of `window` words which also starts in a document of smaller id.

    Result, one row a document: id_col, n_words long, n_removed long, spans array<struct<start int, end int>> (maximal
    runs of removed words), kept_text string (kept words joined by one space; with layout the text as it is, without the
    removed words and the white space before each). window must be odd.

    Null text: no words. Null id: the row stays whole and is no reference. Rows of equal id are no reference for each
    other, and stay in one chunk. Fewer than `window` words: nothing is removed. An empty table gives an empty result. Columns named in
    carry follow in the result, each row's own also where ids repeat; others are not read.
    chunk_bytes bounds the text that a task holds (about 23 bytes of memory for each byte; a row counts ROW bytes besides its text), but for one long
    document. There are at most MOST_CHUNKS: beyond that chunks grow with the input, and buckets with them, so their number stays bounded too.
    """
    if window % 2 == 0:
        raise ValueError("window must be odd")
    block, id_type = (window + 1) // 2, dict(docs.dtypes)[id_col]
    total = text_bytes(docs, text_col, ROW)
    # beyond MOST_CHUNKS both grow, so a chunk's entry for a bucket stays worth its header
    chunk_bytes, bucket_bytes = (max(x, total // MOST_CHUNKS) for x in (chunk_bytes, bucket_bytes))
    buckets = max(1, -(-total // bucket_bytes))
    from_docs = {c: "_text" if c == text_col else f"_carry{i}" for i, c in enumerate(carry)}
    more = [F.col(c).alias(x) for c, x in from_docs.items() if x != "_text"]
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *more)
    bounds = byte_bounds(docs.select(id_col, (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW).alias("_size")), id_col, "_size", chunk_bytes)
    n_chunks = max(len(bounds) + 1, -(-total // chunk_bytes))
    spread = F.pmod(F.xxhash64("_text"), F.lit(n_chunks)).cast("long")  # rows without id are no reference: any chunk serves
    chunk = F.when(F.col("_id").isNull(), spread).otherwise(range_of(F.col("_id"), bounds)).cast("long")
    keyed = d.withColumn("chunk", chunk).repartition(n_chunks, "chunk")

    def first(key, table):
        c = key[0].as_py()
        return _rows(list(_Chunk(table, window, block, buckets).ask(c)), _ASK)

    def second(key, table, told):
        c = _Chunk(table, window, block, buckets)
        c.candidates(told.to_pylist())
        return _rows(list(c.ask_windows(key[0].as_py())), _ASK)

    def third(key, table, told):
        c, replies = _Chunk(table, window, block, buckets), told.to_pylist()
        c.candidates(replies)
        gone = c.removed(replies)
        ids = table.column("_id").to_pylist()
        out, i = {"_id": [], "n_words": [], "n_removed": [], "spans": [], "kept_text": []}, 0
        for k, text in zip(c.order, c.texts, strict=True):
            words = text.split()
            g = gone[i : i + len(words)]
            i += len(words)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            if layout:
                kept = without(text, edge.reshape(-1, 2).tolist())
            else:
                kept = b" ".join([w for w, x in zip(words, g.tolist(), strict=True) if not x]) if len(edge) else b" ".join(words)
            for name, v in zip(out, (ids[k], len(words), int(g.sum()), [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)], kept.decode()), strict=True):
                out[name].append(v)
        kinds = {"_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "kept_text": pa.string()}
        carried = {f"_out{i}": table.column(x).take(pa.array(c.order, pa.int64())) for i, x in enumerate(from_docs.values())}
        return pa.table({n: pa.array(v, kinds[n]) for n, v in out.items()} | carried)

    asked = keyed.groupBy("chunk").applyInArrow(first, _ASK)
    told = asked.groupBy("bucket").applyInArrow(_answer, _TOLD)
    asked = keyed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(second, _ASK)
    both = told.unionByName(asked.groupBy("bucket").applyInArrow(_answer, _TOLD))
    schema = "_id long, n_words long, n_removed long, spans array<struct<start int, end int>>, kept_text string" + "".join(f", _out{i} {docs.schema[x].dataType.simpleString()}" for i, x in enumerate(carry))
    out = keyed.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(third, schema)
    return out.select(F.col("_id").cast(id_type).alias(id_col), "n_words", "n_removed", "spans", "kept_text", *[F.col(f"_out{i}").alias(x) for i, x in enumerate(carry)])

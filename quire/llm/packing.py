"""Packing token sequences by first-fit decreasing, with a tournament tree of bin capacities, in randomised groups.

A document's ids are cut at multiples of the sequence length; what is left over is one short piece. Pieces are dealt into
groups by a hash of their row and place, groups of about group_tokens ids. In a group, pieces sorted by falling length enter the first
sequence with room, found from the root of a tree that holds at each node the largest room below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, text_bytes
from quire.llm.tokens import encoder


def first_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, in the given order: the first bin with room. No size may exceed the capacity."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # room[1] is the root; node i has children 2i and 2i + 1
    out = []
    for size in sizes:
        i = 1
        while i < leaves:
            i *= 2
            if room[i] < size:
                i += 1
        out.append((i - leaves, capacity - room[i]))
        room[i] -= size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = 2_000_000) -> DataFrame:
    """Rows, one a piece: id_col, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Each document's ids, with end_id after them, are in exactly one piece each; a sequence's pieces are gapless from offset 0
    and at most `length` ids. Null or empty text: the end id alone. Null ids and repeated rows are packed like any
    other, each row once. An empty table gives an empty result. Other columns are not read.
    """
    # about 2.5 bytes a token in these vocabularies, and an end id a row; the estimate only sets the group size
    groups = max(1, -(-text_bytes(docs, text_col, 3) // int(2.5 * group_tokens)))
    id_type = dict(docs.dtypes)[id_col]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        end, wide = np.array([end_id], e.kind).tobytes(), e.kind.itemsize
        for whole in batches:
            for k, n_rows in slices(pa.compute.fill_null(pa.compute.binary_length(whole.column(1)), 0).to_pylist()):
                b = whole.slice(k, n_rows)
                rows = []
                for i, t in enumerate(b.column(1).to_pylist()):
                    data = e.ids(t or "") + end
                    n = len(data) // wide
                    rows += [(i, a, min(length, n - a), n, data[a * wide : (a + length) * wide]) for a in range(0, n, length)]
                at, start, size, n, data = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["_id", "_row", "start", "length", "doc_tokens", "ids"])

    def place(key, table):
        g = key[0].as_py()
        size, ids = table.column("length").to_pylist(), table.column("ids").to_pylist()
        name = [(x is None, x or 0) for x in table.column("_id").to_pylist()]
        start = table.column("start").to_pylist()
        order = sorted(range(len(size)), key=lambda i: (-size[i], name[i], start[i], ids[i]))
        got: list = [None] * len(size)
        for i, at in zip(order, first_fit([size[i] for i in order], length), strict=True):
            got[i] = at
        out = table.drop_columns(["group", "ids"])
        wide = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in zip(ids, size, strict=True)]
        for k, v, t in (("sequence_id", [(g << 32) + b for b, _ in got], pa.int64()), ("offset", [o for _, o in got], pa.int64()), ("ids", wide, pa.binary())):
            out = out.append_column(k, pa.array(v, t))
        return out

    # the row's number in the input deals repeated rows and null ids apart as well
    pieces = docs.select(F.col(id_col).alias("_id"), text_col, F.monotonically_increasing_id().alias("_row")).mapInArrow(encode, f"_id {id_type}, _row long, start long, length long, doc_tokens long, ids binary")
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("_row", "start"), F.lit(groups))).drop("_row")
    out = grouped.groupBy("group").applyInArrow(place, f"_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("_id", id_col)

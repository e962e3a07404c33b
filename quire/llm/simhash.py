"""SimHash near-dedup by an inverted index over byte positions, with count filtering.

A 64-bit fingerprint has 8 positional bytes. Two fingerprints that differ in at most d bits share at least 8 - d of
them, the guaranteed minimum. The index has a posting for each position and byte. A pair with at least 8 - d shared positions
has its first one among positions 0 to d, so each fingerprint enters d + 1 postings and no link is lost. In a posting the shared
positional bytes of each pair are tallied; pairs that reach the minimum are kept, then verified by their differing bits.
Equal fingerprints are one row beforehand.

A posting of more than `longest` members (a byte that is common, or many documents) is split by the next shared position:
if k positions are shared so far, the next is among the positions after them up to k + d, by the same count. A pair then meets
in the posting of its first k shared positions, whatever k is; at 8 - d positions a posting holds at most 256^d
fingerprints, so its size has a bound without any cap. Every split goes through the same tally and the same verification.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, join_by_key, only
from quire.llm.graph import connected_components

SEED = 42


def fingerprint(text: bytes, size: int = 3) -> int:
    """Bits set in over half the hashes of the text's shingles of `size` lower-cased words, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Rows (id_col, fp): fp is the fingerprint as a signed long."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for whole in batches:
            for i in range(0, len(whole), 256):
                b = whole.slice(i, 256)
                got = np.array([fingerprint(t.as_py() or b"", size) for t in b.column(1).cast(pa.binary())], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=[id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(score, f"`{id_col}` {kind}, fp bigint")


def tally(fps: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each fingerprint i of a posting with links: (i, the linked j > i), by shared positional bytes, then by differing bits."""
    n, least = len(fps), 8 - bits
    at = np.ascontiguousarray(fps.view(np.uint8).reshape(n, 8).T)
    step = max(1, (1 << 22) // n)
    for s in range(0, n, step):
        shared = np.zeros((min(step, n - s), n - s), np.uint8)
        for column in at:
            shared += column[s : s + step, None] == column[None, s:]
        q, j = np.nonzero(shared >= least)
        near = (j > q) & (np.bitwise_count(fps[s + q] ^ fps[s + j]) <= bits)
        q, j = q[near] + s, j[near] + s
        first = np.flatnonzero(np.diff(q, prepend=-1))
        yield from zip(q[first].tolist(), np.split(j, first[1:]), strict=True) if len(q) else ()


def _forest(fps: np.ndarray, reps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that join what is linked in a posting; no more than its members."""
    out, group = [], np.arange(len(fps))
    for i, linked in tally(fps, bits):
        for g, j in dict(zip(group[linked].tolist(), linked.tolist(), strict=True)).items():
            if g != group[i]:
                out.append((int(reps[i]), int(reps[j])))
                group[group == g] = group[i]
    return out


def links(classes: DataFrame, bits: int = 2, longest: int = 2048) -> DataFrame:
    """Edges (a, b) of representatives; classes: fp, rep, distinct fp. Same components as all pairs within `bits` (0 to 7) bits.

    Only edges that join what was apart in a posting leave it, not each link.
    """
    least = 8 - bits

    def deeper(rows: DataFrame, shared: int) -> DataFrame:
        """Postings by one more position after `last`, up to the highest that a pair of the minimum can need."""
        child = rows.select("fp", "rep", "places", "bytes", F.explode(F.sequence(F.col("last") + 1, F.lit(shared + bits))).alias("last"))
        return child.select("fp", "rep", "last", F.expr("places | shiftleft(1, last)").alias("places"), F.expr("bytes | (fp & shiftleft(255L, 8 * last))").alias("bytes"))

    key = ["places", "bytes"]
    posts, ready = deeper(classes.select("fp", "rep", F.lit(0).alias("places"), F.lit(0).cast("long").alias("bytes"), F.lit(-1).alias("last")), 0), []
    for shared in range(1, least + 1):
        posts = cut(posts)
        if shared == least:
            ready.append(posts)
            break
        long = cut(posts.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > longest).select(*key))  # few: a row for over `longest` rows
        if long.isEmpty():
            ready.append(posts)
            break
        ready.append(posts.join(long, key, "left_anti"))
        posts = deeper(posts.join(long, key, "left_semi"), shared)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        open_key, fps, reps = None, [], []

        def closed() -> Iterator[pa.RecordBatch]:
            found = _forest(np.concatenate(fps).view(np.uint64), np.concatenate(reps), bits) if sum(map(len, fps)) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        for b in batches:
            places, bytes_, fp, rep = (b.column(c).to_numpy() for c in ("places", "bytes", "fp", "rep"))
            new = np.flatnonzero((np.diff(places, prepend=-1) != 0) | (np.diff(bytes_, prepend=0) != 0))
            ends = [*new[new > 0].tolist(), len(fp)]
            start = 0
            for end in ends:
                if (now := (places[start], bytes_[start])) != open_key:
                    yield from closed()
                    open_key, fps, reps = now, [], []
                fps.append(fp[start:end])
                reps.append(rep[start:end])
                start = end
        yield from closed()

    dealt = reduce(DataFrame.unionByName, [r.select(*key, "fp", "rep") for r in ready])
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(join, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = 2) -> DataFrame:
    """Rows (id_col, fp, component_id), one for each row of docs; component_id: the smallest id that links reach.

    Null or empty text: fingerprint zero, linked like any other. Null id: the row has a fingerprint and its group's
    component_id, and is no representative (null where no id is in the group). Rows of equal id, ties and other columns
    change nothing. An empty table gives an empty result.
    """
    thin = cut(fingerprints(docs, id_col, text_col, size))
    classes = thin.groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("rep"), F.count("*").alias("n")).where("rep is not null")
    # two classes may have one representative where an id has several texts: its groups are one then
    found = connected_components(links(classes, bits), "a", "b")
    named = classes.join(found, classes.rep == found.node, "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    return join_by_key(thin, named, "fp", "n", thin.count()).select(id_col, "fp", "component_id")


def similar_groups(docs: DataFrame, id_col: str, text_col: str = "text", size: int = 5, bits: int = 2, similarity: float = 0.8) -> DataFrame:
    """Rows (id_col, component_id) by exact Jaccard similarity of the texts' shingles; id_col: unique longs, not null.

    Candidates are what the fingerprints of shingles of `size` words link within `bits` bits, and what MinHash bands add: at a similarity of 0.8
    fingerprints differ in about 10 bits, where no byte need be shared. Every link is verified on the texts. Cases as in near_groups().
    """
    from quire.llm import jaccard

    thin = cut(fingerprints(docs, id_col, text_col, size))
    classes = thin.groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("rep"), F.count("*").alias("n"))
    same = join_by_key(thin, classes, "fp", "n", thin.count()).where(F.col(id_col) != F.col("rep")).select(F.col("rep").alias("a"), F.col(id_col).cast("long").alias("b"))
    known = cut(same.unionByName(links(classes, bits)))
    return jaccard.near_groups(docs, id_col, text_col, size, similarity, known)

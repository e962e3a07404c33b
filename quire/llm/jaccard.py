"""Exact Jaccard similarity of word shingles: verification of near-duplicate links, and the links that 64-bit fingerprints cannot reach.

A text's set holds its shingles of `size` lower-cased words; a shorter text has one shingle. Texts whose sets have a similarity
of 0.8 differ in about 10 of 64 SimHash bits, far beyond what an index over bytes guarantees, so BANDS keys of ROWS minima each
find such pairs. A pair of similarity s shares a key with probability 1 - (1 - s^ROWS)^BANDS: all but 5 in 10^8 at 0.8, fewer
above. Every link is verified. Texts of equal words are one row beforehand.

A posting of any length is worked off in three steps that make no pairs of its members. First each text is verified against the smallest of all
heads of its postings (one pair a text). Where members of a posting then stand in different components, a task counts the equal minima
of such pairs (of BANDS * ROWS; a pair at 0.8 has fewer than AGREE with probability of about 10^-7) and names the members of pairs that
reach AGREE, each in the first posting that both share. These members' sets meet there, and only a forest of the verified links
leaves the task. Pairs inside one component could not change it, so the components are those of all candidate pairs. A posting of over
BLOCK members is worked off as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, only
from quire.llm.graph import connected_components
from quire.llm.substring_dedup import _hash, _rolling

BANDS, ROWS, AGREE, BLOCK = 32, 4, 78, 8192
_draw = np.random.default_rng(42)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]


def shingles(text: bytes, size: int = 5) -> set:
    words = text.lower().split()
    return set(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) > size else {tuple(words)} if words else set()


def similarity(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def hashed(words: list[bytes], size: int = 5) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(_rolling(np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words)), min(size, len(words))))


def minima(h: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of a set of hashed shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 1024):
        least = np.minimum(least, (h[i : i + 1024] * _TIMES + _PLUS).min(1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    return _rolling(np.concatenate([least.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)[:, None]], 1).ravel(), ROWS + 1)[:: ROWS + 1].view(np.int64)


def _keys(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows (id_col, digest, keys, signature): digest of the lower-cased words, keys of the bands, the low 8 bits of each minimum and 32 of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        only(_hash)
        for whole in batches:
            for i in range(0, len(whole), 256):
                b, rows = whole.slice(i, 256), []
                for t in b.column(1).cast(pa.binary()):
                    words = (t.as_py() or b"").lower().split()
                    least = minima(hashed(words, size)) if words else None
                    keys = np.zeros(0, np.int64) if least is None else band_keys(least)
                    mark = b"" if least is None else least.astype(np.uint8).tobytes() + keys.astype("<u4").tobytes()  # low bits; the high ones of minima are all small
                    rows.append((xxhash.xxh3_128_digest(b" ".join(words)), keys, mark))
                kinds = (pa.binary(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[id_col, "digest", "keys", "signature"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, digest binary, keys array<bigint>, signature binary")


def _close(marks: np.ndarray, band: int, apart) -> Iterator[tuple[int, np.ndarray]]:
    """(q, those j > q) of a posting with apart(q, j) that reach AGREE, each in the first band that both share."""
    n = len(marks)
    keys = np.ascontiguousarray(marks[:, BANDS * ROWS :]).view("<u4")
    step, columns = max(1, (1 << 22) // n), np.ascontiguousarray(marks[:, : BANDS * ROWS].T)
    for s in range(0, n, step):
        equal = np.zeros((min(step, n - s), n - s), np.uint8)
        for c in columns:
            equal += c[s : s + step, None] == c[None, s:]
        for q in np.flatnonzero((equal >= AGREE).any(1)) + s:
            j = np.flatnonzero(equal[q - s] >= AGREE) + s
            j = j[j > q]
            j = j[apart(q, j)]
            first = (keys[j] == keys[q]).argmax(1)
            if len(j := j[first == band]):
                yield int(q), j


_TASK = ["band", "key", "i", "j"]
_MEMBER = ["rep", "c", "own", "signature"]


class _Posting:
    """Members of one posting, or of two blocks of it, then of different blocks only."""

    def __init__(self, task: tuple, rows: list[tuple]):
        self.task, (self.rep, c, own, marks) = task, list(zip(*(r[:4] for r in rows), strict=True))
        self.marks, c, own = np.frombuffer(b"".join(marks), np.uint8).reshape(len(rows), -1), np.array(c), np.array(own)
        self.apart = lambda q, j: (c[j] != c[q]) & ((task[2] == task[3]) | (own[j] != own[q]))

    def close(self) -> Iterator[tuple[int, np.ndarray]]:
        return _close(self.marks, self.task[0], self.apart)


def _named(task: tuple, rows: list[tuple]) -> list[tuple]:
    """The members of pairs that are to be verified."""
    hit = np.zeros(len(rows), bool)
    for q, j in _Posting(task, rows).close():
        hit[q] = hit[j] = True
    return [(*task, *rows[i]) for i in np.flatnonzero(hit)]


def _linked(task: tuple, rows: list[tuple], size: int, least: float) -> list[tuple]:
    """Edges that join what is similar; rows have a text besides."""
    p, out, group = _Posting(task, rows), [], np.arange(len(rows))
    sets = [hashed((r[4] or b"").lower().split(), size) for r in rows]
    for q, j in p.close():
        j = j[group[j] != group[q]]
        if not len(j):
            continue
        n = np.array([len(sets[k]) for k in j])
        seen = np.isin(np.concatenate([sets[k] for k in j]), sets[q], assume_unique=False)
        both = np.add.reduceat(seen, np.cumsum(n) - n, dtype=np.int64)
        for k in j[both >= least * (n + len(sets[q]) - both)]:
            if group[k] != group[q]:
                out.append((p.rep[q], p.rep[k]))
                group[group == group[k]] = group[q]
    return out


def _postings(rows: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """work(task, rows) -> rows of `schema`, for each posting or pair of blocks; rows: _TASK and columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_hash)
        names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
        kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
        now, held = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            out = work(now, held) if len(held) > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                for r in zip(*(b.column(k).to_pylist() for k in [*_TASK, *columns]), strict=True):
                    if r[:4] != now:
                        yield from closed()
                        now, held = r[:4], []
                    held.append(r[4:])
        yield from closed()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*_TASK, *columns).repartition(parts, *_TASK).sortWithinPartitions(*_TASK, "rep").mapInArrow(run, schema)


def _across(apart: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """Edges (a, b) between the components c of each posting; apart: band, key, n, rep, c, signature; docs: _k, _t."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = apart.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other"))
    member = "band int, key long, i int, j int, rep long, c long, own int, signature binary"
    named = cut(_postings(dealt, _MEMBER, member, _named))
    texts = _texts(docs, named.select("rep").distinct())
    met = named.join(texts, F.col("rep") == F.col("_k")).withColumn("_t", F.encode("_t", "UTF-8"))
    return _postings(met, [*_MEMBER, "_t"], "a long, b long", lambda task, rows: _linked(task, rows, size, least))


def _texts(docs: DataFrame, wanted: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The docs (_k, _t) whose key is wanted (one column); up to `most` keys are broadcast (16 MB), more are shuffled."""
    keys = cut(wanted.toDF("_n"))
    return docs.join(F.broadcast(keys) if keys.count() <= most else keys, F.col("_k") == F.col("_n"), "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least the similarity; docs: _k, _t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        held: dict = {}
        for b in batches:
            a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            left, right = b.column(2).cast(pa.binary()), b.column(3).cast(pa.binary())
            near = []
            for i in range(len(a)):
                for k, t in ((c[i], right), (a[i], left)):
                    if k not in held:  # rows stand by b, and many have the same a
                        held = {x: held[x] for x in (a[i], c[i]) if x in held} | {k: shingles(t[i].as_py() or b"", size)}
                near.append(similarity(held[c[i]], held[a[i]]) >= least)
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    texts = _texts(docs, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct())
    both = pairs.join(texts.select(F.col("_k").alias("a"), F.col("_t").alias("_ta")), "a").join(texts.select(F.col("_k").alias("b"), F.col("_t").alias("_tb")), "b")
    return cut(both.select("a", "b", "_ta", "_tb").mapInArrow(run, "a long, b long"))


def near_groups(docs: DataFrame, id_col: str, text_col: str = "text", size: int = 5, least: float = 0.8, known: DataFrame | None = None) -> DataFrame:
    """Rows (id_col, component_id), one for each row of docs; component_id: the smallest id that links reach.

    id_col must be a unique long, not null. known: pairs (a, b) of ids that another index found; they are verified as well. Texts without words
    are equal to each other. An empty table gives an empty result.
    """
    thin = cut(_keys(docs.select(F.col(id_col).cast("long").alias("_k"), F.col(text_col).alias("_t")), "_k", "_t", size))
    docs = docs.select(F.col(id_col).cast("long").alias("_k"), F.col(text_col).alias("_t"))
    classes = cut(thin.groupBy("digest").agg(F.min("_k").alias("rep"), F.first("keys").alias("keys"), F.first("signature").alias("signature")))
    posts = classes.select("rep", F.posexplode("keys").alias("band", "key"))
    lengths = posts.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("rep").alias("head")).where("n > 1")
    shared = cut(posts.join(lengths, ["band", "key"]))
    pairs = shared.groupBy("rep").agg(F.min("head").alias("a")).where("a < rep").select("a", F.col("rep").alias("b"))
    if known is not None:
        of = thin.select("_k", "digest").join(classes.select("digest", "rep"), "digest").select("_k", "rep")
        named = known.join(of.toDF("a", "_a"), "a").join(of.toDF("b", "_b"), "b").where("_a <> _b")
        pairs = pairs.unionByName(named.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))).distinct()
    edges = _verified(cut(pairs), docs, size, least)
    found = connected_components(edges, "a", "b")
    placed = shared.join(found, F.col("rep") == found.node, "left").select("band", "key", "n", "rep", F.coalesce("component", "rep").alias("c"))
    split = placed.groupBy("band", "key").agg(F.min("c").alias("_first"), F.max("c").alias("_last")).where("_first <> _last").select("band", "key")
    apart = placed.join(split, ["band", "key"], "left_semi").join(classes.select("rep", "signature"), "rep")
    edges = cut(edges.unionByName(_across(apart, docs, size, least)))
    found = connected_components(edges, "a", "b")
    named = classes.join(found, classes.rep == found.node, "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return thin.select(F.col("_k").alias(id_col), "digest").join(named, "digest").select(id_col, "component_id")

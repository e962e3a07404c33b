"""Hard negatives by a pivot table.

Scores are inner products of whole numbers (each component times `scale`, rounded down). One more component, sqrt(M^2 - |x|^2) for
a vector x and 0 for an anchor, M being the largest length, turns them into distances: |q - x|^2 = |q|^2 + M^2 - 2 q.x. The
table holds each vector's distances to a few pivots. By the triangle inequality an anchor's distances to the pivots bracket its
distance to each vector, and so the score: first for runs of vectors that lie near each other, by the least and largest distance of a run
to each pivot, then for the vectors of the runs that are left. Scores of survivors are computed exactly.

Anchors meet the vectors in blocks: a task holds `block` anchors and one chunk of about `chunk` vectors, whatever their labels, so no
label is one task. Each task gives its few best rows for an anchor, and these are ranked once more over all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut

PIVOTS, RUN, SAMPLE = 16, 64, 1024
#: Scaled components beyond this could give scores of more than 64 bits.
MOST = 1 << 27


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to n rows of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, away = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def lift(x: np.ndarray, square: float) -> np.ndarray:
    """x with the component that makes every length the square root of `square`."""
    return np.column_stack([x, np.sqrt(np.maximum(square - (x * x).sum(1), 0))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


class Chunk:
    """Vectors of one task with their pivot distances, by label and there in runs of near vectors."""

    def __init__(self, x: np.ndarray, to_pivots: np.ndarray, square: float, labels: np.ndarray):
        self.square = square
        nearest = to_pivots.argmin(1)
        self.order = np.lexsort((to_pivots[np.arange(len(x)), nearest], nearest, labels))
        self.labels = labels[self.order]
        self.x, self.to = x[self.order], to_pivots[self.order]
        first = np.arange(0, len(x), RUN)
        self.low, self.high = np.minimum.reduceat(self.to, first), np.maximum.reduceat(self.to, first)
        # products and sums of whole numbers are exact in doubles up to 2^53
        self.exact = float if len(x) and float((np.abs(x).max() ** 2) * x.shape[1]) < 2.0**53 else np.int64

    def bracket(self, q: np.ndarray, to: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of vectors whose distance to each pivot is near..far, with room for rounding."""
        least = np.maximum(np.maximum(near - to, to - far), 0).max(1)
        most = (far + to).min(1)
        base = (q * q).sum() + self.square
        room = 1e-9 * base + 1e-6
        return (base - most**2) / 2 - room, (base - least**2) / 2 + room

    def survivors(self, q: np.ndarray, to: np.ndarray, least: float, most: float) -> np.ndarray:
        """Rows (in run order) whose score may be least..most."""
        low, high = self.bracket(q, to, self.low, self.high)
        runs = np.flatnonzero((high >= least) & (low <= most))
        rows = (runs[:, None] * RUN + np.arange(RUN)).ravel()
        rows = rows[rows < len(self.x)]
        low, high = self.bracket(q, to, self.to[rows], self.to[rows])
        return rows[(high >= least) & (low <= most)]

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        kind = self.exact if float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * len(q) < 2.0**53 else np.int64
        return (self.x[rows].astype(kind) @ q.astype(kind)).astype(np.int64)

    def top(self, q: np.ndarray, to: np.ndarray, label: int, ids: np.ndarray, k: int, without: int) -> list[tuple[int, int]]:
        """(score, row) of the k best rows of the label but one: runs by falling upper bound, until the next bound is below the k-th score."""
        start, stop = np.searchsorted(self.labels, [label, label + 1])
        runs = np.arange(start // RUN, -(-stop // RUN)) if stop > start else np.zeros(0, np.int64)
        _, high = self.bracket(q, to, self.low[runs], self.high[runs])
        best: list[tuple[int, int, int]] = []
        bar = -np.inf
        by = np.argsort(-high, kind="stable")
        for at in range(0, len(by), 8):
            some = by[at : at + 8]
            some = runs[some[high[some] >= bar]]
            if not len(some):
                break
            rows = (some[:, None] * RUN + np.arange(RUN)).ravel()
            rows = rows[(rows >= start) & (rows < stop) & (rows != without)]
            rows = rows[self.bracket(q, to, self.to[rows], self.to[rows])[1] >= bar]
            got = self.scores(q, rows)
            best = sorted([*best, *zip((-got).tolist(), ids[rows].tolist(), rows.tolist(), strict=True)])[:k]
            bar = -best[-1][0] if len(best) == k else bar
        return [(-s, r) for s, _, r in best]


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1).astype(np.float64 if kind == "<f8" else np.int64)


def mine(vectors: DataFrame, anchors: Column, low: int = 80, positives: int = 5, negatives: int = 5, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = 4096, chunk: int = 32_768) -> DataFrame:
    """Rows (anchor_id, positive_id, rank int, negative_id, positive_score, negative_score) for the rows where `anchors` holds.

    An anchor's positives are its best `positives` other rows of its label; each one's negatives are the best `negatives` rows of other labels
    with low * positive_score <= 100 * score <= 100 * positive_score. Higher scores come first, ties by smaller id, null ids last. Rows with a null label or
    vector, an empty vector or a null or non-finite component take no part, nor do those with a component beyond +-2^27 after scaling, as
    scores are 64-bit numbers. Vectors of different lengths are not compared. Each row is a vector of its own, also where ids
    repeat. An empty table gives an empty result.
    """
    e = F.col("_v")
    scaled = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fit = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(F.lit(float(scale)) * x.cast("double")) > MOST))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_v"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where(e.isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & F.coalesce(fit, F.lit(False)))
    rows = cut(rows.select("id", "label", "anchor", scaled.alias("x"), F.monotonically_increasing_id().alias("row")))  # row numbers are fixed here
    square = F.aggregate("x", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    shapes = {r["dim"]: (r["n"], r["m"]) for r in rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("m")).collect()}
    out = None
    for dim, (n, largest) in sorted(shapes.items()):
        got = _mine(rows.where(F.size("x") == dim), n, largest, low, positives, negatives, block, chunk)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _mine(rows: DataFrame, n: int, largest: float, low: int, positives: int, negatives: int, block: int, chunk: int) -> DataFrame:
    """mine() for vectors of one length."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("x").toArrow()  # a bounded sample; it decides what is pruned, not what is found
    pivots = choose_pivots(lift(np.array(sample.column("x").to_pylist(), np.float64), largest))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(len(b), -1)
            as_rows = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            far = distances(lift(x.astype(np.float64), largest), pivots)
            asks = distances(np.column_stack([x, np.zeros(len(x))]).astype(np.float64), pivots)  # as an anchor
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "label", "anchor")), as_rows(x.astype("<i4")), as_rows(far.astype("<f8")), as_rows(asks.astype("<f8"))], names=["row", "id", "label", "anchor", "x", "far", "asks"])

    chunks = max(1, -(-n // chunk))
    placed = rows.mapInArrow(place, "row long, id long, label string, anchor boolean, x binary, far binary, asks binary")
    table = cut(placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")))
    asking = table.where("anchor").select("row", "label", "x", F.col("asks").alias("far"))
    blocks = max(1, -(-asking.count() // block))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    # names of their own: a cogroup of two branches of one table loses columns that both sides carry
    points = table.select("chunk", every, *[F.col(c).alias(f"p_{c}") for c in ("row", "id", "label", "x", "far")])

    def meet(anchors: DataFrame, work, schema: str) -> DataFrame:
        """work(anchors, points) for each block of anchors and chunk of vectors."""
        at = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
        asked = anchors.select("*", at)
        return asked.groupBy("block", "chunk").cogroup(points.groupBy("block", "chunk")).applyInArrow(work, schema)

    def opened(a: pa.Table, p: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Chunk, np.ndarray, np.ndarray]:
        """Anchors' vectors, pivot distances and label numbers; the chunk; its ids (null last) and rows in run order."""
        labels = pa.chunked_array([*a.column("label").chunks, *p.column("p_label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        c = Chunk(_matrix(p.column("p_x"), "<i4"), _matrix(p.column("p_far"), "<f8"), largest, labels[len(a) :])
        ids = p.column("p_id").to_pylist()
        if None in ids:
            rank = np.empty(len(ids), np.int64)
            rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
        else:
            rank = np.array(ids, np.int64)
        return _matrix(a.column("x"), "<i4"), _matrix(a.column("far"), "<f8"), labels[: len(a)], c, rank[c.order], np.array(p.column("p_row").to_pylist(), np.int64)[c.order]

    found = pa.schema([("row", pa.int64()), ("wanted", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def result(out: list[tuple], p: pa.Table, c: Chunk) -> pa.Table:
        ids = p.column("p_id").to_pylist()
        columns = zip(*((r, w, ids[c.order[i]], s) for r, w, i, s in out), strict=True) if out else ([],) * 4
        return pa.table([pa.array(v, pa.int64()) for v in columns], schema=found)

    def alike(a: pa.Table, p: pa.Table) -> pa.Table:
        if not len(a) or not len(p):
            return found.empty_table()
        q, to, own, c, ids, numbers = opened(a, p)
        out, places = [], {n: i for i, n in enumerate(numbers.tolist())}
        for i, row in enumerate(a.column("row").to_pylist()):
            out += [(row, None, r, s) for s, r in c.top(q[i], to[i], own[i], ids, positives, places.get(row, -1))]
        return result(out, p, c)

    def unlike(a: pa.Table, p: pa.Table) -> pa.Table:
        if not len(a) or not len(p):
            return found.empty_table()
        q, to, own, c, ids, _ = opened(a, p)
        out = []
        for i, (row, wanted) in enumerate(zip(a.column("row").to_pylist(), a.column("wanted").to_pylist(), strict=True)):
            least = min(-(-low * w // 100) for w in wanted)
            rows = c.survivors(q[i], to[i], least, max(wanted))
            rows = rows[c.labels[rows] != own[i]]
            score = c.scores(q[i], rows)
            order = np.lexsort((ids[rows], -score))
            rows, score = rows[order], score[order]
            for w in wanted:
                fit = np.flatnonzero((score <= w) & (100 * score >= low * w))[:negatives]
                out += [(row, w, r, s) for r, s in zip(rows[fit].tolist(), score[fit].tolist(), strict=True)]
        return result(out, p, c)

    schema = "row long, wanted long, id long, score long"
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    first = meet(asking, alike, schema).withColumn("nth", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("nth") <= positives)
    first = cut(first.select("row", F.col("id").alias("positive_id"), F.col("score").alias("wanted")))
    # a positive below zero has no scores between low hundredths of it and itself
    wants = first.where(F.col("wanted") * low <= F.col("wanted") * 100).groupBy("row").agg(F.collect_set("wanted").alias("wanted"))
    second = meet(asking.join(wants, "row"), unlike, schema).withColumn("rank", F.row_number().over(Window.partitionBy("row", "wanted").orderBy(*order))).where(F.col("rank") <= negatives)
    names = table.where("anchor").select("row", F.col("id").alias("anchor_id"))
    joined = first.join(second.select("row", "wanted", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "wanted"]).join(names, "row")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("wanted").alias("positive_score"), "negative_score")

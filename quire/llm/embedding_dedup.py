"""Embedding near-dedup by collision-counting projections (C2LSH, Gan et al., 2012; query-aware windows, Huang et al., 2015).

A unit vector has PROJECTIONS random one-dimensional projections, each sorted. For a query vector a window of half-width w lies
round its own value in each sorted list; the collisions of each other vector over all lists are counted, and pairs with at least
the calibrated count are verified by their cosine. w and the count are set from the threshold: a pair right at the threshold
passes with probability of at least 1 - 5e-4, a closer one more often.

One window alone holds a fixed share of all vectors, so the counting runs inside cells: a label's vectors are cut by a
grid over a few further projections, in as many independent grids as a pair at the threshold needs to share a cell of one of them
with probability 0.999. The number of grid axes grows with the logarithm of the label's vectors, which keeps cells near
`cell` vectors. A pair in several common cells counts in the first one only. Cells larger than
`block` (close copies) are worked off as blocks of queries against blocks of vectors, each a task of bounded size; only
counts and a spanning forest leave a task, never pairs. Equal vectors are one row beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, join_by_key
from quire.llm.graph import connected_components

PROJECTIONS, GRID, MOST_AXES = 32, 1.5, 24
QUERIES = 64  # counted together
LOSS_COUNT, LOSS_GRID = 5e-4, 1e-3


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def calibrate(cosine: float) -> tuple[float, int]:
    """(half-width, least count) for a pair at the threshold; projections of a difference d are normal with deviation |d|."""
    d = math.sqrt(2 - 2 * cosine)
    p = 2 * _normal(2) - 1
    tail, least = 1.0, 0
    while least < PROJECTIONS:
        tail -= math.comb(PROJECTIONS, least) * p**least * (1 - p) ** (PROJECTIONS - least)
        if tail < 1 - LOSS_COUNT:
            break
        least += 1
    return 2 * d, least


def grid_hit(cosine: float) -> float:
    """Chance that a pair at the threshold falls in one grid interval along one axis."""
    s = GRID / math.sqrt(2 - 2 * cosine)
    return 2 * _normal(s) - 1 - 2 / (math.sqrt(2 * math.pi) * s) * (1 - math.exp(-s * s / 2))


def grids(n: int, cell: int, cosine: float) -> tuple[int, int]:
    """(axes, grids) for n vectors of a label: unrelated vectors share an interval with chance of about 0.39."""
    axes = min(MOST_AXES, max(0, math.ceil(math.log(n / cell) / 0.95))) if n > cell else 0
    if axes == 0:
        return 0, 1
    return axes, math.ceil(math.log(LOSS_GRID) / math.log(1 - grid_hit(cosine) ** axes))


def _lines(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _cells(unit: np.ndarray, axes: int, tables: int) -> np.ndarray:
    """The cell of each vector in each grid, as 64-bit hashes."""
    if axes == 0:
        return np.zeros((len(unit), 1), np.int64)
    r = np.random.default_rng([11, unit.shape[1]])
    at = unit @ r.standard_normal((unit.shape[1], tables * axes)) + r.random(tables * axes) * GRID
    at = np.floor(at / GRID).astype(np.int64).reshape(len(unit), tables, axes)
    h = np.zeros(at.shape[:2], np.uint64)
    for i in range(axes):
        h = (h ^ at[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _work(t: pa.Table, cosine: float, width: float, least: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links counted for the queries of one task, and a forest that joins what they link."""
    unit, cells = _unit(t.column("embedding")), np.array(t.column("cells").to_pylist(), np.int64)
    rep, n = np.array(t.column("rep").to_pylist()), np.array(t.column("n").to_pylist())
    table = t.column("table")[0].as_py()
    query, point = np.array(t.column("query").to_pylist(), bool), np.array(t.column("point").to_pylist(), bool)
    points, asks = np.flatnonzero(point), np.flatnonzero(query)
    value = (unit @ _lines(unit.shape[1], PROJECTIONS, 5)).T
    # a window of a sorted list is a run of ranks; ranks and bounds are small numbers, so a list is counted for many queries at once
    kind = np.uint16 if len(points) < 1 << 16 else np.uint32
    rank, low, size = np.empty((PROJECTIONS, len(points)), kind), np.empty((PROJECTIONS, len(asks)), kind), np.empty((PROJECTIONS, len(asks)), kind)
    for p, v in enumerate(value):
        order = np.argsort(v[points], kind="stable")
        ranked = v[points][order]
        rank[p, order] = np.arange(len(points), dtype=kind)
        low[p] = start = np.searchsorted(ranked, v[asks] - width, "left")
        size[p] = np.searchsorted(ranked, v[asks] + width, "right") - start
    links: dict[int, int] = {}
    forest, group = [], np.arange(len(rep))
    for s in range(0, len(asks), QUERIES):
        count = np.zeros((len(asks[s : s + QUERIES]), len(points)), np.uint8)
        for p in range(PROJECTIONS):
            count += rank[p] - low[p, s : s + QUERIES, None] < size[p, s : s + QUERIES, None]
        at, hit = np.nonzero(count >= least)
        for q, hits in zip(asks[s : s + QUERIES], np.split(hit, np.searchsorted(at, np.arange(1, len(count)))), strict=True):
            found = points[hits]
            found = found[found != q]
            found = found[unit[found] @ unit[q] >= cosine] if len(found) else found
            if table and len(found):
                found = found[~(cells[found, :table] == cells[q, :table]).any(1)]
            if len(found):
                links[int(rep[q])] = links.get(int(rep[q]), 0) + int(n[found].sum())
                others = found[group[found] != group[q]]
                for g, j in dict(zip(group[others].tolist(), others.tolist(), strict=True)).items():
                    if g != group[q]:
                        forest.append((int(rep[q]), int(rep[j])))
                        group[group == g] = group[q]
    return links, forest


def near_groups(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = 2048, block: int = 4096) -> DataFrame:
    """Rows (id_col, n_links long, component_id, kept), one a row of vectors.

    Vectors are compared when their labels are equal and not null, and their lengths are equal. Null or zero vectors, null ids and vectors with
    a null or non-finite entry link with nothing (n_links 0, component_id = id). Equal vectors are linked to each other; rows of equal id count as
    two vectors. kept: the id is its component's smallest (false for a null id). An empty table gives an empty result.
    """
    e = F.col("embedding")
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    sound = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    valid = rows.where(F.col("_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & sound).where(square > 0)
    # equal vectors: by label, length and 96 bits of hash (minus zero counts as zero)
    same = F.transform(e, lambda x: x + F.lit(0).cast("float"))
    valid = valid.select("_id", "label", "embedding", F.size(e).alias("dim"), F.xxhash64(same).alias("h1"), F.hash(same).alias("h2"))
    group = ["label", "dim", "h1", "h2"]
    # a class of equal vectors has a number of its own, as one id may stand for several vectors
    classes = valid.groupBy(*group).agg(F.min("_id").cast("long").alias("id"), F.count("*").alias("n"), F.min_by("embedding", "_id").alias("embedding"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("total"))
    width, least = calibrate(cosine)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, totals = b.column("dim").to_pylist(), b.column("total").to_pylist()
            shapes = [(d, *grids(t, cell, cosine)) for d, t in zip(dims, totals, strict=True)]
            cells: list = [None] * len(b)
            for key in set(shapes):
                at = [i for i, s in enumerate(shapes) if s == key]
                got = _cells(_unit(b.column("embedding").take(pa.array(at))), key[1], key[2])
                for i, c in zip(at, got.tolist(), strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("label", "dim", "rep", "n", "embedding")), pa.array(cells, pa.list_(pa.int64()))], names=["label", "dim", "rep", "n", "embedding", "cells"])

    kinds = dict(classes.dtypes)
    head = f"label string, dim int, rep long, n long, embedding {kinds['embedding']}, cells array<long>"
    named = classes.join(sizes, ["label", "dim"])
    placed = named.select("label", "dim", "rep", "n", "embedding", "total").mapInArrow(spread, head)
    dealt = placed.select("*", F.posexplode("cells").alias("table", "cell"))
    place = ["label", "dim", "table", "cell"]
    counts = dealt.groupBy(*place).agg(F.count("*").alias("_in")).where("_in > 1")
    dealt = dealt.join(counts, place).withColumn("_blocks", F.ceil(F.col("_in") / block).cast("int"))
    own = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    # task (i, j): queries of block i against vectors of block j; a vector enters each task of its row and column
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    dealt = dealt.withColumn("_own", own).select("*", other)
    ij = lambda i, j, q, p: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(q).alias("query"), F.lit(p).alias("point"))
    roles = F.when(F.col("_own") == F.col("_other"), F.array(ij("_own", "_own", True, True))).otherwise(F.array(ij("_own", "_other", True, False), ij("_other", "_own", False, True)))
    tasks = dealt.withColumn("_role", F.explode(roles)).select(*place, "_role.*", "rep", "n", "embedding", "cells")

    def work(table):
        links, forest = _work(table, cosine, width, least)
        a = [(q, None, k) for q, k in links.items()] + [(x, y, 0) for x, y in forest]
        cols = list(zip(*a, strict=True)) or [(), (), ()]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("a", "b", "links"), cols, strict=True)})

    found = cut(tasks.groupBy(*place, "i", "j").applyInArrow(work, "a long, b long, links long"))
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    parts = connected_components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "rep")
    thin = classes.select(*group, "rep", "id", "n").join(links, "rep", "left").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    tops = thin.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("_copies"))
    thin = join_by_key(thin, tops, "component", "_copies", classes.count(), deal=F.xxhash64("rep"))
    thin = thin.select(*group, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = valid.select("_id", *group).join(thin, group).select("_id", "n_links", "component_id")
    bad = F.col("_id").isNull() | F.col("label").isNull() | e.isNull() | ~F.coalesce(sound, F.lit(False)) | ~F.coalesce(square > 0, F.lit(False))
    alone = rows.where(bad).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").cast("long").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("_id").alias(id_col), F.col("n_links").cast("long"), "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))

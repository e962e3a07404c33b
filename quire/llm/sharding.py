"""Sharding by best-fit decreasing.

Rows that must stay together (equal texts) are one group. Groups sorted by falling size enter the shard whose remaining
capacity is tightest, found in a balanced search tree. Any number of groups is packed with bounded work in one
place: a group larger than 1/(16 * `grain`) of a shard's capacity is an item of its own (there can be no more than
16 * grain * shards of them), and the smaller ones are summed into shards * grain bundles by their hash. Items and bundles, not
rows, reach the driver; a bundle is a fraction 1/grain of a shard, which bounds the difference between shards. With very
many shards the grain is less, so that the bundles stay at `most_bundles`.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, join_by_key


class _Tree:
    """B-tree of (remaining, bin) of two levels: leaves of 1 to 512 sorted items under one root, split in half when full.

    All leaves have the same depth; a search costs two bisections, a change moves at most one leaf and, at a split, the root's list.
    """

    def __init__(self, items: list[tuple[int, int]]):
        items = sorted(items)
        self.runs = [items[i : i + 256] for i in range(0, len(items), 256)]

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin of least remaining capacity >= size."""
        i = bisect_left(self.runs, (size, -1), key=lambda r: r[-1])
        if i == len(self.runs):
            return None
        return self._take(i, bisect_left(self.runs[i], (size, -1)))

    def widest(self) -> tuple[int, int]:
        return self._take(len(self.runs) - 1, len(self.runs[-1]) - 1)

    def _take(self, i: int, j: int) -> tuple[int, int]:
        got = self.runs[i].pop(j)
        if not self.runs[i]:
            self.runs.pop(i)
        return got

    def add(self, item: tuple[int, int]) -> None:
        if not self.runs:
            self.runs.append([item])
            return
        i = min(bisect_left(self.runs, item, key=lambda r: r[-1]), len(self.runs) - 1)
        insort(self.runs[i], item)
        if len(self.runs[i]) > 512:
            self.runs[i : i + 1] = [self.runs[i][:256], self.runs[i][256:]]


def best_fit_decreasing(sizes: list[int], capacity: int, n_bins: int | None = None) -> list[int]:
    """Bin of each item. Without n_bins: as few bins of the capacity as best fit opens (a larger item has its own).

    With n_bins: just these bins; an item that fits in none enters the one with most room left.
    """
    tree, opened, out = _Tree([(capacity, b) for b in range(n_bins or 0)]), n_bins or 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = tree.tightest(sizes[i])
        if got is None and n_bins:
            got = tree.widest()
        if got is None:
            got = (capacity, opened)
            opened += 1
        out[i] = got[1]
        tree.add((got[0] - sizes[i], got[1]))
    return out


MOST_BROADCAST = 200_000  # rows, about 20 MB


def shards(docs: DataFrame, n_shards: int | None = 16, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", grain: int = 128, cell_rows: int = 100_000, most_bundles: int = 1 << 20) -> DataFrame:
    """Rows (id_col, size, text_crc32, shard, slot): size = UTF-8 bytes + 1; equal texts share a shard.

    Give n_shards for shards of near equal bytes, or n_shards=None and a capacity for as few shards of that capacity as
    best fit needs. slot: gapless from 0 in each shard. Null text: size 1, crc32 of no bytes, one group with empty
    text. Null ids and repeated rows are placed like any other. A group larger than a fair share fills its shard beyond
    the others: it may not be split. An empty table gives an empty result. Other columns are not read.

    The rows of an item are numbered in cells of about cell_rows, dealt by row, so a group of many copies is no single task.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    rows = cut(rows)
    total, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    if not total:
        return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    expected = n_shards or -(-total // capacity)
    room = capacity or -(-total // n_shards)
    grain = max(1, min(grain, most_bundles // expected))
    bundles, large = expected * grain, max(1, room // (16 * grain))
    group = ["_hash", "text_crc32", "size"]
    groups = rows.groupBy(*group).agg(F.sum("size").alias("bytes"), F.count("*").alias("_copies"))
    name = F.concat(F.lit("g"), F.hex("_hash"), F.lit("_"), F.hex("text_crc32"), F.lit("_"), F.col("size").cast("string"))
    big = groups.where(F.col("bytes") >= large).select(name.alias("_name"), "_copies", F.lit(True).alias("_large"))
    pooled = F.concat(F.lit("b"), F.pmod("_hash", F.lit(bundles)).cast("string"))
    named = _meet(rows.withColumn("_name", name), big, "_name", "_copies", 16 * grain * expected, n_rows)
    keyed = named.withColumn("_item", F.when(F.col("_large"), F.col("_name")).otherwise(pooled)).drop("_name", "_large")
    items = sorted(keyed.groupBy("_item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
    shard_of = best_fit_decreasing([r["bytes"] for r in items], room, n_shards)
    placed = [(r["_item"], s, -(-r["n"] // cell_rows), r["n"]) for r, s in zip(items, shard_of, strict=True)]
    table = spark.createDataFrame(placed, "_item string, shard int, _cells long, _copies long")
    keyed = _meet(keyed, table, "_item", "_copies", len(placed), n_rows).withColumn("_cell", F.pmod(F.xxhash64("_row"), F.col("_cells")))
    cell = ["shard", "_item", "_cell"]
    before = Window.partitionBy("shard").orderBy("_item", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = keyed.groupBy(*cell).agg(F.count("*").alias("_n"))
    cells = cells.select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    cells = F.broadcast(cells) if len(placed) + n_rows // cell_rows <= MOST_BROADCAST else cells  # a cell has a bounded number of rows
    inside = Window.partitionBy(*cell).orderBy(F.col("_id").asc_nulls_first(), *group, "_row")
    numbered = keyed.withColumn("_k", F.row_number().over(inside) - 1).join(cells, cell)
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_base") + F.col("_k")).cast("long").alias("slot"))


def _meet(left: DataFrame, right: DataFrame, key: str, copies: str, most: int, rows: int) -> DataFrame:
    """left join with a table of one row a key, of `most` rows at most: broadcast if these are no more than MOST_BROADCAST, else by key, a frequent key's rows in many tasks."""
    if most <= MOST_BROADCAST:
        return left.join(F.broadcast(right.drop(copies)), key, "left")
    return join_by_key(left, right, key, copies, rows, deal=F.xxhash64("_row"))

"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Inside a source, documents stand in a shuffled order (by a seeded hash). A document's virtual finish time is the source's
words up to it, divided by the source's target; repeats are further passes over the same order. All passes are range-sorted by
(finish time, source) and the sequence is cut before the first document that exceeds the total budget. A document's own words
count by half in its finish time, so that a source ends at most about half a document above or below its target, not a whole one below.

Neither a source nor the mix is ever ordered in one task. A source has cells of about `cell_rows` documents by its shuffle
hash; running sums go over cells first, then inside a cell. The sequence lies in ranges of about `range_rows` passes; the cut is found
by the ranges' sums (one row a range), then inside the one range that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE, SPACE_CHARS, cut

SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ runs; null: 0."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(text.isNull() | (bare == ""), 0).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def targets(sources: DataFrame, weight: Column, most: float = 3.0) -> DataFrame:
    """sources (source, source_size) plus target: all sizes shared by weight, none above most * source_size.

    What a capped source cannot take goes to the others by weight, again and again; the fixed point is one level L with
    target = min(most * size, L * weight). It comes from running sums over sources sorted by size / weight: one row a source.
    """
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    s = sources.withColumn("_w", weight.cast("long")).withColumn("_cap", (F.lit(most) * F.col("source_size")).cast("double"))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_rest", F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = (F.sum("source_size").over(everything) - F.col("_capped")) / F.col("_rest")
    s = s.withColumn("_level", level).withColumn("_open", F.col("_level") <= F.col("_ratio"))
    s = s.withColumn("_level", F.max(F.when(F.col("_open"), F.col("_level"))).over(everything))
    target = F.when(F.col("_ratio") <= F.col("_level"), F.col("_cap")).otherwise(F.col("_level") * F.col("_w"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, cell_rows: int = 5_000, range_rows: int = 1_000_000, row_col: str | None = None) -> DataFrame:
    """Rows (id_col, source, size, source_size, target, taken, finish), one a document; taken = words the mix takes, repeats counted.
    finish: virtual time of its first pass (null without words); pass p follows p * source_size / target later.

    Weights are 1, 2, 3, repeating, over sources by code point, null last. A document is taken 0 to `most` times. Null or empty text: size
    0, taken 0. Rows of equal id and text are ordered by the same hash; which of them is taken first makes no difference to the
    result. Null ids are mixed like any other. An empty table gives an empty result. row_col: a column
    that tells rows apart where ids do not; it follows in the result. Other columns are not read.
    """
    own = [F.col(row_col).alias("_own")] if row_col else []
    # null ids are told apart by their texts, so that many of them lie in many cells
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\u0001"), F.col(text_col)), F.lit(""))
    key = F.md5(F.concat(F.lit(SEED), name)).alias("_key")
    rows = cut(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key, *own))
    counts = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    weighed = counts.withColumn("_rank", rank).withColumn("_weight", (F.col("_rank") - 1) % 3 + 1)
    goal = targets(weighed, F.col("_weight"), float(most)).withColumnRenamed("source", "_s").withColumnRenamed("source_size", "_size")
    stats = weighed.join(goal, weighed.source.eqNullSafe(F.col("_s"))).select("source", "source_size", "target", "_rank", F.ceil(F.col("_rows") / cell_rows).alias("_cells"))
    stats = cut(stats)  # one row a source
    name = stats.select(F.col("source").alias("_s"), "source_size", "target", "_rank", "_cells")
    u = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    dealt = rows.join(name, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_cell", F.floor(u * F.col("_cells")))
    cells = dealt.groupBy("source", "_cell").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("_s"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_cell").orderBy("_key", F.col("_id").asc_nulls_first(), "size", *(["_own"] if row_col else [])).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumn("_run", F.sum("size").over(inside)).join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    own = ["_own"] if row_col else []
    run = cut(run.select(*own, "_id", "source", "size", "source_size", "target", "_rank", (F.col("_base") + F.col("_run") - F.col("size") / 2).alias("_end")))
    live = (F.col("size") > 0) & (F.col("target") > 0)
    finish = [(p * F.col("source_size") + F.col("_end")) / F.col("target") for p in range(most)]
    passes = run.where(live).select("size", "_rank", F.explode(F.array(*finish)).alias("_finish"))
    budget, n = run.agg(F.sum("size"), F.count("*")).first()
    last = _last_whole(passes, budget or 0, max(1, -(-n * most // range_rows)))
    # taken: all passes up to the last that the budget holds whole; (finish, source) is never the same for two of them
    before = [F.lit(False) if last is None else (f < last[0]) | ((f == last[0]) & (F.col("_rank") <= last[1])) for f in finish]
    taken = F.when(live, sum((b.cast("int") for b in before), F.lit(0)) * F.col("size")).otherwise(0).cast("long")
    return run.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), F.when(live, finish[0]).alias("finish"), *([F.col("_own").alias(row_col)] if row_col else []))


def _last_whole(passes: DataFrame, budget: int, ranges: int) -> tuple[float, int] | None:
    """(finish, source rank) of the last pass that ends within the budget when all stand in order; None: not even the first."""
    ranges = max(ranges, int(passes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(passes.repartitionByRange(ranges, "_finish", "_rank").withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum("size").alias("_sum"))  # one row a range
    sums = sums.withColumn("_to", F.sum("_sum").over(Window.orderBy("_range")))
    edge = sums.where(F.col("_to") > budget).agg(F.min("_range")).first()[0]
    if edge is None:
        return dealt.agg(F.max(F.struct("_finish", "_rank"))).first()[0]
    used = sums.where(F.col("_range") < edge).agg(F.max("_to")).first()[0] or 0
    inside = dealt.where(F.col("_range") == edge).withColumn("_to", F.sum("size").over(Window.partitionBy("_range").orderBy("_finish", "_rank")) + used)
    got = inside.where(F.col("_to") <= budget).agg(F.max(F.struct("_finish", "_rank"))).first()[0]
    return got or (dealt.where(F.col("_range") < edge).agg(F.max(F.struct("_finish", "_rank"))).first()[0] if edge else None)

"""Picking blocks by clicks: a click toggles a block, a click with shift picks the range from the click before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 32


def range_pick(anchor: Column, target: Column) -> Column:
    """The places of one range, both ends included, in either direction."""
    return F.sequence(F.least(anchor, target), F.greatest(anchor, target))


def acts(clicks: DataFrame, key: str = "session", order: str = "n") -> DataFrame:
    """(key, order, at, low, high): a range where shift is held and a click came before, which is its other end; else a toggle (low and high null)."""
    before = F.lag("at").over(Window.partitionBy(key).orderBy(order))
    other = F.when(F.coalesce("shift", F.lit(False)), before)
    return clicks.withColumn("_other", other).select(key, order, "at", F.when(F.col("_other").isNotNull(), F.least("_other", "at")).alias("low"), F.when(F.col("_other").isNotNull(), F.greatest("_other", "at")).alias("high"))


def covered(ranges: DataFrame, key: str = "session") -> DataFrame:
    """(key, start, stop) of the places in one range or more, as runs without overlap: +1 where a range starts, -1 past its end, summed in order."""
    ends = ranges.select(key, F.inline(F.array(F.struct(F.col("low").alias("start"), F.lit(1).alias("_d")), F.struct((F.col("high") + 1).alias("start"), F.lit(-1).alias("_d")))))
    steps = ends.groupBy(key, "start").agg(F.sum("_d").alias("_d"))
    line = Window.partitionBy(key).orderBy("start")
    runs = steps.withColumn("_open", F.sum("_d").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("stop", F.lead("start").over(line))
    return runs.where("_open > 0").select(key, "start", "stop")


def last_cover(points: DataFrame, ranges: DataFrame, key: str = "session", order: str = "n") -> DataFrame:
    """points (key, at) plus the order of the last range that covers each, else null; places are from 0 to 2^32.

    A range is cut into at most two aligned pieces of each power of two, and a point lies in one aligned piece of each: so ranges and
    points meet by equality, with the last range of each piece, and no range meets every point.
    """
    size = F.expr("shiftleft(1L, _k)")
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("_k")
    first, past = F.ceil(F.col("low") / size).cast("long"), F.floor((F.col("high") + 1) / size).cast("long")
    pieces = ranges.select(key, order, "low", "high", level).select(key, order, "_k", first.alias("_f"), past.alias("_p")).where("_f < _p")
    odd = [F.when(F.col("_f") % 2 == 1, F.col("_f")), F.when(F.col("_p") % 2 == 1, F.col("_p") - 1)]
    pieces = pieces.select(key, order, "_k", F.explode(F.array(*odd)).alias("_piece")).where("_piece is not null")
    last = pieces.groupBy(key, "_k", "_piece").agg(F.max(order).alias("_last"))
    asked = points.select(key, "at").distinct().select("*", level).withColumn("_piece", F.floor(F.col("at") / size).cast("long"))
    found = asked.join(last, [key, "_k", "_piece"]).groupBy(key, "at").agg(F.max("_last").alias("last"))
    return points.join(found, [key, "at"], "left")


def picked(clicks: DataFrame, key: str = "session", order: str = "n") -> DataFrame:
    """(key, at) of the blocks that are picked after all clicks (key, order, at, shift) of each key.

    A range picks what it covers, whatever was picked before; so of a block's toggles only those after its last range count, and an odd number
    of them turns it over. Order is unique in a key; at is 0 or more. Clicks without a place do nothing, but the next one has no anchor.
    """
    a = acts(clicks, key, order)
    ranges, toggles = a.where("low is not null"), a.where("low is null and at is not null").select(key, order, "at")
    live = last_cover(toggles, ranges, key, order).where(F.col("last").isNull() | (F.col(order) > F.col("last")))
    turned = live.groupBy(key, "at").agg((F.count("*") % 2 == 1).alias("_turned")).where("_turned")
    base = covered(ranges, key).select(key, F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("at"), F.lit(True).alias("_base"))
    both = base.join(turned, [key, "at"], "full")
    return both.where(F.col("_base").isNull() | F.col("_turned").isNull()).select(key, "at")

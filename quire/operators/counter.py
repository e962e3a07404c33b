"""Counters that outlive the rows they count: an append-only log of additions, folded into snapshots from time to time.

Folder layout: log/seq=<n>/ has the additions (name, n) of one append, snapshots/upto=<n>/ the totals (name, count) of all appends to n.
A count is the last snapshot plus the log after it. Appends have ascending numbers, as batches of a stream have, from one writer. Everything may be repeated:
an append under a number that is there, or that a snapshot holds, changes nothing, nor does a second compaction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.storage import committed, drop_folder, numbered

_LOG, _SNAPSHOT = "name string, n long", "name string, count long"


def _upto(folder: str) -> int:
    return max(numbered(f"{folder}/snapshots", "upto"), default=-1)


def append(rows: DataFrame, folder: str, seq: int, name: str = "name") -> None:
    """Add one for each row to the counter that its column names; null names count nothing. Only sums a name are written."""
    at = f"{folder}/log/seq={seq}"
    if seq <= _upto(folder) or committed(at):
        return
    rows.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("name")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(at)


def sink(folder: str, name: str = "name") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch that is delivered again is counted once."""
    return lambda batch, number: append(batch, folder, number, name)


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(name, count) of every counter; one that was never added to has no row, which stands for 0."""
    upto = _upto(folder)
    tail = [n for n in numbered(f"{folder}/log", "seq") if n > upto]
    parts = [spark.read.schema(_LOG).parquet(*[f"{folder}/log/seq={n}" for n in tail])] if tail else []
    if upto >= 0:
        parts.append(spark.read.schema(_SNAPSHOT).parquet(f"{folder}/snapshots/upto={upto}").select("name", F.col("count").alias("n")))
    if not parts:
        return spark.createDataFrame([], _SNAPSHOT)
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.groupBy("name").agg(F.sum("n").alias("count"))


def total(spark: SparkSession, folder: str, name: str) -> int:
    row = totals(spark, folder).where(F.col("name") == name).first()
    return row["count"] if row else 0


def compact(spark: SparkSession, folder: str) -> None:
    """Fold the log into a new snapshot, then delete what it holds. A crash between the two leaves files that no count reads."""
    old, log = _upto(folder), numbered(f"{folder}/log", "seq")
    new = max(log, default=-1)
    if new > old:
        totals(spark, folder).write.mode("overwrite").parquet(f"{folder}/snapshots/upto={new}")
    upto = max(old, new)
    for n in log:
        if n <= upto:
            drop_folder(f"{folder}/log/seq={n}")
    for n in numbered(f"{folder}/snapshots", "upto"):
        if n < upto:
            drop_folder(f"{folder}/snapshots/upto={n}")

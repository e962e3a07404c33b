"""Shared pieces of the training-data operators: shared storage, id ranges, words."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+ (Java and RE2 syntax).
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


_held: list[dict] = []


def release() -> None:
    """Give freed memory of this process back to the system, as the other processes of an executor share its limit."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def only(*memos: dict) -> None:
    """Empty the memos that other operators left in this Python worker, which Spark uses again for later stages."""
    gone = [m for m in _held if not any(m is x for x in memos)]
    _held[:] = memos
    for m in gone:
        m.clear()
    if gone:
        release()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), also set as checkpoint folder.

    Only a local session may lack the setting; it then gets a temporary folder. A cluster without it is refused,
    as a machine-local folder would lose files there.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    now = sc._jsc.sc().getCheckpointDir()
    if base is None and now.isDefined():
        return now.get()
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quire-')}"
    if not now.isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder. What is written there stays until its owner deletes it."""
    return f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@lru_cache(maxsize=64)
def _filesystem(prefix: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(prefix)[0]


def open_fs(uri: str):
    """(pyarrow file system, path) of a file:, hdfs:, s3: ... address, for reads and writes in Python workers."""
    from pyarrow.fs import FileSystem

    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    if uri.startswith("file://"):
        return _filesystem("file:///"), uri[7:]
    return FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a file under a side name, then move it: a repeated or speculative task leaves one whole file."""
    fs, path = open_fs(uri)
    side = f"{path}.{uuid.uuid4().hex}.tmp"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(side) as out:
        out.write(data)
    fs.move(side, path)


def drop_folder(uri: str) -> None:
    fs, path = open_fs(uri)
    fs.delete_dir(path)


def slices(lengths: list[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows whose lengths sum up to `most` or less, or of one row; none of no rows."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    if lengths:
        yield start, len(lengths) - start


def text_bytes(docs: DataFrame, text_col: str = "text", row: int = 0) -> int:
    """Bytes of all texts; each row, also one without a text, counts `row` besides."""
    return docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + row)).first()[0] or 0


def id_bounds(df: DataFrame, id_col: str, n: int) -> list[int]:
    """Up to n - 1 ascending cut points that deal the rows into n id ranges of about equal counts.

    The driver gets n numbers, which is the number of ranges, never rows. Equal ids fall into one range.
    """
    if n < 2:
        return []
    got = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
    return sorted(set(got or []))


def byte_bounds(df: DataFrame, id_col: str, size_col: str, each: int) -> list[int]:
    """Ascending cut points of id ranges that hold about `each` bytes by size_col, or one id, which stays whole; null ids are in none.

    Only ids and sizes are range-sorted, many ranges a task. The driver gets one number a range.
    """
    thin = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("_n"))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = each, None  # the first id of a task starts a range
        for b in batches:
            out = []
            for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held + n > each and held and i != last:
                    out.append(i)
                    held = 0
                held, last = held + n, i
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["_id"])

    tasks = max(1, (thin.agg(F.sum("_n")).first()[0] or 0) // each // 8)
    ranged = thin.repartitionByRange(tasks, "_id").sortWithinPartitions("_id")
    return sorted(r[0] for r in ranged.mapInArrow(starts, "_id long").collect())[1:]


def range_of(col: Column, bounds: list[int]) -> Column:
    """Number of bounds that are <= col, by two levels of short array searches; null ids go to range 0.

    The bounds enter the plan as one folded constant, 8 bytes each; callers limit their number.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    row = F.size(F.filter(numbers(bounds[::step]), lambda b: b <= col))
    inner = F.size(F.filter(F.slice(numbers(bounds), (row - 1) * step + 1, F.lit(step)), lambda b: b <= col))
    return F.when(col.isNull() | (row == 0), 0).otherwise((row - 1) * step + inner).cast("int")


def n_ranges(spark: SparkSession, rows: int, each: int) -> int:
    """Ranges of about `each` rows, and no fewer than the session's shuffle partitions."""
    return max(-(-rows // each), int(spark.conf.get("spark.sql.shuffle.partitions")))


def prefix_starts(sizes: DataFrame, id_col: str, size_col: str, ranges: int, out: str = "start", keep: str | None = None) -> DataFrame:
    """sizes plus the running sum of size_col over all rows before it by ascending id_col (nulls first).

    Two levels: rows are range-sorted once and held, sums of ranges (one row each) are added up, then rows inside a range.
    Rows of equal id are ordered by size and then all other columns, and may lie in several ranges, so no id is one task.
    keep: name of a column for the number of the row's range, from 0, ascending with the sum.
    """
    order = [F.col(id_col).asc_nulls_first(), F.col(size_col), *[F.col(c) for c in sizes.columns if c not in (id_col, size_col)]]
    dealt = cut(sizes.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(F.col("_range").alias("_r")).agg(F.sum(size_col).alias("_sum"))  # one row a range
    sums = sums.select("_r", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn(out, F.coalesce(F.sum(size_col).over(inside), F.lit(0)))
    run = run.join(sums, F.col("_range") == F.col("_r")).withColumn(out, (F.col(out) + F.col("_base")).cast("long")).drop("_r", "_base")
    return run.withColumnRenamed("_range", keep) if keep else run.drop("_range")


def join_by_key(left: DataFrame, right: DataFrame, key: str, copies: str, rows: int, most_hot: int = 10_000, deal: Column | None = None) -> DataFrame:
    """left join of `rows` rows with a table of one row a key (string, binary or long), whose column `copies` says how often left has the key.

    Keys with over rows / most_hot copies are at most most_hot: they are broadcast, and their rows are dealt evenly, so
    that no key, however frequent, is one task. All others are shuffled. `copies` is not in the result. They are dealt by
    deal, a hash that differs from row to row; without it by their place in left, which must then be read from a checkpoint or a file, so that
    a repeated task reads it in the same order.
    """
    names = [c for c in right.columns if c not in (key, copies)]
    least = max(1000, rows // most_hot)
    hot = right.where(F.col(copies) > least).select(F.col(key).alias("_hot"), F.struct(*names).alias("_hit"))
    rest = right.where(F.col(copies) <= least).select(F.col(key).alias("_key"), F.struct(*names).alias("_met"))
    j = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    kind, place = dict(left.dtypes)[key], F.pmod(F.monotonically_increasing_id() if deal is None else deal, F.lit(65_536))
    spread = place if kind == "bigint" else F.concat(F.lit("\u0001"), place.cast("string")).cast(kind)
    j = j.withColumn("_at", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread))
    j = j.join(rest, F.col("_at") == F.col("_key"), "left")  # at most one row: what a spread key meets by chance is not taken
    return j.select(*left.columns, *[F.when(F.col("_hot").isNull(), F.col(f"_met.{n}")).otherwise(F.col(f"_hit.{n}")).alias(n) for n in names])

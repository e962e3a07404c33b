"""Changes of tables as functions from old rows to new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(old: DataFrame, new: DataFrame, **defaults) -> DataFrame:
    for name, value in defaults.items():
        new = new.withColumn(name, F.lit(value))
    return old.unionByName(new, allowMissingColumns=True)


def upsert_add(counters: DataFrame, deltas: DataFrame) -> DataFrame:
    """counters (name, count) plus deltas (name, delta); a name that is absent starts at 0."""
    d = deltas.groupBy("name").agg(F.sum("delta").alias("delta"))
    return counters.join(d, "name", "full").select("name", (F.coalesce("count", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("count"))


def update_where(rows: DataFrame, test: Column, **values) -> DataFrame:
    hit = F.coalesce(test, F.lit(False))
    put = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.withColumns({k: F.when(hit, put(v)).otherwise(F.col(k)) for k, v in values.items()})


def delete_where(rows: DataFrame, test: Column) -> DataFrame:
    """A null test keeps the row."""
    return rows.where(~F.coalesce(test, F.lit(False)))


def list_edit(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null values of edits, by key; edits has one row a key."""
    names = [c for c in edits.columns if c != key]
    e = edits.select(key, *[F.col(n).alias(f"_{n}") for n in names])
    j = rows.join(e, key, "left")
    return j.withColumns({n: F.coalesce(f"_{n}", n) for n in names}).select(*rows.columns)


def promote(conversions: DataFrame) -> DataFrame:
    """Library rows of ready conversions, unpublished; the title falls back to the upload's name. Book data and cover go with it where the columns are there."""
    from quire.functions.scalar import filled

    ready = conversions.where("status = 'ready'")
    return ready.select(F.col("id").alias("uid"), F.coalesce(filled(F.col("title")), F.col("name")).alias("title"), F.coalesce("author", F.lit("")).alias("author"), F.coalesce("language", F.lit("")).alias("language"), F.lit(False).alias("is_published"), *[c for c in ("data", "cover") if c in conversions.columns])


def convert_suggestions(rows: DataFrame) -> DataFrame:
    """A suggestion with a PDF becomes a conversion that is kept, named after its title; one without gives an error row."""
    pdf = lambda c: F.when(F.col("has_pdf"), c)
    title = F.col("title")
    made = [pdf(title).alias("name"), pdf(F.concat(title, F.lit(".pdf"))).alias("file"), pdf(F.col("size")).alias("size"), pdf(F.col("pages")).alias("pages"), pdf(F.lit("reading")).alias("status"), pdf(F.lit(True)).alias("keep")]
    return rows.select("doc_id", *made, F.when(~F.col("has_pdf"), "no_pdf").alias("error"))


def backfill_uid(rows: DataFrame, folder: str) -> DataFrame:
    """Rows with a uuid each, written to folder once and read back, so that it does not change on a rerun."""
    rows.withColumn("uid", F.uuid()).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)

"""Delivery of an outbox from a stream, with a ledger, so that a batch that comes again sends nothing twice.

Ledger layout: claimed/batch=<n>/ has the rows that a batch is about to send, sent/batch=<n>/ what became of each. A batch whose claim
is there is never sent again: mail is sent at most once, and what a crash left between the two is listed by unconfirmed().
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.storage import committed, numbered

log = logging.getLogger(__name__)

FIELDS = ["recipient", "subject", "body", "reply_to"]
_CLAIM = "message string, recipient string, subject string, body string, reply_to string"
_SENT = "message string, error string"


def deliver(batch: DataFrame, number: int, folder: str, send: Callable[[dict], None], key: str) -> None:
    """Send the rows (key, recipient, subject, body, reply_to) of a batch, each key once; rows without a recipient or key are not sent.

    send gets a row as a dict with `message`, a name made of batch and key, which stays the same if a task is lost after it sent and before it
    wrote: a mail server that drops a Message-ID seen before then drops the copy. What send raises is kept in the ledger, never raised.
    """
    claimed, sent = f"{folder}/claimed/batch={number}", f"{folder}/sent/batch={number}"
    if committed(claimed):
        log.warning("batch %s was claimed before; nothing is sent", number)
        return
    rows = batch.where((F.col("recipient") != "") & F.col(key).isNotNull())
    name = F.sha2(F.concat(F.lit(f"{number}|"), F.col(key).cast("string")), 256)
    claim = rows.select(name.alias("message"), *FIELDS).groupBy("message").agg(F.min(F.struct(*FIELDS)).alias("_m")).select("message", "_m.*")
    claim.write.mode("overwrite").parquet(claimed)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            errors = []
            for row in part.to_dict("records"):
                try:
                    send(row)
                    errors.append(None)
                except Exception as e:  # a failure is told, and the others still go
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"message": part["message"], "error": errors})

    spark = batch.sparkSession
    spark.read.schema(_CLAIM).parquet(claimed).mapInPandas(run, _SENT).write.mode("overwrite").parquet(sent)
    failed = spark.read.schema(_SENT).parquet(sent).where("error is not null").count()
    if failed:
        log.error("batch %s: %s messages could not be sent", number, failed)


def sink(folder: str, send: Callable[[dict], None], key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch."""
    return lambda batch, number: deliver(batch, number, folder, send, key)


def _ledger(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    batches = numbered(f"{folder}/{name}", "batch")
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{name}/batch={n}" for n in batches])


def unconfirmed(spark: SparkSession, folder: str) -> DataFrame:
    """Claimed rows of which no result is known, or whose sending failed, with the error (null: no result)."""
    sent = _ledger(spark, folder, "sent", _SENT)
    known = _ledger(spark, folder, "claimed", _CLAIM).join(sent.withColumn("_known", F.lit(True)), "message", "left")
    return known.where("_known is null or error is not null").drop("_known")

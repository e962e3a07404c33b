"""A training corpus from the documents table, in five stages; each works on all that its predecessor kept.

quality    documents that the classifier rejects go
neardup    of each group of near-duplicates (5-word shingles; exact similarity of 0.8 or more) the document of smallest id stays
repeats    words that repeat an earlier document for 13 words or more go
mix        each source is taken to its target weight: a document stands 0 to 3 times
pack       token sequences of at most 4096
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut
from quire.llm.mixing import mix
from quire.llm.packing import pack
from quire.llm.queries import _tokenizer, quality_scores
from quire.llm.simhash import similar_groups
from quire.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row, as ids may be null or repeat; numbers are fixed by a checkpoint."""
    return cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score of 0.7 or more."""
    scored = quality_scores(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("_score") >= 0.7).select(*COLUMNS)


def neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id in each group, whole rows even where ids are null (last) or repeat."""
    rows = _rows(docs)
    groups = similar_groups(rows, "_row").join(rows.select("_row", "doc_id"), "_row")
    first = groups.groupBy("component_id").agg(F.count("*").alias("_n"), F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_row")).alias("_first")).where("_n > 1")
    gone = groups.join(first, "component_id").where("_row <> _first._row").select("_row")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated words; what is left of a text keeps its lines and paragraphs, and a text without repeats stays as it is. Documents of which nothing is left go."""
    found = remove_repeats(docs, carry=("text", "lang", "source", "n_chars"), layout=True)
    less = F.col("n_removed") > 0
    out = found.where(~less | (F.col("n_removed") < F.col("n_words"))).withColumn("text", F.when(less, F.col("kept_text")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(less, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words are in no mix."""
    rows = _rows(docs)
    times = mix(rows, row_col="_row").where("taken > 0").select("_row", (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    joined = rows.join(times, "_row")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = pack(docs, _tokenizer("word_bpe_49k.json"), end_id=2)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("neardup", neardup), ("repeats", repeats), ("mix", mixed), ("pack", packed)]

#: Model training, tokenizers and hash-cut packing have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    from quire.llm.common import new_folder

    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs

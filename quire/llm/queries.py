"""The queries op1_ to op13_ and pipeline: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.substring_dedup import remove_repeats

    got = remove_repeats(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.token_store import store_of

    _, got = store_of(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0)
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.lower(F.hex("root")).alias("merkle_root"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.sharding import shards

    got = shards(_table(spark, sf_dir, "documents"), n_shards=16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack

    got = pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs plus _score; learned from labelled rows whose crc32 of the id as text is not 2 modulo 4."""
    from quire.llm.quality import fit, score

    learn = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    return score(docs, fit(docs, learn), out="_score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality_scores(docs, _table(spark, sf_dir, "labels"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.simhash import near_groups

    got = near_groups(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.warc import archive

    _, got = archive(_table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.embedding_dedup import near_groups

    return near_groups(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.winnowing import as_text, compare_edits

    got = compare_edits(_table(spark, sf_dir, "documents"))
    texts = [F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited_fingerprint")).alias("edited_fingerprint")]
    return got.select("doc_id", "n_chars", *texts, "near_edited", "near_next")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.lexical import search_all

    return search_all(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine(vectors, anchors=F.col("vec_id") % 100 == 0, low=80, positives=5, negatives=5, scale=256)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.word_table import decode, encode

    tokenizer = _tokenizer("byte_bpe_50k.json")
    got = decode(encode(_table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from quire.llm.sql import ORACLES

    return dict(ORACLES)

"""Sizes, splits and damage: stores whose files Spark splits, tables of empty texts, null and repeated ids, lost files."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import WORD, path


def test_a_store_whose_recipe_files_are_split(spark):
    """Row groups of few rows and splits of few bytes: a range is read by many tasks."""
    from tokenizers import Tokenizer

    from quire.llm import token_store as ts

    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(r.randint(0, 300))) for _ in range(400)]
    texts[7] = "a book of many words " * 50_000
    hadoop, key = spark.sparkContext._jsc.hadoopConfiguration(), "spark.sql.files.maxPartitionBytes"
    sizes = {"parquet.block.size": "4096", "parquet.block.size.row.check.min": "10", "parquet.block.size.row.check.max": "20", "parquet.page.size.row.check.min": "10"}
    for k, v in sizes.items():
        hadoop.set(k, v)
    before = spark.conf.get(key)
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        folder = ts.new_folder(spark, "split-store")
        ts.write(docs, folder, path("byte_bpe_50k.json"), range_rows=150)
        spark.conf.set(key, "8192")
        assert spark.read.parquet(f"{folder}/recipes").rdd.getNumPartitions() > 2 * spark.read.parquet(f"{folder}/manifest").count()
        got = {x.doc_id: (x.start, x.n_tokens, bytes(x.ids)) for x in ts.read(spark, folder).collect()}
    finally:
        spark.conf.set(key, before)
        for k in sizes:
            hadoop.unset(k)
    t, at = Tokenizer.from_file(path("byte_bpe_50k.json")), 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert got[i] == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_a_changed_recipe_is_found_before_it_is_read(spark):
    from quire.llm import token_store as ts

    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    folder, _ = ts.store_of(docs, path("byte_bpe_50k.json"), range_rows=10)
    recipes = spark.read.parquet(f"{folder}/recipes").withColumn("start", F.when(F.col("doc_id") == 20, F.col("start") + 1).otherwise(F.col("start")))
    other = ts.new_folder(spark, "changed")
    recipes.write.parquet(f"{other}/recipes")
    for name in ("manifest", "top"):
        os.symlink(f"{folder}/{name}".removeprefix("file://"), f"{other}/{name}".removeprefix("file://"))
    with pytest.raises(ValueError, match="lost or changed"):
        ts.verify(spark, other)


def test_empty_texts_fill_groups_and_ranges(spark):
    from quire.llm.common import byte_bounds, text_bytes
    from quire.llm.packing import pack
    from quire.llm.substring_dedup import ROW

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "").alias("text"))
    groups = pack(docs, path("word_bpe_49k.json"), end_id=2, group_tokens=2000).groupBy((F.col("sequence_id") / 2**32).cast("long")).count().collect()
    assert len(groups) >= 8 and max(r["count"] for r in groups) < 4000 and sum(r["count"] for r in groups) == 20_000
    assert text_bytes(docs, "text", ROW) == 20_000 * ROW
    bounds = byte_bounds(docs.select("doc_id", F.lit(ROW).alias("size")), "doc_id", "size", 1000 * ROW)
    assert 19 <= len(bounds) <= 40


def test_null_ids_are_mixed_in_many_cells(spark, monkeypatch):
    from quire.llm import mixing as M

    seen, real = [], M.cut

    def cut(df):
        out = real(df)
        if "_key" in out.columns:
            seen.append(out.select("_key").distinct().count())
        return out

    monkeypatch.setattr(M, "cut", cut)
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    got = M.mix(docs)
    assert got.agg(F.sum("taken")).first()[0] == 4000 and seen[0] == 2000


def test_without_keeps_lines_and_paragraphs():
    from quire.llm.substring_dedup import without

    text = b"  title\n\nfirst line\nsecond line\none two three\n\n  last\tword \n"
    words = text.split()
    assert without(text, []) == text
    assert without(text, [[5, 8]]) == b"  title\n\nfirst line\nsecond line\n\n  last\tword \n"
    assert without(text, [[0, 1], [5, 8]]) == b"first line\nsecond line\n\n  last\tword \n"
    assert without(text, [[8, 10]]) == b"  title\n\nfirst line\nsecond line\none two three \n"
    assert without(text, [[0, 10]]).split() == []
    r = random.Random(4)
    for _ in range(200):
        gone = [r.random() < 0.4 for _ in words]
        edge = np.flatnonzero(np.diff([0, *map(int, gone), 0])).reshape(-1, 2).tolist()
        assert without(text, edge).split() == [w for w, g in zip(words, gone, strict=True) if not g]


def test_pipeline_keeps_the_layout_of_what_is_left(spark):
    import corpus_pipeline as cp

    passage = " ".join(f"p{i}" for i in range(13))
    texts = [f"start\n\n{passage}", f"title\n\nfirst line\nsecond line\n{passage}\n\n\tnext  paragraph\n", "plain\n text", passage, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.repeats(spark, docs, "").collect()}
    left = "title\n\nfirst line\nsecond line\n\n\tnext  paragraph\n"
    assert got == {0: (texts[0], 1), 1: (left, len(left)), 2: (texts[2], 1), 4: (None, 1), 5: ("", 1)}


def test_close_vectors_in_a_label_that_needs_the_grid(spark):
    """3,000 vectors of one label: 1,500 pairs right above the threshold, none else near. Recall against brute force."""
    from quire.llm.embedding_dedup import grids, near_groups

    r = np.random.default_rng(3)
    a = r.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.standard_normal((1500, 64))
    b -= (b * a).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = r.uniform(0.9302, 0.94, 1500)[:, None]
    v = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit @ unit.T >= 0.93
    assert grids(len(v), 2048, 0.93)[0] > 0
    rows = [(i, x.tolist(), 1, "clash", "clash", 0) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string, cells string, n long")
    links = {x.vec_id: x.n_links for x in near_groups(df).collect()}
    want = near.sum(1) - 1
    assert all(links[i] <= want[i] for i in links) and sum(links.values()) >= 0.99 * want.sum() and len(links) == 3000


def test_rows_of_equal_id_are_rows_of_their_own(spark):
    from quire.llm.embedding_dedup import near_groups
    from quire.llm.quality import fit, score
    from quire.llm.warc import archive

    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted((x.vec_id, x.n_links) for x in near_groups(df).collect()) == [(1, 0), (1, 2), (1, 2), (2, 2)]
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (1, "v", "b"), (2, "w", "a")], "page_id long, url string, html string")
    got = sorted((x.page_id, x.record_type, x.refers_to or 0) for x in archive(pages)[1].collect())
    assert got == [(1, "response", 0), (1, "revisit", 2), (1, "revisit", 2), (2, "response", 0)]
    r = random.Random(2)
    docs = spark.createDataFrame([(i // 2, " ".join(r.choice(["good", "fine"] if i % 2 else ["bad", "poor"]) for _ in range(30))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = score(docs, fit(docs, labels), out="score").collect()
    assert len(got) == 40 and all(0 <= x.score <= 1 for x in got)


def test_damaged_and_lost_bundles_are_errors(spark):
    from quire.llm import warc

    good = warc.record(1, "u", b"payload", "response", None, "1970-01-01T00:00:00Z")
    assert warc.parse(good)[1] == b"payload"
    for bad in (good[:-1], good[:-6], b"HTTP/1.1 200 OK\r\n\r\n", good.replace(b"WARC/1.1", b"WARC/9.9")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    folder, got = warc.archive(pages)
    (name,) = os.listdir(f"{folder}/bundles".removeprefix("file://"))
    file = f"{folder}/bundles/{name}".removeprefix("file://")
    data = open(file, "rb").read()
    assert got.count() == 40
    for change in (data[: len(data) // 2], None):
        os.remove(file)
        if change is not None:
            with open(file, "wb") as f:
                f.write(change)
        with pytest.raises(Exception):  # noqa: B017  Spark's, with the reader's inside
            warc.read(spark, folder).collect()


def test_repeats_across_chunks_of_grown_size(spark, monkeypatch):
    """More text than MOST_CHUNKS chunks hold: chunks and buckets grow, the result is the same."""
    from quire.llm import substring_dedup as S

    r = random.Random(5)
    docs = [(i, " ".join(r.choice("abcd") for _ in range(60))) for i in range(120)] + [(200 + i, " ".join(f"x{j}" for j in range(i, i + 40))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    get = lambda: sorted((x.doc_id, x.n_removed, x.kept_text) for x in S.remove_repeats(df, chunk_bytes=500, bucket_bytes=300).collect())
    want = get()
    monkeypatch.setattr(S, "MOST_CHUNKS", 5)
    assert get() == want and sum(n for _, n, _ in want) > 500 and all(len(WORD.findall(t)) + n in (60, 40) for _, n, t in want)


@pytest.mark.parametrize("most", [200_000, 10])
def test_shards_of_a_capacity_without_broadcasts(spark, monkeypatch, most):
    """Many shards, and a text with a third of all rows: the same shards whether the tables of groups are broadcast or not."""
    from quire.llm import sharding as S

    r = random.Random(6)
    texts = ["copied " * 5] * 400 + ["x" * r.randint(0, 300) + str(i) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(S, "MOST_BROADCAST", most)
    got = S.shards(docs, n_shards=None, capacity=2000).collect()
    assert sorted(x.doc_id for x in got) == list(range(1200)) and {x["size"] == len(texts[x.doc_id]) + 1 for x in got} == {True}
    by: dict = {}
    for x in got:
        by.setdefault(x.shard, []).append(x)
    assert all(sorted(x.slot for x in s) == list(range(len(s))) for s in by.values())
    copied = {x.shard for x in got if x.doc_id < 400}
    assert len(copied) == 1 and all(sum(x["size"] for x in s) <= 2000 for k, s in by.items() if k not in copied)
    assert len(by) <= 1.1 * (1 + -(-sum(len(t) + 1 for t in texts[400:]) // 2000))

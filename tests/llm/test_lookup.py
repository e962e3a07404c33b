"""Operators 11 to 13 (ranked search, hard negatives, byte-pair encoding) against plain loops, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hard_negatives as H
from quire.llm import lexical as X
from quire.llm import word_table as W
from tests.llm.test_operators import path

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, score long, term string, _id long"


def terms_of(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


def ranking(docs, items, k):
    """Rows (item, rank, doc_id, score) straight from the definition; docs: (doc_id, text)."""
    words = [(i, terms_of(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, w in words:
            score = 0
            for t in sorted(set(terms_of(text)) & set(w)):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * len(w) * n // total)))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def shelf():
    r = random.Random(4)
    vocabulary = ["THE", "the", "Étoile", "étoile", "x9", "中文", "a_b", "don't", *(f"w{i}" for i in range(60))]
    say = lambda n: " ".join(r.choice(vocabulary[: r.randint(4, len(vocabulary))]) for _ in range(n))
    texts = [None, "", " -- ", say(4000), *(say(r.randint(1, 40)) for _ in range(150))]
    texts += [texts[9]] * 30
    ids = [*r.sample(range(-50, 5000), len(texts) - 3), None, None, 7]
    r.shuffle(texts)
    return list(zip([*ids[:-1], ids[0]], texts, strict=True))


ITEMS = [(1, "the étoile w3 W3 w59"), (2, None), (3, "   "), (4, "nowhere to be found"), (5, "THE don't 中文 a_b w1 w2 w4 w5"), (5, "w7"), (None, "x9 w8")]


@pytest.mark.parametrize(("shard", "block"), [(32 << 20, 4 << 20), (900, 100)])
def test_search(spark, shelf, shard, block):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in shelf], DOCS).repartition(3)
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, doc_id long")
    for k in (5, 1000):
        index = X.build(docs, X.new_folder(spark, "test-index"), shard_bytes=shard)
        got = X.search(index, items, k, block_bytes=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == ranking(shelf, ITEMS, k)


def test_search_of_empty_tables(spark, shelf):
    docs, items = spark.createDataFrame([(i, t) for i, t in shelf], "doc_id long, text string"), spark.createDataFrame([("a", "the")], "item_id string, text string")
    assert X.search_all(docs.limit(0), items).collect() == []
    assert X.search_all(docs, items.limit(0)).collect() == []
    assert {r["item_id"] for r in X.search_all(docs, items).collect()} == {"a"}


@pytest.mark.parametrize("most", [1, 40, 1 << 17])
def test_rows_of_a_shard_in_parts(shelf, most):
    shard, want = X._Shard(), {}
    for i, t in shelf:
        shard.add(i, (t or "").encode())
    order = sorted(range(len(shelf)), key=lambda k: (shelf[k][0] is None, shelf[k][0] or 0))
    for place, k in enumerate(order):
        words = [w.encode() for w in terms_of(shelf[k][1])]
        for w in sorted(set(words)):
            want.setdefault(w, []).append((place, words.count(w)))
    rows = [r for b in shard.rows(3, most) for r in b.to_pylist()]
    assert [r["df"] for r in rows if r["term"] is None] == [len(shelf)] and {r["shard"] for r in rows} == {3}
    rows = [r for r in rows if r["term"] is not None]
    got = {}
    for r in rows:
        v = X.unpack_numbers(r["postings"])
        got[r["term"]] = list(zip(np.cumsum(v[::2]).tolist(), v[1::2].tolist(), strict=True))
    assert got == want and len(rows) == len(want) and all(r["df"] == len(want[r["term"]]) for r in rows)


def test_rows_of_a_shard_take_little_memory():
    shard, r = X._Shard(), random.Random(3)
    for i in range(1000):
        shard.add(i, " ".join(f"w{r.randrange(50_000)}" for _ in range(1000)).encode())
    tracemalloc.start()
    for _ in shard.rows(0):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * len(shard.codes)


def test_shards_of_distinct_terms_are_smaller(spark):
    docs = spark.createDataFrame([(i, " ".join(f"a{i * 50 + j}" for j in range(50))) for i in range(100)], "doc_id long, text string").coalesce(1)
    index = X.build(docs, X.new_folder(spark, "test-index"), shard_bytes=10_000)
    terms = {r["shard"]: r["count"] for r in index.where("term is not null").groupBy("shard").count().collect()}
    assert sum(terms.values()) == 5000 and max(terms.values()) <= 40_000 // 150 + 50


def test_shards_are_cut_by_bytes(spark):
    docs = spark.createDataFrame([(i, "ж" * 500) for i in range(40)], "doc_id long, text string").coalesce(1)
    index = X.build(docs, X.new_folder(spark, "test-index"), shard_bytes=10_000)
    assert max(r["df"] for r in index.where("term is null").collect()) * 1000 <= 10_000
    found = X.search(index, spark.createDataFrame([(1, "Ж" * 500), (2, "ж" * 500)], "item_id long, text string")).collect()
    assert [r["item_id"] for r in found] == [2] * 40


def test_merge_equals_plain_sums():
    r = random.Random(8)
    for _ in range(300):
        lists = []
        for _ in range(r.randint(1, 7)):
            places = sorted(r.sample(range(60), r.randint(1, 50)))
            parts = [r.randint(1, 6) for _ in places]
            lists.append((places, parts, max(parts), r.randint(0, 3)))
        total = {}
        for places, parts, _, w in lists:
            for p, s in zip(places, parts, strict=True):
                total[p] = total.get(p, 0) + w * s
        k = r.randint(1, 8)
        assert X.best_of(lists, k) == sorted(((s, p) for p, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]


def test_packed_numbers_come_back():
    v = np.array([0, 1, 127, 128, 300, 2**20, 2**35, 5, 2**62], np.int64)
    data, ends = X.pack_numbers(v)
    assert X.unpack_numbers(data.tobytes()).tolist() == v.tolist() and ends[-1] == len(data)
    assert X.unpack_numbers(b"").tolist() == []


def negatives(rows, low=80):
    """Straight from the definition; rows: (number, id, label, vector, anchor)."""
    scaled = [(n, i, lb, [math.floor(256 * x) for x in v], a) for n, i, lb, v, a in rows if lb is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, label, v, anchor in scaled:
        if not anchor:
            continue
        others = sorted((-sum(map(lambda a, b: a * b, v, w)), j is None, j or 0, lb == label) for m, j, lb, w, _ in scaled if m != n and len(w) == len(v))
        for s, none, j, _ in [o for o in others if o[3]][:5]:
            fit = [o for o in others if not o[3] and low * -s <= 100 * -o[0] <= 100 * -s][:5]
            out += [(i, None if none else j, k, None if o[1] else o[2], -s, -o[0]) for k, o in enumerate(fit, 1)]
    return sorted(out, key=str)


def vectors(n, dim=6):
    r = random.Random(n)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = [[r.randint(0, 3), [float(np.float32(c + r.gauss(0, 0.4))) for c in r.choice(centres)]] for _ in range(n)]
    rows += [[1, rows[3][1]]] * 4 + [[2, [0.0] * dim], [None, rows[0][1]], [1, None], [1, []], [1, [None] * dim], [2, [float("nan")] * dim], [0, [float("inf")] + [0.0] * (dim - 1)], [3, [0.5] * 3], [2, [0.4, 0.5, 0.5]], [3, [0.3, 0.1, 0.2]]]
    ids = r.sample(range(10 * n), len(rows) - 2) + [None, 40]
    return [(k, ids[k], lb, v, ids[k] is not None and ids[k] % 20 == 0) for k, (lb, v) in enumerate(rows)]


@pytest.mark.parametrize(("block", "chunk"), [(4096, 32_768), (3, 50)])
def test_hard_negatives(spark, block, chunk):
    rows = vectors(300)
    df = spark.createDataFrame([(i, v, lb, 1, "x") for _, i, lb, v, _ in rows], "vec_id long, embedding array<float>, label int, score int, chunk string")
    got = H.mine(df.repartition(3), F.col("vec_id") % 20 == 0, block=block, chunk=chunk)
    want = negatives(rows)
    assert len(want) > 50 and sorted(map(tuple, got.collect()), key=str) == want
    assert H.mine(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert H.mine(df, F.col("vec_id") < -1).collect() == []


def test_hard_negatives_of_large_numbers(spark):
    """Scores beyond 2^53 stay exact; components beyond 2^27 leave their row out."""
    big = [(0, 0, 0, [5e5, 3.0], True), (1, 1, 0, [4e5, 1.0], False), (2, 2, 1, [4e5, 0.99], False), (3, 3, 1, [4e5, 1.01], False), (4, 4, 1, [1e30, 1.0], False)]
    df = spark.createDataFrame([(i, v, lb) for _, i, lb, v, _ in big], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, H.mine(df, F.col("vec_id") == 0).collect()), key=str) == negatives(big[:4])


def test_brackets_hold():
    r = np.random.default_rng(2)
    x, q = r.integers(-300, 300, (500, 8)), r.integers(-300, 300, 8)
    square = float((x * x).sum(1).max())
    pivots = H.choose_pivots(H.lift(x[:100].astype(float), square))
    c = H.Chunk(x, H.distances(H.lift(x.astype(float), square), pivots), square, np.arange(500) % 3)
    to = H.distances(np.append(q, 0).astype(float)[None], pivots)[0]
    low, high = c.bracket(q.astype(float), to, c.to, c.to)
    score = c.x @ q
    assert len(pivots) == H.PIVOTS and (low <= score).all() and (score <= high).all()
    fit = np.flatnonzero((score >= 20_000) & (score <= 90_000))
    assert set(fit) <= set(c.survivors(q.astype(float), to, 20_000, 90_000))
    assert len(H.choose_pivots(np.zeros((5, 3)))) == 1


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("byte_bpe_50k.json"))


def odd_texts(n):
    """Texts of characters at which the library's pattern, or a version of a Unicode table, may cut in another way."""
    r = random.Random(1)
    spaces = [9, 10, 11, 12, 13, 0x1C, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200B, 0x2028, 0x202F, 0x2060, 0x3000, 0xFEFF]
    chars = [*map(chr, spaces), *"'.,-(a)stIL12 _[{~^@`", "é", "中", "́", "ก", "😀", "\0", "\x7f", "<|endoftext|>", "<|endof", "'s", "'re", "  ", "\n\n", " the", "'LL"]
    return [None, "", " ", "  \n", "x" * 20_000, "word, " * 20_000] + ["".join(r.choice(chars) for _ in range(r.randint(1, 50))) for _ in range(n)]


@pytest.mark.parametrize("most", [400_000, 40, 0])
def test_bpe(spark, tokenizer, most):
    texts = odd_texts(3000)
    rows = [(None if i % 50 == 7 else i // 2, t, "clash", "clash", i) for i, t in enumerate(texts + texts[:9])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, words string, n long").repartition(5)
    p = path("byte_bpe_50k.json")
    got = W.decode(W.encode(df, p, most=most), p)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    want = []
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    digest = lambda x: (str(x[0]), x[1], hashlib.sha256(bytes(x[2])).hexdigest(), x[3])
    assert sorted(digest(tuple(x)) for x in got.collect()) == sorted(map(digest, want))


def test_each_distinct_word_is_encoded_once(spark, tokenizer):
    df = spark.createDataFrame([(i, "one two, one\ntwo (one)") for i in range(20)], "doc_id long, text string").repartition(4)
    table = W.word_table(df, path("byte_bpe_50k.json"), W.new_folder(spark, "test-words"))
    rows = table.collect()
    assert {r.word: r.n for r in rows} == {"one": 20, " two": 20, ",": 20, " one": 20, "\ntwo": 20, " (one)": 20} and len(rows) == 6
    assert all(np.frombuffer(r.ids, "<u4").tolist() == tokenizer.encode(r.word, add_special_tokens=False).ids for r in rows)


def test_bpe_of_an_empty_table_and_odd_ids(spark, tokenizer):
    p = path("byte_bpe_50k.json")
    assert W.encode(spark.createDataFrame([], "doc_id long, text string"), p).collect() == []
    cases = [[256, 257], [50256, 60000, 11], [163, 220], []]
    df = spark.createDataFrame([(i, bytearray(np.array(c, "<u4").tobytes())) for i, c in enumerate(cases)] + [(9, None)], "i int, ids binary")
    got = {r.i: r.decoded for r in W.decode(df, p).collect()}
    assert got == {i: tokenizer.decode(c, skip_special_tokens=False) for i, c in enumerate(cases)} | {9: None}
    with pytest.raises(ValueError, match="byte-level"):
        W.added_tokens(path("word_bpe_49k.json"))

"""The queries op1_ to op10_ as the driver calls them, on small tables with awkward rows, against plain loops; SQL where there is some."""

import base64
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from quire.llm import queries as Q
from tests.llm.test_operators import SCHEMA, WORD, components, path, queue, rows, simhash
from tests.test_oracles import SF, TABLES, plain


@pytest.fixture(scope="module")
def data():
    return sorted(rows())


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/{name}.parquet")
    put("documents", data, SCHEMA.replace("_text string", "score string"))
    put("labels", [(i, k % 2, 0, "x") for k, (i, *_) in enumerate(data)] + [(None, 1, 0, "x"), (data[0][0], None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    put("pages", [(i, None if i % 7 == 0 else "u", None if i % 5 == 0 else "" if i % 5 == 1 else f"é{i % 9}", "x") for i in range(60)], "page_id long, url string, html string, record_type string")
    return str(d)


def run(spark, folder, name):
    return getattr(Q, name)(spark, folder).collect()


def text_of(data):
    return {i: t or "" for i, t, *_ in data}


def test_op1(spark, folder, data):
    first, want = {}, {}
    for i, t, *_ in data:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        want[i] = (i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    assert {x.doc_id: tuple(x)[:4] for x in run(spark, folder, "op1_substring_dedup")} == want


def test_op2(spark, folder, data):
    from tokenizers import Tokenizer

    t, at, got = Tokenizer.from_file(path("byte_bpe_50k.json")), 0, {x.doc_id: x for x in run(spark, folder, "op2_token_store")}
    assert len(got) == len(data)
    for i, text, *_ in data:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(got[i])[:4] == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op3(spark, folder, data):
    got, text = run(spark, folder, "op3_sharding"), text_of(data)
    assert sorted(x.doc_id for x in got) == sorted(text)
    assert {x["size"] for x in got if x["size"] != len(text[x.doc_id].encode()) + 1 or x.text_crc32 != zlib.crc32(text[x.doc_id].encode())} == set()
    assert {(x.law, x.grown_shard) for x in got} == {("bytes", None)} and {x.shard for x in got} <= set(range(16))
    assert sorted((x.shard, x.slot) for x in got) == [(s, k) for s in range(16) for k in range(sum(x.shard == s for x in got))]
    assert len({(text[x.doc_id], x.shard) for x in got}) == len(set(text.values()))


def test_op4(spark, folder, data):
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in data}
    got = run(spark, folder, "op4_mixing")
    assert {x.doc_id: x.taken for x in got} == queue([(i, s, size[i]) for i, _, _, s, *_ in data])
    by: dict = {}
    for i, _, _, s, *_ in data:
        by[s] = by.get(s, 0) + size[i]
    of = {i: s for i, _, _, s, *_ in data}
    assert all((x["size"], x.source_size) == (size[x.doc_id], by[of[x.doc_id]]) for x in got)


def test_op5(spark, folder, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, *_ in data}
    got, at, seen = run(spark, folder, "op5_packing"), {}, {i: [] for i in want}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        ids = want[x.doc_id][x.start : x.start + x.length]
        assert (x.length, x.ids_crc32, x.doc_tokens, x.offset) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(want[x.doc_id]), at.get(x.sequence_id, 0))
        at[x.sequence_id] = x.offset + x.length
        seen[x.doc_id] += range(x.start, x.start + x.length)
    assert max(at.values()) <= 4096 and {i: sorted(s) for i, s in seen.items()} == {i: list(range(len(x))) for i, x in want.items()}
    assert len(at) <= -(-sum(map(len, want.values())) // 4096) + 1


def test_op6(spark, folder, data):
    got = run(spark, folder, "op6_quality")
    assert sorted(x.doc_id for x in got) == sorted(i for i, *_ in data)
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)


def test_op6_learns_from_no_held_out_label(spark, folder, data, tmp_path):
    held = {i for i, *_ in data if zlib.crc32(str(i).encode()) % 4 == 2}
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, k % 2 if i not in held else 1 - k % 2, 1, "y") for k, (i, *_) in enumerate(data)] + [(None, 0, 0, "x")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    one, two = ({x.doc_id: x.score for x in run(spark, d, "op6_quality")} for d in (folder, str(tmp_path)))
    assert one == two


def test_op6_scores_equal_a_plain_forward_pass():
    """Gated attention written out passage by passage."""
    from quire.llm.quality import encode, train

    r = random.Random(3)
    texts = [" ".join(r.choice(["alpha", "BETA!", "7", "été"]) for _ in range(r.randint(0, 300))).encode() for _ in range(12)]
    x, counts = encode(texts, 64)
    m = train(x, counts, np.array([i % 2 for i in range(12)], np.float32), rounds=1)
    want, at = [], 0
    for n in counts:
        h = [np.tanh((p - m.mean) / m.scale @ m.A + m.a) for p in x[at : at + n].astype(float)]
        e = np.exp([m.w @ (np.tanh(v @ m.V) / (1 + np.exp(-(v @ m.U)))) for v in h])
        z = sum(a * v for a, v in zip(e / e.sum(), h, strict=True))
        want.append(1 / (1 + np.exp(-(m.c @ z + m.b[0]))))
        at += n
    assert np.allclose(m.scores(x, counts), want, atol=1e-5)


def test_op7(spark, folder, data):
    fp = {i: simhash(t) for i, t in text_of(data).items()}
    want = components(fp, [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2])
    assert {x.doc_id: tuple(x)[1:3] for x in run(spark, folder, "op7_simhash")} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_op8(spark, folder):
    html = {i: "" if i % 5 <= 1 else f"é{i % 9}" for i in range(60)}
    top = {h: max(i for i in html if html[i] == h) for h in html.values()}
    want = {i: (i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if top[h] == i else "revisit", None if top[h] == i else top[h]) for i, h in html.items()}
    assert {x.page_id: tuple(x)[:5] for x in run(spark, folder, "op8_warc")} == want


def test_op10(spark, folder, data):
    text, order = text_of(data), [i for i, *_ in data]
    got, same = {x.doc_id: x for x in run(spark, folder, "op10_fingerprints")}, {}
    for k, i in enumerate(order):
        follow, n = order[(k + 1) % len(order)], len(text[i])
        edited = text[i][: n - n // 2] + text[follow][: n // 2]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for t, f in ((text[i], x.fingerprint), (edited, x.edited_fingerprint)):
            assert same.setdefault(t, f) == f and re.fullmatch(r"[0-9a-f]+@\d+(,[0-9a-f]+@\d+)*", f)
    marks = lambda f: {p.split("@")[0] for p in f.split(",")}
    for k, i in enumerate(order):
        a, b, e = (marks(f) for f in (got[i].fingerprint, got[order[(k + 1) % len(order)]].fingerprint, got[i].edited_fingerprint))
        assert abs(got[i].near_next - len(a & b) / len(a | b)) < 1e-12 and abs(got[i].near_edited - len(a & e) / len(a | e)) < 1e-12


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES.split():
        duck.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cur = duck.execute(Q.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()], key=str)
    assert sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str) == want

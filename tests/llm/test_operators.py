"""The ten operators against brute force, round trips and held-out accuracy, on small fixtures with the awkward cases."""

import os
import random
import re
import zlib

import numpy as np
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string"


def rows():
    r = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, texts = say(60), [None, "", " \n ", "one", "a b", "x" * 500]
    texts += [say(r.randint(1, 120)) for _ in range(40)]
    texts += [say(30) + "\n" + passage + "  " + say(20) for _ in range(6)] + [texts[10]] * 5 + [say(9000)]
    texts += [re.sub("w1 ", "W1 ", texts[12]), texts[13].replace("w2", "q2"), "r " * 300]
    r.shuffle(texts)
    ids = [r.randint(0, 10**12) if i % 3 else i for i in range(len(texts))]
    return [(i, t, "en", ["s1", "s2", "s3", None][k % 4] if k % 5 else "s1", len(t or ""), "clash") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_null_id(spark, data):
    return spark.createDataFrame([(None, data[3][1] or "t", "en", "s1", 1, "c"), *data, data[5]], SCHEMA)


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_substring_dedup(spark, docs, data, empty):
    from quire.llm.substring_dedup import remove_repeats

    for chunk in (2000, 1 << 20):
        got = {r.doc_id: r for r in remove_repeats(docs, chunk_bytes=chunk, bucket_bytes=3000).collect()}
        first, want = {}, {}
        for i, t, *_ in sorted(data, key=lambda x: x[0]):
            w = WORD.findall(t or "")
            gone = [False] * len(w)
            for k in range(len(w) - 12):
                if first.setdefault(tuple(w[k : k + 13]), i) < i:
                    gone[k : k + 13] = [True] * 13
            want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
        assert {i: (r.n_words, r.n_removed, r.kept_text) for i, r in got.items()} == want
        assert any(r.n_removed for r in got.values())
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got.values())
    assert remove_repeats(empty).count() == 0
    extra = remove_repeats(with_null_id(spark, data)).where("doc_id is null").first()
    assert extra.n_removed == 0


def test_token_store_round_trip(spark, docs, data, empty):
    from tokenizers import Tokenizer

    from quire.llm.common import open_fs
    from quire.llm.token_store import store_of

    name = path("byte_bpe_50k.json")
    folder, got = store_of(docs, name, range_rows=20)
    got = {r.doc_id: r for r in got.collect()}
    t, at = Tokenizer.from_file(name), 0
    for i, text, *_ in sorted(data, key=lambda x: x[0]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (at, len(ids) // 4, ids)
        at += len(ids) // 4
    fs, p = open_fs(f"{folder}/packs")
    from pyarrow.fs import FileSelector

    stored = sum(f.size for f in fs.get_file_info(FileSelector(p)))
    parts = spark.read.parquet(f"{folder}/recipes").select(F.explode("parts").alias("p")).select("p.digest", "p.n").distinct()
    assert stored == 2 * parts.agg(F.sum("n")).first()[0]  # each unique chunk once
    bad = fs.get_file_info(FileSelector(p))
    big = max(bad, key=lambda f: f.size).path
    with fs.open_input_file(big) as f:
        content = bytearray(f.read())
    content[0] ^= 1
    with fs.open_output_stream(big) as f:
        f.write(bytes(content))
    from quire.llm.token_store import read

    with pytest.raises(Exception, match="do not match"):
        read(spark, folder).collect()
    with open_fs(f"{folder}/top")[0].open_output_stream(open_fs(f"{folder}/top")[1]) as f:
        f.write(b"{}")
    with pytest.raises(ValueError, match="does not match its root"):
        read(spark, folder)
    folder, again = store_of(docs, name, range_rows=20)
    assert [x.doc_id for x in again.select("doc_id", "start").orderBy("start").collect()] == sorted(i for i, *_ in data)
    files = sorted(f.path for f in fs.get_file_info(FileSelector(open_fs(f"{folder}/recipes")[1])) if f.path.endswith(".parquet") and "/part-" in f.path)
    import pyarrow.parquet as pq

    ids = [pq.read_table(f, columns=["doc_id"]).column(0).to_pylist() for f in files]
    assert sum(ids, []) == sorted(i for i, *_ in data) and len([x for x in ids if x]) > 1
    victim = files[ids.index(max(ids, key=len))]
    t = pq.read_table(victim)
    hidden = victim.replace("/part-", "/.part-") + ".crc"
    if os.path.exists(hidden):
        fs.delete_file(hidden)
    pq.write_table(t.set_column(t.column_names.index("start"), "start", pc.add(t.column("start"), 1)), victim)
    with pytest.raises(ValueError, match="lost or changed"):
        read(spark, folder)
    fs.delete_file(victim)
    with pytest.raises(ValueError, match="lost or changed"):
        read(spark, folder)
    assert store_of(empty, name)[1].count() == 0
    assert store_of(with_null_id(spark, data), name)[1].orderBy("start").first().doc_id is None


def test_encoder_equals_the_library():
    from quire.llm.tokens import encoder

    r = random.Random(1)
    parts = [" ", "\n", "a", "B", "'s", "'", "12", "é", ".", "!!", "\t", " ", "…", "\x1c", "中", "  ", "Σ", "İ", "́", "　", " W's"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(path(name))
        for _ in range(3000):
            t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
            assert e.ids(t) == e.whole(t), repr(t)


def test_encoder_matches_added_tokens():
    from tokenizers import Tokenizer

    from quire.llm.tokens import encoder

    r = random.Random(11)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "one", " ", "\n", "é", "W", " two", ".", "  "]
    for name, want in (("byte_bpe_50k.json", [505, 220, 50256, 734]), ("word_bpe_49k.json", [637, 49407, 1237])):
        e, library = encoder(path(name)), Tokenizer.from_file(path(name))
        assert np.frombuffer(e.ids("one <|endoftext|> two"), e.kind).tolist() == want
        for _ in range(2000):
            t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
            assert np.frombuffer(e.ids(t), e.kind).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_plain_characters():
    """Every character that the encoder cuts itself, in several places, and random mixes with any others."""
    from tokenizers import Tokenizer

    from quire.llm.tokens import PLAIN, encoder

    plain = [chr(x) for a, b in PLAIN for x in range(a, b + 1)]
    r = random.Random(13)
    texts = [f.format(c) for c in [*map(chr, range(128)), *plain] for f in ("a{0}b {0}{0} 1{0},{0} x{0}", "{0}")]
    pick = lambda: r.choice(plain) if r.random() < 0.4 else r.choice(" aB1,.'\n  s") if r.random() < 0.97 else chr(r.randint(1, 0xD7FF))
    texts += ["".join(pick() for _ in range(r.randint(0, 30))) for _ in range(10_000)]
    texts += ["a\u0558b", "\u088f x", "1\u0c5c", "\u208f", "x\U0001f6ff\U00030000"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, library = encoder(path(name)), Tokenizer.from_file(path(name))
        bad = [t for t in texts if np.frombuffer(e.ids(t), e.kind).tolist() != library.encode(t, add_special_tokens=False).ids]
        assert not bad


def test_best_fit_decreasing():
    from quire.llm.sharding import best_fit_decreasing

    r = random.Random(2)
    sizes = [r.randint(1, 60) for _ in range(1500)]
    got = best_fit_decreasing(sizes, 100)
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(x, b) for b, x in enumerate(room) if x >= sizes[i]]
        b = min(fit)[1] if fit else len(room)
        if not fit:
            room.append(100)
        room[b] -= sizes[i]
        want[i] = b
    assert got == want


def test_shards(spark, docs, data, empty):
    from quire.llm.sharding import shards

    got = shards(docs, 4).collect()
    text, seen = {i: t or "" for i, t, *_ in data}, {}
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert seen.setdefault(text[r.doc_id], r.shard) == r.shard
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert shards(empty, 4).count() == 0
    # null ids, repeated rows, cells of one row
    many = spark.createDataFrame([(None, "same" if i % 3 else None) for i in range(60)] + [(5, "x" * i) for i in range(1, 40)] * 2, "doc_id long, text string")
    got = shards(many, 3, cell_rows=1).collect()
    assert len(got) == 138 and sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(3) for k in range(sum(r.shard == s for r in got))]


def test_shards_are_even_and_tight(spark):
    """With every group an item of its own, shards equal best fit decreasing by brute force; near equal bytes, or few shards of a capacity."""
    from quire.llm.sharding import shards

    r = random.Random(21)
    texts = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 300))) for _ in range(300)]
    texts += [t for t in texts[:40] for _ in range(r.randint(1, 5))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    group: dict = {}
    for t in texts:
        group[t] = group.get(t, 0) + len(t.encode()) + 1
    total = sum(group.values())
    for n, capacity in ((5, None), (None, 3000)):
        got = {x.doc_id: x.shard for x in shards(docs, n, capacity, grain=10_000).collect()}
        room, load = capacity or -(-total // n), [0] * (n or 0)
        for size in sorted(group.values(), reverse=True):
            fit = [(room - x, b) for b, x in enumerate(load) if x + size <= room]
            if fit:
                load[min(fit)[1]] += size
            elif n:
                load[load.index(min(load))] += size
            else:
                load.append(size)
        mine: dict = {}
        for t, s in {(t, got[i]) for i, t in enumerate(texts)}:
            mine[s] = mine.get(s, 0) + group[t]
        assert sum(mine.values()) == total and sorted(mine.values()) == sorted(load)
        assert capacity is None or max(mine.values()) <= capacity
    got = {x.doc_id: x.shard for x in shards(docs, 4).collect()}
    load = [sum(len(texts[i].encode()) + 1 for i in got if got[i] == s) for s in range(4)]
    assert max(load) - min(load) < 0.02 * total


def test_mix(spark, docs, data, empty):
    from quire.llm.mixing import mix

    got = mix(docs, cell_rows=7).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in data}
    of = {i: s for i, _, _, s, *_ in data}
    total, by = sum(size.values()), {}
    for i, n in size.items():
        by[of[i]] = by.get(of[i], 0) + n
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight, capped = {s: k % 3 + 1 for k, s in enumerate(names)}, set()
    while True:
        rest = total - sum(3 * by[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * by[s] if s in capped else rest * weight[s] / open_ for s in names}
        more = {s for s in names if target[s] > 3 * by[s] + 1e-9}
        if not more:
            break
        capped |= more
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert sum(r.taken for r in got) <= total
    longest = max(size.values())
    for s in names:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= longest
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs.repartition(5), cell_rows=7).collect()), key=str)
    assert mix(empty).count() == 0
    assert mix(with_null_id(spark, data)).count() == len(data) + 2


def queue(rows, most=3):
    """Taken words of each row (id, source, size) by a plain queue in one list."""
    import hashlib

    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    by = {s: [r for r in rows if r[1] == s] for s in names}
    size = {s: sum(r[2] for r in by[s]) for s in names}
    level = lambda capped: (sum(size.values()) - sum(most * size[s] for s in capped)) / max(1, sum(k % 3 + 1 for k, s in enumerate(names) if s not in capped))
    capped: set = set()
    while more := {s for k, s in enumerate(names) if s not in capped and level(capped) * (k % 3 + 1) > most * size[s]}:
        capped |= more
    line = []
    for k, s in enumerate(names):
        target, run = float(most * size[s]) if s in capped else level(capped) * (k % 3 + 1), 0
        for i, _, n in sorted(by[s], key=lambda r: (hashlib.md5(f"mix-1{r[0]}".encode()).hexdigest(), r[0])):
            run += n
            line += [((p * size[s] + run - n / 2) / target, k, i, n) for p in range(most) if n]
    taken, total = dict.fromkeys((r[0] for r in rows), 0), 0
    for _, _, i, n in sorted(line):
        total += n
        if total > sum(size.values()):
            break
        taken[i] += n
    return taken


@pytest.mark.parametrize(("sources", "per", "words"), [(8, 7, 1), (13, 8, 1), (5, 40, 9), (1, 3, 4), (3, 1, 50)])
def test_mix_equals_a_plain_queue(spark, sources, per, words):
    from quire.llm.mixing import mix

    r = random.Random(sources)
    rows = [(i, f"s{i % sources}" if i % sources else None, 1 if words == 1 else r.randint(0, words)) for i in range(sources * per)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, s, n in rows], "doc_id long, text string, source string")
    got = mix(docs, cell_rows=5, range_rows=10).collect()
    assert {x.doc_id: x.taken for x in got} == queue(rows)
    assert sum(x.taken for x in got) <= sum(n for *_, n in rows)


def test_first_fit():
    from quire.llm.packing import first_fit

    r = random.Random(3)
    sizes = sorted((r.randint(1, 50) for _ in range(500)), reverse=True)
    used, want = [], []
    for s in sizes:
        b = next((i for i, u in enumerate(used) if u + s <= 64), len(used))
        if b == len(used):
            used.append(0)
        want.append((b, used[b]))
        used[b] += s
    assert first_fit(sizes, 64) == want


def test_pack(spark, docs, data, empty):
    from tokenizers import Tokenizer

    from quire.llm.packing import pack

    name = path("word_bpe_49k.json")
    t = Tokenizer.from_file(name)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, *_ in data}
    got = pack(docs, name, 2, length=256, group_tokens=2000).collect()
    seen: dict = {}
    for r in got:
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert len(part) == r.length and part == want[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(want[r.doc_id])
        seen.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    assert {i: sorted(x) for i, x in seen.items()} == {i: list(range(len(x))) for i, x in want.items()}
    at: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 256
    assert pack(empty, name, 2).count() == 0
    assert pack(with_null_id(spark, data), name, 2).where("start = 0").count() == len(data) + 2
    same = pack(spark.createDataFrame([(None, "w " * 50)] * 60, "doc_id long, text string"), name, 2, length=256, group_tokens=100).collect()
    assert len({x.sequence_id >> 32 for x in same}) > 10 and sum(x.length for x in same) == 60 * same[0].doc_tokens


def test_quality(spark):
    from quire.llm.quality import fit, score

    r = random.Random(4)
    good = lambda: " ".join(r.choice(["the", "of", "river", "stone", "walks", "green"]) for _ in range(r.randint(20, 300)))
    bad = lambda: good() + " " + " ".join(w.upper() + "!!" for w in good().split()[:80])
    data = [(i, bad() if i % 3 == 0 else good()) for i in range(600)] + [(None, None), (600, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), None) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = score(docs, fit(docs, labels)).collect()
    assert len(got) == len(data) and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.doc_id is not None and 400 <= x.doc_id < 600]
    assert sum((x.score >= 0.7) == (x.doc_id % 3 != 0) for x in held) >= 0.95 * len(held)
    assert score(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_quality_learns_from_all_passages(spark, monkeypatch):
    from quire.llm import quality

    seen = []
    monkeypatch.setattr(quality, "train", lambda x, counts, y: seen.append((x, counts, y)))
    data = [(i, "w " * 64 * n) for i, n in enumerate([1, 60, 3, 30, 0, 500])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    quality.fit(docs, labels)
    quality.fit(docs, labels, most_passages=100)
    assert seen[0][1].tolist() == [1, 60, 3, 30, 1, 500] and len(seen[0][0]) == 595
    assert sorted(seen[1][1].tolist()) == [1, 1, 3, 30, 60]  # whole documents only


def test_quality_reads_long_words_to_their_end():
    from quire.llm.quality import encode, train

    r = random.Random(12)
    say = lambda n: "".join(r.choice("日本語の文章を読みます川石緑") for _ in range(n))
    junk = lambda n: "".join(r.choice("日本@#9$%0") for _ in range(n))
    texts, y = [], []
    for i in range(200):
        start, end = say(200), [junk, say][i % 2]
        texts.append((start + end(r.randint(300, 4000))).encode())
        y.append(float(i % 2))
    x, counts = encode(texts, 64)
    at = int(counts[:120].sum())
    model = train(x[:at], counts[:120], np.array(y[:120], np.float32))
    assert np.mean((model.scores(x[at:], counts[120:]) >= 0.5) == np.array(y[120:])) >= 0.95
    assert encode([("é" * 200 * 65).encode()], 64)[1].tolist() == [2]


def test_attention_gradients():
    from quire.llm.quality import WIDTH, train

    r = np.random.default_rng(0)
    counts = np.array([3, 1, 2])
    x, y = r.standard_normal((6, WIDTH)).astype(np.float32), np.array([1.0, 0.0, 1.0], np.float32)
    model = train(x, counts, y, rounds=1)
    for f in ("A", "a", "V", "U", "w", "c", "b"):
        setattr(model, f, getattr(model, f).astype(np.float64))
    loss = lambda: -np.mean(y * np.log(p := model.scores(x.astype(float), counts)) + (1 - y) * np.log(1 - p))
    for w, g in zip(model.weights(), model.gradients(x.astype(float), counts, y), strict=True):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[k] += 1e-5
        up = loss()
        w[k] -= 2e-5
        down = loss()
        w[k] += 1e-5
        assert abs((up - down) / 2e-5 - g[k]) < 1e-4 + 1e-3 * abs(g[k])
    assert np.allclose(np.add.reduceat(model.attention(x, counts), [0, 3, 4]), 1)


def simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    top = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(top[a], top[b])
            if top[a] != m or top[b] != m:
                top[a] = top[b] = m
                changed = True
    return top


def test_simhash(spark, docs, data, empty):
    from quire.llm.simhash import near_groups

    got = near_groups(docs).collect()
    fp = {i: simhash(t) for i, t, *_ in data}
    linked = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2]
    want = components(fp, linked)
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (fp[i], want[i]) for i in fp}
    assert near_groups(empty).count() == 0
    assert near_groups(with_null_id(spark, data)).count() == len(data) + 2


def test_hubs_and_frequent_keys(spark):
    """Nodes and keys with thousands of rows are dealt over tasks; the result is that of plain loops."""
    from quire.llm.common import cut, join_by_key
    from quire.llm.graph import connected_components

    r = random.Random(8)
    hub = [(5000, k) for k in range(3000)] + [(k, 9000 + k) for k in range(0, 3000, 7)] + [(20_000 + k, 20_001 + k) for k in range(40)] + [(30_000, None), (7, 7)]
    r.shuffle(hub)
    got = connected_components(spark.createDataFrame(hub, "x long, y long").repartition(5), "x", "y").collect()
    edges = [(a, b) for a, b in hub if b is not None and a != b]
    assert {x.node: x.component for x in got} == components({v for e in edges for v in e}, edges) and len(got) == len({x.node for x in got})
    left = spark.createDataFrame([(k % 3 if k % 2 else k, k) for k in range(9000)] + [(None, -1)], "key long, row long")
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.max("row").alias("top")).where("key % 5 <> 3")
    tops = {x.key: x.top for x in right.collect()}
    met = join_by_key(cut(left), right, "key", "n", 9001).collect()
    assert sorted((x.row, x.key, x.top) for x in met) == sorted(((x.row, x.key, tops.get(x.key)) for x in left.collect()), key=lambda x: x[0])


@pytest.mark.parametrize(("longest", "bits"), [(0, 2), (3, 2), (5000, 2), (0, 0), (5, 1), (20, 3), (0, 7)])
def test_simhash_links(spark, longest, bits):
    """Groups of close fingerprints, and fingerprints that all share their first bytes, as a skewed index has them."""
    from quire.llm.graph import connected_components
    from quire.llm.simhash import links

    r = random.Random(6)
    centres, fps = [r.getrandbits(64) for _ in range(4)], set()
    for c in centres:
        fps |= {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(25)}
    fps |= {c & (1 << 64) - (1 << 40) ^ r.getrandbits(11) for c in centres[:2] for _ in range(30)}
    ids = {f: i for i, f in enumerate(sorted(fps))}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in ids.items()], "fp long, rep long")
    got = {r.node: r.component for r in connected_components(links(df, bits, longest), "a", "b").collect()}
    want = components(ids.values(), [(ids[a], ids[b]) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= bits])
    assert {i: got.get(i, i) for i in ids.values()} == want


@pytest.mark.parametrize("block", [8192, 5])
def test_jaccard_groups(spark, monkeypatch, block):
    """Planted copies with every few words changed, a crowd of near copies of one text, a shared passage, equal and empty texts."""
    from quire.llm import jaccard
    from quire.llm.jaccard import near_groups, shingles, similarity

    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(8)
    say = lambda n: [f"v{r.randint(0, 5000)}" for _ in range(n)]
    changed = lambda w, n: [f"z{r.random()}" if i in at else x for at in [set(r.sample(range(len(w)), n))] for i, x in enumerate(w)]
    texts, passage = [None, "", " ", "one two", "One  two", "x"], say(40)
    for _ in range(60):
        w = say(r.randint(40, 300))
        texts += [" ".join(w), " ".join(changed(w, r.randint(1, max(1, len(w) // 25)))).upper()]
    w = say(150)
    texts += [" ".join(changed(w, r.randint(0, 4))) for _ in range(60)] + [" ".join(passage + say(r.randint(5, 60))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [shingles((t or "").encode()) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if similarity(sets[a], sets[b]) >= 0.8]
    assert sum(similarity(sets[a], sets[b]) < 0.9 for a, b in linked) > 20
    got = {x.doc_id: x.component_id for x in near_groups(docs, "doc_id").collect()}
    assert got == components(range(len(texts)), linked)
    assert near_groups(docs.limit(0), "doc_id").count() == 0


@pytest.mark.parametrize("block", [8192, 3])
def test_jaccard_links_beside_the_head(spark, monkeypatch, block):
    """Postings whose head is near none of their other members, which are near each other."""
    from quire.llm import jaccard
    from quire.llm.jaccard import near_groups, shingles, similarity

    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(14)
    say = lambda n: [f"v{r.randint(0, 9000)}" for _ in range(n)]
    shared, texts = say(300), []
    texts += [" ".join(shared + say(150)) for _ in range(12)]
    for _ in range(4):
        w = shared + say(120)
        texts += [" ".join([f"z{r.random()}" if i in at else x for i, x in enumerate(w)]) for at in [set(r.sample(range(len(w)), k)) for k in (0, 1, 2, 3, 4, 5)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [shingles(t.encode()) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if similarity(sets[a], sets[b]) >= 0.8]
    assert {x.doc_id: x.component_id for x in near_groups(docs, "doc_id").collect()} == components(range(len(texts)), linked)


def test_each_close_pair_is_named_once():
    from quire.llm import jaccard as J

    r = random.Random(2)
    base, marks = [f"v{r.random()}".encode() for _ in range(80)], []
    for _ in range(60):
        at = set(r.sample(range(80), 2))
        least = J.minima(J.hashed([f"z{r.random()}".encode() if i in at else w for i, w in enumerate(base)]))
        marks.append(np.frombuffer(least.astype(np.uint8).tobytes() + J.band_keys(least).astype("<u4").tobytes(), np.uint8))
    marks, seen = np.array(marks), []
    keys = marks[:, 128:].copy().view("<u4")
    for band in range(J.BANDS):
        for key in set(keys[:, band].tolist()):
            at = np.flatnonzero(keys[:, band] == key)
            seen += [(at[q], x) for q, j in J._close(marks[at], band, lambda q, j: np.ones(len(j), bool)) for x in at[j]]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if (marks[i, :128] == marks[j, :128]).sum() >= J.AGREE and (keys[i] == keys[j]).any()}
    assert len(seen) == len(set(seen)) and set(seen) == want and len(want) > 500


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline as cp

    r = random.Random(3)
    base = [f"v{r.randint(0, 3000)}" for _ in range(200)]
    near = ["q" if i in (20, 60, 100, 140) else w for i, w in enumerate(base)]  # 20 of 196 shingles differ
    far = ["q" if i % 10 == 0 else w for i, w in enumerate(base)]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in ((7, near), (3, base), (5, far))]
    got = cp.neardup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(x.doc_id for x in got.collect()) == [3, 5]


def test_warc_round_trip(spark):
    from quire.llm.warc import archive

    r = random.Random(7)
    html = [None, "", "<p>é</p>", "<p>" + "x" * 300_000 + "</p>", *[f"<p>{r.random()}</p>" for _ in range(30)]]
    pages = [(i, f"http://s/{i}\r\nX: y" if i % 5 else None, html[i % len(html)] if i % 3 else "same", "c") for i in range(90)]
    df = spark.createDataFrame([*pages, (None, "u", "null id", "c")], "page_id long, url string, html string, _type string").repartition(4)
    _, got = archive(df, frame_bytes=2000, bundle_bytes=8000)
    top: dict = {}
    for i, _, h, _ in pages:
        top[h or ""] = max(top.get(h or "", -1), i)
    got = got.collect()
    assert len(got) == 91
    for x in got:
        if x.page_id is None:
            assert x.record_type == "response"
            continue
        h = pages[x.page_id][2] or ""
        kind = "response" if top[h] == x.page_id else "revisit"
        assert (x.record_type, x.payload_bytes, x.refers_to) == (kind, len(h.encode()), None if kind == "response" else top[h])
        assert kind == "revisit" or bytes(x.payload).decode() == h
    assert archive(df.limit(0))[1].count() == 0


@pytest.mark.parametrize(("cell", "block"), [(2048, 4096), (40, 30)])
def test_embeddings(spark, cell, block):
    from quire.llm.embedding_dedup import near_groups

    r = np.random.default_rng(8)
    base = r.standard_normal((40, 16))
    v = np.concatenate([base, base[:20] + 0.12 * r.standard_normal((20, 16)), np.repeat(base[:1], 30, 0) + 0.08 * r.standard_normal((30, 16)), base[:5], np.zeros((1, 16))])
    rows = [(i, [float(x) for x in np.float32(e)], 0 if i < 60 else i % 2) for i, e in enumerate(v)]
    rows += [(200, None, 0), (201, [1.0, None], 0), (202, [float("nan")] * 16, 0), (203, rows[0][1], None), (None, rows[0][1], 0), (204, [1.0, 2.0], 0), (205, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: x for x in near_groups(df, cell=cell, block=block).collect()}
    sound = [(i, np.array(e), k) for i, e, k in rows if i is not None and e and None not in e and k is not None and np.isfinite(e).all() and any(e)]
    linked = [(i, j) for i, a, k in sound for j, b, m in sound if i < j and k == m and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93]
    ids = [i for i, *_ in rows if i is not None]
    want = components(ids, linked)
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in ids} == {i: (sum(i in x for x in linked), want[i], want[i] == i) for i in ids}
    assert not got[None].kept
    assert near_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3000, 8 << 20])
def test_winnowing(spark, docs, data, empty, size):
    from quire.llm.winnowing import compare_edits, hashes, positions

    got = {r.doc_id: r for r in compare_edits(docs, range_bytes=size).withColumn("h", hashes(F.col("fingerprint"))).withColumn("p", positions(F.col("fingerprint"))).collect()}
    order = sorted(data, key=lambda x: x[0])
    text = {i: t or "" for i, t, *_ in data}
    words = {i: re.split(r"[\x20\x09-\x0D]+", t.strip(" \t\n\x0b\x0c\r")) for i, t in text.items()}
    turn = lambda x, n: (x << n | x >> 64 - n) & (1 << 64) - 1
    xx = lambda b: xxhash.xxh64_intdigest(b, 42)

    def grams(w):
        h = [xx(x.encode()) for x in w]
        if len(h) < 5:
            return None
        return [xx((turn(h[k], 4) ^ turn(h[k + 1], 3) ^ turn(h[k + 2], 2) ^ turn(h[k + 3], 1) ^ h[k + 4]).to_bytes(8, "little")) >> 30 for k in range(len(h) - 4)]

    def kept(h):
        signed = [x - (1 << 34) if x >> 33 else x for x in h]
        windows = [signed[k : k + 8] for k in range(max(1, len(h) - 7))]
        return {max(k + j for j, x in enumerate(w) if x == min(w)) for k, w in enumerate(windows)}

    marks = {}
    for i, w in words.items():
        h = grams(w)
        marks[i] = (sorted(kept(h)), {h[k] for k in kept(h)}) if h else ([0], set(got[i].h))
        assert len(got[i].h) == len(marks[i][1])
    short = {i: (got[i].h[0], tuple(w)) for i, w in words.items() if len(w) < 5}
    assert len(set(short.values())) == len({h for h, _ in short.values()}) == len({w for _, w in short.values()})
    for k, (i, *_) in enumerate(order):
        n = len(text[i])
        follow = order[(k + 1) % len(order)][0]
        assert got[i].edited == text[i][: n - n // 2] + text[follow][: n // 2] and got[i].n_chars == n
        assert (sorted(got[i].p), set(got[i].h)) == marks[i]
        a, b = marks[i][1], marks[follow][1]
        assert abs(got[i].near_next - len(a & b) / len(a | b)) < 1e-12
        e = grams(re.split(r"[\x20\x09-\x0D]+", got[i].edited.strip(" \t\n\x0b\x0c\r")))
        if e:
            assert [(x >> 30 & (1 << 34) - 1, (1 << 30) - 1 - (x & (1 << 30) - 1)) for x in got[i].edited_fingerprint] == [(e[k], k) for k in sorted(kept(e))]
            e = {e[k] for k in kept(e)}
            assert abs(got[i].near_edited - len(a & e) / len(a | e)) < 1e-12
    same = {}
    assert all(same.setdefault(text[i], r.fingerprint) == r.fingerprint for i, r in got.items())
    assert compare_edits(empty).count() == 0
    assert compare_edits(with_null_id(spark, data)).count() == len(data) + 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(9)
    say = lambda n: " ".join(f"v{r.randint(0, 3000)}" for _ in range(n))
    passage = say(60)
    texts = [say(r.randint(30, 200)) for _ in range(150)] + [passage + " " + say(60), say(50) + " " + passage]
    junk = [" ".join(f"{w.upper()}!!" for w in say(80).split()) for _ in range(50)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate([*texts, texts[0], texts[1], *junk])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 154), 0) for i in range(len(rows)) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in cp.STAGES] == ["quality", "neardup", "repeats", "mix", "pack"]
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        assert name == "pack" or docs.columns == cp.COLUMNS
    ids = {x.doc_id for x in kept["quality"].collect()}
    assert len(ids & set(range(154))) >= 150 and len(ids - set(range(154))) <= 2
    near = {x.doc_id for x in kept["neardup"].collect()}
    assert near == ids - {152, 153}
    after = {x.doc_id: x.text for x in kept["repeats"].collect()}
    assert after[150] == texts[150] and after[151] == " ".join(texts[151].split()[:50])
    copies = kept["mix"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies <= 3
    assert {x.doc_id for x in kept["pack"].select("doc_id").distinct().collect()} == {x.doc_id for x in kept["mix"].select("doc_id").distinct().collect()}


def test_stages_with_null_and_repeated_ids(spark):
    from collections import Counter

    import corpus_pipeline as cp

    r = random.Random(10)
    say = lambda n: " ".join(f"v{r.randint(0, 3000)}" for _ in range(n))
    same, lone, passage = say(50), say(40), say(20)
    texts = [(7, same), (7, same), (7, same), (None, same), (None, lone), (None, lone), (None, lone), (None, say(30)), (9, say(30)), (9, say(60)), (1, passage), (9, say(10) + " " + passage), (9, passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    near = cp.neardup(spark, docs, "").collect()
    assert Counter((x.doc_id, x.text) for x in near) == Counter({k for k in texts if k not in ((None, same), (9, passage))})
    lines = [(i, t) for i, t in texts if t not in (same, lone)]
    kept = cp.repeats(spark, docs.where(~F.col("text").isin(same, lone)), "").collect()
    want = [(i, " ".join(t.split()[:10]) if t.endswith(passage) and i == 9 else t) for i, t in lines if (i, t) != (9, passage)]
    assert Counter((x.doc_id, x.text, x.n_chars) for x in kept) == Counter((i, t, len(t)) for i, t in want)
    mixed = Counter((x.doc_id, x.text) for x in cp.mixed(spark, docs, "").collect())
    assert max(mixed[k] / n for k, n in Counter(texts).items()) <= 3
    assert abs(sum(len(t.split()) * n for (_, t), n in mixed.items()) - sum(len(t.split()) for _, t in texts)) <= 60

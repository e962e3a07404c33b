"""Quality classifier by attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages of `passage` words, all of them, the last one shorter. Each passage is encoded from what its words look like
(shape, hashed identity, repeats, lengths) by a learned layer; gated attention weighs the passages; the weighted sum is
scored. Only documents have labels. Labels, language, source and ids are no inputs of a score. A word of over `PIECE`
characters, as in texts without ASCII white space, counts as its pieces of that length, so all of it enters the passages.

Fitting takes at most `most` labelled documents, in the order of a hash of their id, each with all its passages, as far as
`most_passages` hold: a document that no longer fits is not learned from. That bounds the driver's part at any input size;
scoring reads every passage of every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, only

SHAPES, WORDS, EXTRA = 128, 128, 8
LEAST_STEPS, DROP, PIECE = 600, 0.3, 200
WIDTH = SHAPES + WORDS + EXTRA
_runs = re.compile(r"(.)\1+")


def _shape(word: str) -> str:
    """Letters as a or A, digits as 9, other characters as they are; runs once."""
    return _runs.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


class _Looks(dict):
    """Word -> shape bucket, word bucket, length and share of letters, in one number."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        text = word.decode()
        letters = sum(map(str.isalpha, text))
        got = self[word] = (xxhash.xxh32_intdigest(_shape(text).encode()) % SHAPES) | (xxhash.xxh32_intdigest(word.lower()) % WORDS) << 8 | min(len(text), 255) << 16 | round(100 * letters / len(text)) << 24
        return got


_looks = _Looks()


def _words(text: bytes) -> list[bytes]:
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    out = []
    for w in words:
        t = w.decode() if len(w) > PIECE else ""
        out += [t[i : i + PIECE].encode() for i in range(0, len(t), PIECE)] or [w]
    return out


def encode(texts: list[bytes], passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each text); a text without words has one passage of zeros."""
    only(_looks)
    words = [_words(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    counts = np.maximum(1, -(-n // passage))
    total = int(n.sum())
    look = np.fromiter(map(_looks.__getitem__, chain.from_iterable(words)), np.int64, total)
    base = np.cumsum(counts) - counts
    at = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    of = np.repeat(base, n) + at // passage
    m = int(counts.sum())
    size = np.bincount(of, minlength=m).astype(np.float32)
    per = np.maximum(size, 1)[:, None]
    shape = np.bincount(of * SHAPES + (look & 0xFF), minlength=m * SHAPES).reshape(m, SHAPES) / per
    word = np.bincount(of * WORDS + (look >> 8 & 0xFF), minlength=m * WORDS).reshape(m, WORDS) / per
    long, letters = look >> 16 & 0xFF, look >> 24
    again = np.zeros(total, bool)
    again[1:] = (look[1:] == look[:-1]) & (of[1:] == of[:-1])
    mean = lambda v: np.bincount(of, v, minlength=m) / per[:, 0]
    extra = np.stack([np.log1p(size), size / passage, mean(again), mean(long) / 10, mean(long > 20), mean(letters) / 100, (word > 0).sum(1) / per[:, 0], word.max(1, initial=0)], 1)
    x = np.concatenate([np.sqrt(shape), np.sqrt(word), extra], 1)
    return x.astype(np.float32), counts


@dataclass
class Model:
    """Weights: encoder (A, a), gate (V, U, w), score (c, b); mean and scale of the inputs."""

    mean: np.ndarray
    scale: np.ndarray
    A: np.ndarray
    a: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)][2:]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ self.A + self.a)
        t, s = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        e = (t * s) @ self.w
        start = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        alpha = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(alpha[:, None] * h, start, axis=0)
        return x, h, t, s, alpha, bag, z, 1 / (1 + np.exp(-(z @ self.c + self.b[0])))

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)[-1].astype(float) if len(counts) else np.zeros(0)

    def attention(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)[4]

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        x, h, t, s, alpha, bag, z, p = self.forward(x, counts)
        d = (p - y) / len(y)
        dz = d[:, None] * self.c
        dalpha = (dz[bag] * h).sum(1)
        start = np.cumsum(counts) - counts
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, start)[bag])
        dts = de[:, None] * self.w
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = alpha[:, None] * dz[bag] + dt @ self.V.T + ds @ self.U.T
        dx = dh * (1 - h * h)
        return [x.T @ dx, dx.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ d, d.sum(keepdims=True)]


def train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 32, gate: int = 16, rounds: int = 16, batch: int = 64, seed: int = 7) -> Model:
    """Adam on the log loss. The same rows in the same order give the same model. Without rows every score is 0.5."""
    rounds = max(rounds, -(-LEAST_STEPS * batch // max(1, len(y))))  # few rows are seen more often
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    mean, scale = (x.mean(0), x.std(0) + 0.05) if len(x) else (zero(WIDTH), zero(WIDTH) + 1)
    model = Model(mean, scale, draw(WIDTH, hidden), zero(hidden), draw(hidden, gate), draw(hidden, gate), draw(gate), zero(hidden), zero(1))
    weights = model.weights()
    m, v, k = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    start = np.cumsum(counts) - counts
    for i in range(rounds):
        order = r.permutation(len(y))
        rate = 3e-3 * (0.5 if i > rounds // 2 else 1) * (0.3 if i > 3 * rounds // 4 else 1)
        for j in range(0, len(order), batch):
            pick = order[j : j + batch]
            rows = np.concatenate([np.arange(start[q], start[q] + counts[q]) for q in pick])
            k += 1
            # inputs are left out at random (kept at their mean), so that no single word decides
            seen = np.where(r.random((len(rows), x.shape[1])) < DROP, mean, x[rows])
            for w, g, a, b in zip(weights, model.gradients(seen, counts[pick], y[pick]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**k) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8) + 1e-4 * w)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 4000, most_passages: int = 100_000, passage: int = 64) -> Model:
    """A model from labelled documents. Rows without id or label are not used. most, most_passages: see above."""
    pick = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("float").alias("_y"))
    pick = pick.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, counts = encode([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()], passage)
            ends = np.cumsum(counts)
            rows = [x[e - n : e].astype(np.float16).tobytes() for e, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())], names=["_id", "_y", "n", "x"])

    text = docs.select(F.col(id_col).alias("_d"), text_col)
    joined = text.join(F.broadcast(pick), F.col("_d") == F.col("_id")).select("_id", "_y", text_col)  # at most `most` rows of two numbers
    kind = dict(pick.dtypes)["_id"]
    # an id with several texts is taken once
    bags = cut(joined.mapInArrow(features, f"_id {kind}, _y float, n bigint, x binary").groupBy("_id").agg(F.min(F.struct("x", "_y", "n")).alias("r")).select("_id", "r.*"))
    total, over = 0, []
    for r in bags.select("_id", "n", F.xxhash64("_id").alias("h")).orderBy("h", "_id").collect():  # at most `most` rows of three numbers
        if total + r["n"] > most_passages:
            over.append(r["_id"])
        else:
            total += r["n"]
    rows = (bags.where(~F.col("_id").isin(over)) if over else bags).select("_id", "x", "_y").collect()
    rows.sort(key=lambda r: str(r["_id"]))
    x = [np.frombuffer(r["x"], np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows]
    counts = np.array([len(p) for p in x], np.int64)
    return train(np.concatenate(x) if x else np.zeros((0, WIDTH), np.float32), counts, np.array([r["_y"] for r in rows], np.float32))


def score(docs: DataFrame, model: Model, text_col: str = "text", passage: int = 64, out: str = "score") -> DataFrame:
    """docs plus the score (0 to 1) of each whole text, from all its passages. Null text counts as empty; empty texts have a score.

    All columns of docs stay, null or not; a column named like `out` is replaced. One row gives one row.
    """
    docs = docs.drop(out)
    kept = docs.schema
    names = [f.name for f in kept.fields]
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size does not depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 256):
                b = whole.slice(i, 256)
                x, counts = encode([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()], passage)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(x, counts))], names=[*names, out])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*kept.fields]).add(out, DoubleType()))

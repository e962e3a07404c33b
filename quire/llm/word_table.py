"""BPE ids by a table of distinct words, and texts back from ids by a table of pieces.

Encoding: Spark splits every text into words where the tokenizer's own pre-token pattern is bound to end a piece. Each input
partition gives its distinct words with their counts; a shuffle by word makes the table (word, n, partitions, ids), in which
each distinct word is encoded once by the library. The table is joined back to the words by place, partition by partition: the most frequent
words, a bounded number, are broadcast; all others go to the partitions that hold them, through one shuffle and files in the
shared folder. Texts and their ids are never shuffled, only distinct words are.

Decoding: the vocabulary as a table (id, bytes) is broadcast, its size being fixed by the tokenizer, and joined to the ids by index.

The cuts hold whatever version of a Unicode table the tokenizer uses, as they look at ASCII characters and known white space:
before a run of ASCII white space that follows a character which is no white space, and between an ASCII letter and one of
the marks , . ; : ! and ?. Texts with the content of an added token, which the library finds before it cuts, are cut at white space alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import new_folder, only, open_fs, release, slices
from quire.llm.tokens import _byte_letters

#: White space and what some engine may take for it: no cut follows these.
_BLANK = r"\s\x1c-\x1f\x85\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_SPACE = r"[ \t\n\x0b\f\r]"
#: The first character after a cut; the look behind runs only where one stands, and tries ASCII first.
AT_SPACE = rf"{_SPACE}(?<=(?:[!-~]|[^{_BLANK}]){_SPACE})"
FIRST = rf"{AT_SPACE}|[,.;:!?](?<=[A-Za-z][,.;:!?])"
_MARK = "\x01"

_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def added_tokens(path: str) -> list[str]:
    """Contents of the added tokens. ValueError for a file that is no byte-level BPE with the pattern that the cuts are made for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["normalizer"] is None
    plain = plain and model["type"] == "BPE" and not model.get("dropout") and (spec["decoder"] or {}).get("type") == "ByteLevel"
    odd = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) or not t["content"]]
    if not plain or odd:
        raise ValueError(f"{path}: not a plain byte-level BPE")
    return [t["content"] for t in spec["added_tokens"]]


def marked(text: Column, added: list[str]) -> list[Column]:
    """The text with a mark (U+0001) before each word but the first, and whether it is one word, as it has such a character of its own."""
    coarse = F.lit(False)
    for content in added:
        coarse = coarse | text.contains(content)
    whole = text.contains(_MARK)
    cut = F.when(coarse, F.regexp_replace(text, AT_SPACE, f"{_MARK}$0")).otherwise(F.regexp_replace(text, FIRST, f"{_MARK}$0"))
    return [F.when(whole, text).otherwise(cut).alias("marked"), whole.alias("whole")]


def _word_lists(b: pa.RecordBatch, each: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, lists of words) of a batch, a few megabytes of text at a time; an empty text has one empty word."""
    texts, whole = b.column("marked"), b.column("whole")
    for at, rows in slices(pc.binary_length(texts).to_pylist(), each):
        some = texts.slice(at, rows)
        if pc.any(whole.slice(at, rows)).as_py():
            yield at, pa.array([[t] if w else t.split(_MARK) for t, w in zip(some.to_pylist(), whole.slice(at, rows).to_pylist(), strict=True)], pa.list_(pa.string()))
        else:
            yield at, pc.split_pattern(some, _MARK)


_TABLE = "word string, n long, level int, parts array<int>, ids binary"


def word_table(docs: DataFrame, tokenizer: str, folder: str, text_col: str = "text") -> DataFrame:
    """Each distinct word, encoded once, written to folder: (word, n, level, parts, ids).

    ids: little-endian unsigned 32-bit; level: the logarithm of n, see frequent_from; parts: numbers of the input partitions that hold the word.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        part, held, rows = TaskContext.get().partitionId(), [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def given(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.append_column("part", pa.array(np.full(len(t), part, np.int32)))
            yield from t.select(["word", "n", "part"]).to_batches(50_000)

        for b in batches:
            for _, lists in _word_lists(b):
                counts = pc.value_counts(lists.flatten())
                held.append(pa.table([counts.field(0), counts.field(1)], names=["word", "n"]))
                rows += len(counts)
                if rows > 600_000:
                    held = [merged()]
                    rows = len(held[0])
                    if rows > 400_000:  # a large partition gives a word more than once
                        yield from given(held[0])
                        held, rows = [], 0
        if held:
            yield from given(merged())
        release()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of equal words stand side by side; the last word of a batch waits for the next one."""
        only()
        t, rest = _tokenizer(tokenizer), None

        def rows(some: pa.Table) -> pa.RecordBatch:
            word, n, part = (some.column(c).combine_chunks() for c in ("word", "n", "part"))
            first = np.flatnonzero(np.concatenate([[True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)]))
            total = np.add.reduceat(n.to_numpy(), first)
            parts = pa.ListArray.from_arrays(pa.array(np.append(first, len(word)), pa.int32()), part)
            names = word.take(pa.array(first))
            ids = [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch_fast(names.to_pylist(), add_special_tokens=False)]
            level = np.floor(np.log2(total) * 16).astype(np.int32)
            return pa.RecordBatch.from_arrays([names, pa.array(total), pa.array(level), parts, pa.array(ids, pa.binary())], names=["word", "n", "level", "parts", "ids"])

        for b in batches:
            now = pa.Table.from_batches([b])
            now = now if rest is None else pa.concat_tables([rest, now])
            if not len(now):
                continue
            word = now.column("word").combine_chunks()
            last = int(pc.sum(pc.equal(word, word[-1])).as_py())  # they are sorted
            if last < len(now):
                yield rows(now.slice(0, len(now) - last))
            rest = now.slice(len(now) - last)
        if rest is not None:
            yield rows(rest)

    split = docs.select(*marked(F.coalesce(text_col, F.lit("")), added_tokens(tokenizer)))
    counted = split.mapInArrow(distinct, "word string, n long, part int").repartition("word").sortWithinPartitions("word")
    counted.mapInArrow(encoded, _TABLE).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(_TABLE).parquet(folder)


def frequent_from(table: DataFrame, most: int, most_bytes: int) -> int:
    """The least level whose words and those of higher ones are at most `most`, in `most_bytes`; a level more than there are if none is.

    The driver gets one row a level, of which there are 16 for each doubling of n.
    """
    size = F.octet_length("word") + F.octet_length("ids") + 16
    least = 16 * 64
    for r in sorted(table.groupBy("level").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect(), reverse=True):
        most, most_bytes = most - r["n"], most_bytes - r["bytes"]
        if most < 0 or most_bytes < 0:
            break
        least = r["level"]
    return least


class _Known:
    """Words and their ids, looked up for whole batches; the library encodes a word that is not among them."""

    def __init__(self, table: pa.Table, tokenizer: str):
        self.words = table.column("word").combine_chunks()
        ids = table.column("ids").combine_chunks()
        self.sizes = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        self.ids = np.frombuffer(b"".join(ids.to_pylist()), "<u4")
        self.tokenizer = tokenizer

    def ids_of(self, lists: pa.ListArray) -> list[bytes]:
        """The ids of each list of words, put together by place."""
        flat = lists.flatten()
        places = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, ids = self.sizes, self.ids
        if len(new := np.flatnonzero(places < 0)):
            more = flat.take(pa.array(new)).dictionary_encode()
            got = [np.array(x.ids, "<u4") for x in _tokenizer(self.tokenizer).encode_batch_fast(more.dictionary.to_pylist(), add_special_tokens=False)]
            places[new] = len(sizes) + more.indices.to_numpy(zero_copy_only=False)
            sizes, ids = np.concatenate([sizes, [len(x) for x in got]]), np.concatenate([ids, *got])
        starts = (np.cumsum(sizes) - sizes)[places]
        n = sizes[places]
        ends = np.cumsum(n)
        out = ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - n), n)].astype("<u4").tobytes()
        upto = 4 * np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])]
        return [out[a:z] for a, z in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def _deal(table: DataFrame, folder: str) -> None:
    """Write the words of each input partition, with their ids, to a folder of its own."""
    rows = table.select("word", "ids", F.explode("parts").alias("part"))
    rows.repartition("part").sortWithinPartitions("part").write.partitionBy("part").option("compression", "zstd").parquet(folder)


def _dealt(folder: str, part: int) -> list[pa.Table]:
    import pyarrow.dataset as ds

    fs, path = open_fs(f"{folder}/part={part}")
    if fs.get_file_info(path).type.name != "Directory":
        return []  # all words of this partition are frequent
    return [ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["word", "ids"])]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = 400_000, most_bytes: int = 32 << 20) -> DataFrame:
    """Rows (id_col, n_tokens long, ids binary), one a row of docs: what the library's encode gives without special tokens, as little-endian unsigned 32-bit.

    most, most_bytes: bounds of the broadcast table of frequent words; they change no row. docs is read twice. Where its partitions differ the second
    time, as may be after a shuffle whose partitions Spark chooses, the library encodes words that their partition lacks again. Null or
    empty text: no ids. Null and repeated ids are rows like any other. An empty table gives an empty result. Other columns are not read.
    """
    spark, added = docs.sparkSession, added_tokens(tokenizer)
    table = word_table(docs, tokenizer, new_folder(spark, "words"), text_col)
    least, folder = frequent_from(table, most, most_bytes), new_folder(spark, "rare-words")
    held = spark.sparkContext.broadcast(table.where(F.col("level") >= least).select("word", "ids").toArrow())  # within the bounds
    _deal(table.where(F.col("level") < least), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        known = _Known(pa.concat_tables([held.value, *(t.cast(held.value.schema) for t in _dealt(folder, TaskContext.get().partitionId()))]), tokenizer)
        for b in batches:
            for at, lists in _word_lists(b):
                ids = pa.array(known.ids_of(lists), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(at, len(ids)), pc.divide(pc.binary_length(ids).cast(pa.int64()), 4), ids], names=["_id", "n_tokens", "ids"])
        release()

    split = docs.select(F.col(id_col).alias("_id"), *marked(F.coalesce(text_col, F.lit("")), added))
    return split.mapInArrow(run, f"_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids binary").withColumnRenamed("_id", id_col)


def pieces(tokenizer: str) -> pa.Array:
    """The bytes of each id, in order of ids: a token's letters stand for bytes; one with another letter stands for its text. Null: no such id."""
    byte_of = {c: b for b, c in _byte_letters().items()}
    vocabulary = _tokenizer(tokenizer).get_vocab(with_added_tokens=True)
    out: list = [None] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return pa.array(out, pa.binary())


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded plus the text of its ids, as the library's decode gives it with special tokens kept.

    Ids that the vocabulary lacks give nothing, bytes that are no UTF-8 the replacement character, null ids a null text.
    """
    added_tokens(tokenizer)
    held = encoded.sparkSession.sparkContext.broadcast(pieces(tokenizer))  # the vocabulary: fixed by the tokenizer
    names = [c for c in encoded.columns if c != out]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        table = held.value
        size = pc.fill_null(pc.binary_length(table), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(x or b"" for x in table.to_pylist()), np.uint8)
        first = np.cumsum(size) - size
        for whole in batches:
            for start, rows in slices(pc.fill_null(pc.binary_length(whole.column(ids_col)), 0).to_pylist(), 4 << 20):
                b, texts = whole.slice(start, rows), []
                for x in b.column(ids_col).to_pylist():
                    if x is None:
                        texts.append(None)
                        continue
                    ids = np.frombuffer(x, "<u4").astype(np.int64)
                    ids = ids[ids < len(size)]
                    n = size[ids]
                    ends = np.cumsum(n)
                    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[ids] - (ends - n), n)
                    texts.append(data[at].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, out])
        release()

    kinds = dict(encoded.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return encoded.select(*names).mapInArrow(join, f"{schema}, `{out}` string")

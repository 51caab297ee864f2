"""Benchmark decontamination by a Wu-Manber search over words.

Both sides are lower-cased (A-Z) and cut into words, runs of ASCII letters and digits and of
characters beyond ASCII. Every window of ten consecutive item words is a test string; an item of
fewer words is one test string. A table of bytes, addressed by the hash of a block of three words,
gives how far the search may jump; where the jump is nought, the hash of the block selects a bucket
of test strings, narrowed by the hash of the whole window, and each is compared word for word.

Test strings are slices of the items' texts, and the tables are arrays, about WINDOW_BYTES for each
window. The items are dealt to blocks of which each is built to `block_bytes` or less and broadcast.
Without more than one block, documents pass it in one scan without a shuffle; with more, each block
is another pass over a written table, so that a worker holds one block, however many items there
are, and documents are never joined with items. A block holds one item at least.

Defined cases: null and empty texts have no words and no hits; items without words, or with a null
id, are ignored; repeated rows are answered one by one; very long texts are searched whole; empty
tables give no rows or no hits; other columns are neither read nor changed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import materialize

WINDOW = 10
BLOCK = 3
WINDOW_BYTES = 64  # of the tables, for each window; measured in the tests
_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20) for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Hashes(dict):
    """Hashes of words, each computed once while the table of known words is small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def blocks_of(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every block of so many consecutive words."""
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for j in range(size if len(out) else 0):
        out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class Strings:
    """Test strings of one length: a shift table, and buckets by the hash of the last block."""

    def __init__(self, length: int, text: bytes, suffix, whole, start, stop, item, shifts):
        self.length, self.block = length, min(BLOCK, length)
        self.most = length - self.block + 1
        order = np.lexsort((start, whole, suffix))
        suffix, whole, start, stop, item = (x[order] for x in (suffix, whole, start, stop, item))
        first = np.ones(len(order), bool)  # of the windows of equal words
        first[1:] = (suffix[1:] != suffix[:-1]) | (whole[1:] != whole[:-1])
        for k in np.flatnonzero(~first):
            first[k] = text[start[k] : stop[k]] != text[start[k - 1] : stop[k - 1]]
        at = np.flatnonzero(first)
        self.suffix, self.whole, self.start, self.stop = suffix[at], whole[at], start[at], stop[at]
        self.item, self.items_from = item, np.append(at, len(order)).astype(np.int32)
        blocks, shift = shifts
        self.mask = np.uint64((1 << max(10, int(len(blocks)).bit_length() + 2)) - 1)
        self.shift = np.full(int(self.mask) + 1, self.most, np.uint8)
        np.minimum.at(self.shift, (blocks & self.mask).astype(np.int64), shift)

    def occurrences(self, text: bytes, words: list[bytes], h: np.ndarray):
        """(start, places of its items) of each test string that stands in words."""
        n, length = len(h), self.length
        if n < length:
            return
        ends = blocks_of(h, self.block)
        jumps = self.shift[(ends & self.mask).astype(np.int64)].tolist()
        whole = None
        last, k = n - self.block, length - self.block  # k: where the last block starts
        while k <= last:
            if jumps[k]:
                k += jumps[k]
                continue
            lo, hi = np.searchsorted(self.suffix, ends[k]), np.searchsorted(self.suffix, ends[k], "right")
            if lo < hi:
                whole = blocks_of(h, length) if whole is None else whole
                at = k + self.block - length
                lo, hi = lo + np.searchsorted(self.whole[lo:hi], whole[at]), lo + np.searchsorted(self.whole[lo:hi], whole[at], "right")
                for s in range(lo, hi):
                    if text[self.start[s] : self.stop[s]] == b" ".join(words[at : at + length]):
                        yield at, self.item[self.items_from[s] : self.items_from[s + 1]]
            k += 1


class WuManber:
    """Test strings grouped by length, over one text of all items' words."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        hashes = Hashes()
        self.items, texts, size = [], [], 0
        parts: dict[int, list] = {}
        for item, text in items:
            w = words(text)
            if not w:
                continue
            h, length = hashes.of(w), min(window, len(w))
            block = min(BLOCK, length)
            ends = np.cumsum([len(x) + 1 for x in w]) + size  # one beyond each word's blank
            starts = np.append(size, ends[:-1])
            count = len(w) - length + 1
            blocks = blocks_of(h, block)
            shift = np.maximum(0, length - block - np.arange(len(blocks))).astype(np.uint8)
            parts.setdefault(length, []).append((blocks[length - block :], blocks_of(h, length), starts[:count], ends[length - 1 :] - 1, np.full(count, len(self.items), np.int32), blocks, shift))
            self.items.append(item)
            texts.append(b" ".join(w) + b" ")
            size = int(ends[-1])
        self.text = b"".join(texts)
        self.by_length = []
        for length in sorted(parts):
            *cols, blocks, shift = (np.concatenate(x) for x in zip(*parts.pop(length)))
            self.by_length.append(Strings(length, self.text, *cols, (blocks, shift)))
        self.hashes = None

    def nbytes(self) -> int:
        """Size of the built tables."""
        return len(self.text) + sum(getattr(s, k).nbytes for s in self.by_length for k in ("suffix", "whole", "start", "stop", "item", "items_from", "shift"))

    def search(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, merged spans of hit words (end exclusive), items that occur."""
        if self.hashes is None:
            self.hashes = Hashes()
        w = words(text)
        h = self.hashes.of(w)
        spans, items = [], set()
        for strings in self.by_length:
            for at, found in strings.occurrences(self.text, w, h):
                spans.append((at, at + strings.length))
                items.update(found.tolist())
        return len(w), merged(spans), {self.items[k] for k in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int):
    """Broadcasts of test strings, each built to about block_bytes at most."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text")).where("item is not null and text is not null")
    n_words = F.regexp_count(F.col("text").cast("string"), F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))
    built = items.agg(F.sum(F.octet_length("text") + n_words * WINDOW_BYTES)).first()[0] or 0
    n = max(1, math.ceil(built / block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield k == n - 1, spark.sparkContext.broadcast(WuManber([(r.item, bytes(r.text)) for r in part.toLocalIterator()], window))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 256 << 20) -> DataFrame:
    """Per row of docs: id, n_words, spans (start, end of hit words) and items (sorted ids)."""
    item_type = benchmark.schema[item_col].dataType
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.lit(0).alias("n_words"), F.lit(None).cast(spans_type).alias("spans"), F.lit(None).cast(T.ArrayType(item_type)).alias("items"))
    for last, automaton in _blocks(benchmark, item_col, item_text_col, block_bytes, window):
        fields = [f for f in out.schema.fields if not last or f.name != "text"]

        def scan(batches, automaton=automaton, keep=not last):
            find = automaton.value.search
            for b in batches:
                found = [find(t) for t in b.column("text").to_pylist()]
                before = zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True)
                spans, items = [], []
                for (_, new, ids), (old, old_ids) in zip(found, before, strict=True):
                    spans.append([{"start": x, "end": y} for x, y in merged(new + [(o["start"], o["end"]) for o in old or ()])])
                    items.append(sorted(ids | set(old_ids or ())))
                cols = {"id": b.column("id"), "n_words": pa.array([n for n, _, _ in found], pa.int32())}
                cols |= {"text": b.column("text")} if keep else {}
                cols |= {"spans": pa.array(spans, b.column("spans").type), "items": pa.array(items, b.column("items").type)}
                yield pa.RecordBatch.from_pydict({n: cols[n] for n in (["id", "text"] if keep else ["id"]) + ["n_words", "spans", "items"]})

        out = out.mapInArrow(scan, T.StructType(fields))
        out = out if last else materialize(out)
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 256 << 20) -> DataFrame:
    """The rows of docs, all columns unchanged, in which no test string occurs."""
    for last, automaton in _blocks(benchmark, item_col, item_text_col, block_bytes, window):

        def clean(batches, automaton=automaton):
            find = automaton.value.search
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col)).cast(pa.large_binary()).to_pylist()
                yield b.filter(pa.array([not find(t)[1] for t in texts], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
        docs = docs if last else materialize(docs)
    return docs


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of query op9."""
    found = find_contamination(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )

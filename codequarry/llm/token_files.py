"""Token ids of documents as binary files of bit- or byte-plane shuffled, compressed blocks.

Documents are dealt by ranges of their id, so that the files, in the order of their first document,
hold all documents in ascending order. Each task streams its range: a text is encoded with the
tokenizers library piece by piece between ASCII spaces and newlines, each distinct piece once for a
batch of rows; the vocabulary's rules never look across such a character (its normaliser only folds
white space and case and composes marks, its pre-tokenizer drops white space), so the ids are those of
the whole text. A piece of Latin letters, with or without one punctuation mark behind it, is a word or
a word and a mark for the library too: such words go to its merges directly, without the passes over
each character before them (used only if a vocabulary gives all of LETTERS the same ids both ways).
`whole=True` encodes whole texts, for vocabularies of other rules.

The file format (all numbers little-endian), one file for each `file_ids` ids (or FILE_DOCS documents) or so:

    b"IDPLANE1"
    blocks        for each block of `block_ids` ids (the last of a file may be shorter): its planes,
                  each compressed with zstandard; a plane of zeros only takes no bytes
    chunk index   zstandard of: header (7 uint64: number of blocks, planes, block_ids, bits of a plane
                  (1 or 8), number of documents, number of ids, crc32 of all ids); for each block
                  uint64 offset, and for each plane uint32 bytes; for each document int64 id, uint8
                  whether the id is not null, uint64 number of ids
    uint64 place of the chunk index, b"IDPLANE1"

A plane holds one bit (or byte) of each of a block's ids, the least significant plane first, which
puts what varies little side by side. Any block can be read alone by means of the chunk index.

A task writes files under names of its own and returns a row for each; only files that the manifest
lists count, so a task that fails or runs twice leaves nothing that is read. The manifest, one row
for each file with the ids before it, is written last, by one job.

Defined cases: a null text is an empty text, of which only the end id is stored; rows with a null id
come first; rows of one id are ordered by their texts' hash, and repeated rows are stored one by one,
next to each other; very long texts are encoded whole and run over as many blocks as they need; other
columns are not read; an empty table gives a manifest without files, and no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import shared_dir

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 17
FILE_IDS = 1 << 26
FILE_DOCS = 1 << 20
LEVEL = 3  # of zstandard
PIECES = 300_000  # that a worker remembers the ids of
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"  # single characters under every normal form but the decomposed ones
WORD = re.compile(f"([{LETTERS}]+)([.,;:!?]?)")
FILES = "name string, first_id bigint, has_id boolean, first_hash bigint, nth int, n_docs bigint, n_ids bigint, bytes bigint"


def to_planes(ids: np.ndarray, bits: int) -> np.ndarray:
    """A row of bytes for each bit (or byte) of uint32 ids, the least significant first."""
    if bits == 8:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each.T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, bits: int) -> np.ndarray:
    if bits == 8:
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    each = np.unpackbits(planes, axis=1, bitorder="little", count=n)
    return np.ascontiguousarray(np.packbits(each.T, axis=1, bitorder="little")).view("<u4").reshape(-1)


class IdWriter:
    """Writes one file. Ids are appended document by document; whole blocks go out at once."""

    def __init__(self, out, bits: int, block_ids: int):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.place, self.crc, self.n_ids = len(MAGIC), 0, 0
        self.offsets, self.sizes, self.doc_ids, self.known, self.counts = [], [], [], [], []
        self.rest: list[np.ndarray] = []
        self.n_rest = 0
        out.write(MAGIC)

    def append(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their numbers of ids, and all of their ids in one array."""
        self.doc_ids += [d or 0 for d in doc_ids]
        self.known += [d is not None for d in doc_ids]
        self.counts.append(counts.astype("<u8"))
        self.crc = zlib.crc32(ids.astype("<u4").tobytes(), self.crc)
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= self.block_ids:
            all_ids = np.concatenate(self.rest)
            whole = len(all_ids) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                self._block(all_ids[at : at + self.block_ids])
            self.rest, self.n_rest = [all_ids[whole:]], len(all_ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.place)
        for plane in to_planes(ids, self.bits):
            data = self.pack.compress(plane.tobytes()) if plane.any() else b""
            self.sizes.append(len(data))
            self.out.write(data)
            self.place += len(data)

    def close(self) -> int:
        """Write the last block and the chunk index; returns the file's bytes."""
        if self.n_rest:
            self._block(np.concatenate(self.rest))
        head = np.array([len(self.offsets), 32 // self.bits, self.block_ids, self.bits, len(self.doc_ids), self.n_ids, self.crc], "<u8")
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, "<u8")
        parts = (head, np.array(self.offsets, "<u8"), np.array(self.sizes, "<u4"), np.array(self.doc_ids, "<i8"), np.array(self.known, np.uint8), counts)
        index = self.pack.compress(b"".join(p.tobytes() for p in parts))
        self.out.write(index + struct.pack("<Q", self.place) + MAGIC)
        self.out.close()
        return self.place + len(index) + 8 + len(MAGIC)


class IdReader:
    """Reads one file: its documents, and any range of its ids by the chunk index."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        place, magic = struct.unpack("<Q8s", file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC)))
        if magic != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of token ids, or cut short")
        self.unpack = zstandard.ZstdDecompressor()
        index = self.unpack.decompress(file.read_at(size - 8 - len(MAGIC) - place, place))
        n_blocks, self.n_planes, self.block_ids, self.bits, n_docs, self.n_ids, self.crc = map(int, np.frombuffer(index, "<u8", 7))
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(index, kind, n, at)
            at += got.nbytes
            return got

        self.offsets = take("<u8", n_blocks)
        self.sizes = take("<u4", n_blocks * self.n_planes).reshape(n_blocks, self.n_planes)
        self.doc_ids, self.known, self.counts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        width = 1 if self.bits == 8 else 8
        planes = np.zeros((self.n_planes, -(-n // width)), np.uint8)
        data, at = self.file.read_at(int(self.sizes[k].sum()), int(self.offsets[k])), 0
        for p, size in enumerate(self.sizes[k].tolist()):
            if size:
                planes[p] = np.frombuffer(self.unpack.decompress(data[at : at + size]), np.uint8)
            at += size
        return from_planes(planes, n, self.bits)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place `start` of the file on; only the blocks that hold them are read."""
        if not n:
            return np.zeros(0, np.uint32)
        first = start // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, (start + n - 1) // self.block_ids + 1)])
        return got[start - first * self.block_ids :][:n]

    def documents(self) -> Iterator[tuple[int, int, int]]:
        """(local start, number of ids, crc32) of each document, reading each block once; checks the file's crc32."""
        have, have_from, k, all_crc = np.zeros(0, "<u4"), 0, 0, 0
        start = 0
        for n in self.counts.tolist():
            crc, at, end = 0, start, start + n
            while at < end:
                if at >= have_from + len(have):
                    have_from, have, k = have_from + len(have), self.block(k), k + 1
                part = have[at - have_from : end - have_from].tobytes()
                crc, all_crc = zlib.crc32(part, crc), zlib.crc32(part, all_crc)
                at += len(part) // 4
            yield start, n, crc
            start = end
        if all_crc != self.crc or start != self.n_ids:
            raise ValueError("the ids of a file differ from what was written")


_WORKER: dict = {}  # of a Python worker: the loaded tokenizer, and the ids of pieces


def _tokenizer(path: str):
    if _WORKER.get("path") != path:
        from tokenizers import Tokenizer, pre_tokenizers

        t = Tokenizer.from_file(path)
        letters = [c for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c)]
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelling = str.maketrans({c: spelt.pre_tokenize_str(c.lower())[0][0] for c in letters})
        _WORKER.update(path=path, tokenizer=t, pieces={}, before={}, spelling=spelling)
        probes = [*letters, *(a + b for a in letters for b in letters), *(c + m for c in letters for m in ".,;:!?"), "".join(letters)]
        found = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(probes, add_special_tokens=False)]
        _WORKER["words"] = all(_word(m) == f for m, f in zip(map(WORD.fullmatch, probes), found, strict=True))
    return _WORKER["tokenizer"]


def _word(found: re.Match) -> bytes:
    """Ids of a word and the mark behind it, by the vocabulary's merges alone."""
    model = _WORKER["tokenizer"].model
    ids = [t.id for t in model.tokenize(found[1].translate(_WORKER["spelling"]))]
    if found[2]:
        ids += [t.id for t in model.tokenize(found[2])]
    return array("I", ids).tobytes()


def _encoded(path: str, texts: list[str], words: bool) -> list[bytes]:
    """Ids of each text as uint32 bytes. words: take pieces that are words to the merges directly."""
    t = _tokenizer(path)
    out = [_word(m) if words and _WORKER["words"] and (m := WORD.fullmatch(x)) else None for x in texts]
    others = [k for k, ids in enumerate(out) if ids is None]
    for at in range(0, len(others), 20_000):
        some = others[at : at + 20_000]
        for k, e in zip(some, t.encode_batch([texts[k] for k in some], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, "<u4").tobytes()
    return out


def encode(path: str, texts: pa.Array, end_id: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids of each text with the end id, and all ids in one array."""
    texts = pc.fill_null(texts, "")
    if whole:
        got = _encoded(path, texts.to_pylist(), False)
        piece_of, n_pieces = np.arange(len(got)), np.ones(len(texts), np.int64)
    else:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        _tokenizer(path)
        known, before, distinct = _WORKER["pieces"], _WORKER["before"], coded.dictionary.to_pylist()
        known.update((p, before[p]) for p in distinct if p in before and p not in known)
        new = [p for p in distinct if p not in known]
        known.update(zip(new, _encoded(path, new, True), strict=True))
        got = [known[p] for p in distinct]
        if len(known) > PIECES // 2:  # what is not met again until then is forgotten
            _WORKER.update(before=known, pieces={})
        piece_of, n_pieces = coded.indices.to_numpy(zero_copy_only=False), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    flat, sizes = np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4
    starts = np.cumsum(sizes) - sizes
    counts = np.add.reduceat(np.append(sizes[piece_of], 0), np.cumsum(n_pieces) - n_pieces) * (n_pieces > 0) if len(n_pieces) else np.zeros(0, np.int64)
    # each piece's ids go behind those of the pieces before it; a text's end id behind its last piece
    piece_sizes = sizes[piece_of]
    text_of = np.repeat(np.arange(len(n_pieces)), n_pieces)
    to = np.cumsum(piece_sizes) - piece_sizes + text_of
    ids = np.full(int(counts.sum()) + len(counts), end_id, "<u4")
    within = np.arange(int(piece_sizes.sum())) - np.repeat(np.cumsum(piece_sizes) - piece_sizes, piece_sizes)
    ids[np.repeat(to, piece_sizes) + within] = flat[np.repeat(starts[piece_of], piece_sizes) + within]
    return counts + 1, ids


def _rows(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most about `most` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part, at = np.cumsum(sizes) // most, 0
    for n in np.unique(part, return_counts=True)[1].tolist():
        yield batch.slice(at, n)
        at += n


def write_ids(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    bits: int = 8, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS, whole: bool = False,
) -> DataFrame:
    """Encode documents and write their ids under `folder`, which all executors see. Returns the manifest.

    tokenizer: path of a file of the tokenizers library that each executor can read. folder: a URI
    that pyarrow.fs opens (file, hdfs, s3, gs). bits: 1 for bit planes, 8 for byte planes. The
    manifest has the columns of FILES and start, the number of ids in the files before, and is also
    written to folder/manifest as Parquet; its presence says that the set of files is whole.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("id", "h").sortWithinPartitions("id", "h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, out, first, nth = "", None, (), 0

        def close() -> pa.RecordBatch:
            size = out.close()
            row = (name, *first, nth, len(out.doc_ids), out.n_ids, size)
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in FILES.split(", ")])

        for batch in (part for b in batches for part in _rows(b, 1 << 23)):
            counts, ids = encode(tokenizer, batch.column("text"), end_id, whole)
            doc_ids = batch.column("id").to_pylist()
            if out is None:
                name, first = f"{uuid.uuid4().hex}.ids", (doc_ids[0], doc_ids[0] is not None, batch.column("h")[0].as_py())
                out = IdWriter(fs.open_output_stream(f"{base}/{name}"), bits, block_ids)
            out.append(doc_ids, counts, ids)
            if out.n_ids >= file_ids or len(out.doc_ids) >= FILE_DOCS:
                yield close()
                out, nth = None, nth + 1
        if out is not None:
            yield close()

    files = dealt.mapInArrow(write, FILES).collect()  # a row for each file, as a committer has
    order = sorted(files, key=lambda r: (r.has_id, r.first_id or 0, r.first_hash, r.nth))  # a key is in one task only
    start, rows = 0, []
    for r in order:
        rows.append((*r, start))
        start += r.n_ids
    manifest = spark.createDataFrame(rows, f"{FILES}, start bigint").coalesce(1)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(f"{FILES}, start bigint").parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What the files under `folder` hold: doc_id, start, n_tokens, ids_crc32, a row for each document."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    n = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    file = IdReader(f)
                    ids, at = pa.array(file.doc_ids, mask=file.known == 0), 0
                    for some in batched(file.documents(), 10_000):
                        found = np.array(some, np.int64)
                        yield pa.RecordBatch.from_arrays([ids[at : at + len(some)], pa.array(found[:, 0] + start), pa.array(found[:, 1]), pa.array(found[:, 2])], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        at += len(some)

    files = manifest.select("name", "start").repartition(max(1, n))
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The stored ids themselves: doc_id, start, ids array<bigint>, with which training data can be read back."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    n = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    file = IdReader(f)
                    ends = np.cumsum(file.counts)
                    for at in range(0, len(ends), 1000):
                        upto = min(at + 1000, len(ends))
                        begin = int(ends[at] - file.counts[at])
                        offsets = np.concatenate([[0], ends[at:upto] - begin]).astype(np.int32)
                        values = pa.array(file.ids(begin, int(offsets[-1])).astype(np.int64))
                        lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                        ids = pa.array(file.doc_ids[at:upto], mask=file.known[at:upto] == 0)
                        yield pa.RecordBatch.from_arrays([ids, pa.array(start + begin + offsets[:-1].astype(np.int64)), lists], ["doc_id", "start", "ids"])

    files = manifest.select("name", "start").repartition(max(1, n))
    return files.mapInArrow(read, "doc_id bigint, start bigint, ids array<bigint>")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of all documents to the shared folder, and read each document's place and checksum back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/codequarry/{uuid.uuid4().hex}"
    write_ids(docs, folder, tokenizer)
    return read_documents(spark, folder)

"""Files of token ids: round trips, the ids of whole texts, and the defined cases."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest

from codequarry.llm import token_files as tf

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n\n", "Hello  world\nagain", "it's they'll 'S", "<|endoftext|> a<|startoftext|>b <|EndOfText|>", "é ́a ́", "a b c d",
    "\x1c\x1d mid\x85dle", "ΑΣ ΣΑΣ", "İstanbul ǅ", "한국 어 한", "12,345.67 and, so. on...", "\t tab\r\nline\x0bv\x0cf", "🙂 👩‍👩‍👧", "x" * 5000, "﻿bom ‍ zwj",
    "Ångström, Straße; ÀÉÎÕÜ! ŸÿØ ×÷ Ünder. ÐÞþ: ªº µm and,, and.) the?! naïve-é",
]


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 63, 64, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    planes = tf.to_planes(ids, bits)
    assert len(planes) == 32 // bits and (tf.from_planes(planes, n, bits) == ids).all()
    for k in range(32 // bits):  # a plane holds one bit or byte of each id
        want = (ids >> (k * bits)) & ((1 << bits) - 1)
        have = planes[k] if bits == 8 else np.unpackbits(planes[k], bitorder="little")[:n]
        assert (have == want).all()


@pytest.mark.parametrize("bits,block", [(8, 10), (1, 64), (1, 10), (8, 1000)])
def test_file_round_trip_and_random_access(tmp_path, bits, block):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 3, 10, 0, 95, 1, 40)]
    path, fs = str(tmp_path / "a.ids"), pyarrow.fs.LocalFileSystem()
    w = tf.IdWriter(fs.open_output_stream(path), bits, block)
    for k, d in enumerate(docs):
        w.append([k if k else None], np.array([len(d)]), d)
    size = w.close()
    everything = np.concatenate(docs)
    with fs.open_input_file(path) as f:
        assert f.size() == size
        r = tf.IdReader(f)
        assert [(s, n, c) for s, n, c in r.documents()] == [(sum(map(len, docs[:k])), len(d), zlib.crc32(d.tobytes())) for k, d in enumerate(docs)]
        assert r.known.tolist() == [0] + [1] * 6 and r.doc_ids.tolist() == list(range(7))
        for start, n in ((0, 0), (0, 149), (7, 5), (10, 10), (99, 50), (148, 1)):
            assert (r.ids(start, n) == everything[start : start + n]).all()
    data = (tmp_path / "a.ids").read_bytes()
    (tmp_path / "cut.ids").write_bytes(data[:-1])
    with fs.open_input_file(str(tmp_path / "cut.ids")) as f, pytest.raises(ValueError):
        tf.IdReader(f)


def test_ids_by_pieces_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    texts = [*ODD, *(a + s + b for a in ODD for b in ODD for s in (" ", "\n", " \n "))]
    want = [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]
    for whole in (True, False):
        counts, ids = tf.encode(VOCABULARY, pa.array(texts), 1, whole)
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    for texts in ([], [None], [None, "", "a"]):
        counts, ids = tf.encode(VOCABULARY, pa.array(texts, pa.string()), 1, False)
        assert counts.tolist() == [1 + bool(t) for t in texts] and (ids[np.cumsum(counts) - 1] == 1).all()


def test_documents_of_all_kinds(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(k * 7 % 400, f"{t} text {k % 5}") for k, t in enumerate(ODD * 30)]
    rows += [(None, "no id"), (None, None), (3, None), (3, ""), (3, "same"), (3, "same"), (9, "long word " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS id", "2 AS h", "3 AS start").repartition(6)
    folder = f"file://{tmp_path}/out"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")  # files end between batches
    try:
        manifest = tf.write_ids(docs, folder, VOCABULARY, block_ids=100, file_ids=300)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = tf.read_documents(spark, folder).orderBy("start").collect()
    assert len(got) == len(rows) and manifest.count() > 8
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert manifest.selectExpr("sum(n_ids)").first()[0] == start
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    t = Tokenizer.from_file(VOCABULARY)
    ids = lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    want = sorted((d or -1, len(i), zlib.crc32(i.tobytes())) for d, i in ((d, ids(x)) for d, x in rows))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == want
    back = tf.read_ids(spark, folder).where("doc_id = 9").orderBy("start").collect()
    assert any(r.ids == ids("long word " * 60_000).tolist() for r in back)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.write_ids(docs, f"file://{tmp_path}/none", VOCABULARY).count() == 0
    assert tf.read_documents(spark, f"file://{tmp_path}/none").count() == 0

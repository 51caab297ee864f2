"""Classifiers: held-out accuracy, defined cases, and that held-out labels play no part."""

import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from codequarry.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(labels.select("doc_id"), "doc_id").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (None, "some words"), (-3, "idiot " * 5000 + ". fine words.")], "doc_id long, text string")
    return docs.union(odd).selectExpr("*", "1 as score", "2 as id", "3 as y").cache(), labels


@pytest.mark.parametrize(("digest", "label", "n", "k", "least"), [(toxicity.toxicity_digest, "toxic", 3, 1, 0.96), (quality.quality_digest, "quality", 4, 2, 0.97)])
def test_held_out_accuracy(spark, tables, digest, label, n, k, least):
    docs, labels = tables
    rows = digest(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % n == k) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) >= least * len(held)
    # labels of held-out rows don't change any score
    changed = labels.withColumn(label, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == k, 1 - F.col(label)).otherwise(F.col(label)))
    again = {str(r.doc_id): r.score for r in digest(docs, changed).collect()}
    assert again == {str(r.doc_id): r.score for r in rows}


def test_toxicity_locates_sentences(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    text = "All is well here. You stupid idiot, you clown. The end"
    rows = spark.createDataFrame([(1, text), (2, "All is well here. The end")], "doc_id long, text string")
    a, b = sorted(toxicity.score(rows, model).collect())
    assert [text[s.start : s.end] for s in a.spans] == [" You stupid idiot, you clown"] and a.score > 0.7
    assert b.spans == [] and b.score < 0.5
    left = toxicity.drop_toxic(rows.selectExpr("*", "'x' as spans"), model)
    assert [tuple(r) for r in left.collect()] == [(2, "All is well here. The end", "x")]


@pytest.mark.parametrize(("digest", "want"), [(toxicity.toxicity_digest, 0.0), (quality.quality_digest, 0.5)])
def test_nothing_to_learn_from(spark, tables, digest, want):
    docs, labels = tables
    assert {r.score for r in digest(docs.limit(20), labels.limit(0)).collect()} == {want}
    assert digest(docs.limit(0), labels).count() == 0
    one = labels.where("toxic = 0 and quality = 1")
    assert len({r.score for r in digest(docs.limit(20), one).collect()}) == 1


def test_noisy_or_by_brute_force():
    """A document's score is 1 - the product of what its sentences leave; slopes are those of differences."""
    rng = np.random.default_rng(3)
    z, doc, y = rng.normal(-1, 2, 40), np.sort(rng.integers(0, 6, 40)), np.array([1, 0, 1, 0, 0, 1.0])
    s = toxicity.Scorer(np.zeros(toxicity.PLACES), 0.0)
    p = [s.document([(0, 0, x) for x in z[doc == d]]) for d in range(6)]
    want = [1 - np.prod(1 - 1 / (1 + np.exp(-z[doc == d]))) for d in range(6)]
    assert np.allclose(p, want)
    loss, slope = toxicity.noisy_or(z, doc, y)
    assert np.isclose(loss, -sum(np.log(q if t else 1 - q) for q, t in zip(want, y, strict=True)))
    for k in range(40):
        up, down = z.copy(), z.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert np.isclose(slope[k], (toxicity.noisy_or(up, doc, y)[0] - toxicity.noisy_or(down, doc, y)[0]) / 2e-5, rtol=1e-3, atol=1e-6)


def test_long_words_and_other_scripts():
    assert toxicity.places("x" * 40 + "a") != toxicity.places("x" * 40 + "b")
    assert len(toxicity.sentences("一つ。二つ！ तीन। four? خمسة؟ six…")) == 6


def test_score_follows_the_size_difference_alone(spark, tables):
    """One value of the difference, one score; and dictionaries of shuffled labels tell nothing."""
    docs, labels = tables
    rows = quality.quality_digest(docs, labels).collect()
    by = sorted((r.size_difference, r.score) for r in rows)
    assert all(a[1] <= b[1] for a, b in zip(by, by[1:]))
    mixed = labels.select("doc_id", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(7)) == 0, 0).otherwise(1).alias("quality"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = lambda rs: sorted((r for r in rs if r.held_out and truth.get(r.doc_id) is not None), key=lambda r: r.doc_id)
    rank = lambda rs: [r.score for r in held(rs)]
    y = [truth[r.doc_id] for r in held(rows)]

    def auc(scores):
        good, bad = ([s for s, t in zip(scores, y, strict=True) if t == k] for k in (1, 0))
        return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))

    assert auc(rank(rows)) > 0.98
    assert auc(rank(quality.quality_digest(docs, mixed).collect())) < 0.9


def test_a_giant_labelled_text_does_not_crowd_out_the_others(spark):
    labels = spark.range(60).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic", "cast(id % 2 as int) as quality")
    docs = labels.selectExpr("doc_id", "if(doc_id % 2 = 1, 'you vile scum. end', 'a kind word. end') as text").where("doc_id <> 7")
    giant = spark.createDataFrame([(7, "vile scum " * 2000)], "doc_id long, text string")
    model = toxicity.fit(docs.union(giant), labels, sample_chars=20_000)
    got = {r.doc_id: r.score for r in toxicity.score(docs.union(giant), model).collect()}
    assert min(got[k] for k in range(1, 60, 2)) > 0.5 > max(got[k] for k in range(0, 60, 2))


def test_quality_by_brute_force(spark):
    """Scores of whole small tables by plain zstandard calls, and a logistic curve fitted by plain gradient steps."""
    small = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality_digest(docs, labels).collect()}
    text = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    told = labels.where("doc_id is not null and quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    told = [(text[r.doc_id], int(r.quality)) for r in told if r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    build, rest = told[0::2], told[1::2]

    def compressor(k):
        pieces = [t[a : a + 4096] for t, y in build if y == k for a in range(0, len(t), 4096)]
        raw = b""
        for p in sorted(pieces, key=lambda p: (xxhash.xxh3_64(p).intdigest(), p)):
            if len(raw) + len(p) <= 512 * 1024:
                raw += p
        made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=9)
        return zstandard.ZstdCompressor(level=9, dict_data=made)

    good, bad = compressor(1), compressor(0)
    diff = lambda t: (len(bad.compress(t)) - len(good.compress(t))) / (len(t) + 1)
    x, y = np.array([diff(t) for t, _ in rest]), np.array([y for _, y in rest])
    scale = x.std() + 1e-9
    a = b = 0.0
    rate = 1 / (0.25 * ((x / scale) ** 2 + 1).sum() + 1)
    for _ in range(20_000):
        miss = 1 / (1 + np.exp(-(a * x / scale + b))) - y
        a, b = a - rate * ((miss * x / scale).sum() + a), b - rate * (miss.sum() + b)
    assert len(got) == len(text) > 500
    for i, t in text.items():
        assert np.isclose(got[i].size_difference, diff(t), atol=1e-12)
        assert np.isclose(got[i].score, 1 / (1 + np.exp(-(a * diff(t) / scale + b))), atol=1e-6)

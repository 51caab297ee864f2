"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a logistic model over its
distinct words; they are combined by noisy-or: a document is toxic unless none of its sentences is.
Sentences end at line breaks and at the full stops, question and exclamation marks of several scripts.
Only documents are labelled, so the weights are learnt through the noisy-or, and the sentence
probabilities then say where the offence stands.

A word's weight is the sum over the word and its prefixes of 3 to 7 characters, each hashed to one
of 2**20 places. Weights are learnt on at most `sample_docs` labelled rows with at most
`sample_chars` characters in all, those that come first by a hash of the id. All rows are scored,
in one pass without a shuffle; the model that is broadcast has a fixed size.

Defined cases: null and empty texts have no sentences and score 0; very long texts are scored
whole, sentence by sentence; repeated rows are scored one by
one; labels that are null or belong to no row are ignored; if no row may be learnt from, or all
have one label, every score is 0; other columns are neither read nor changed.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import fold, labelled_sample

PLACES = 1 << 20
PREFIXES = range(3, 8)
BLOCK_WORDS = 400_000
_SENTENCE = re.compile("[.!?\n\u2026\u3002\uff01\uff1f\uff0e\u061f\u06d4\u0964\u0965]+")
_WORD = re.compile(r"\w+")


def places(word: str) -> list[int]:
    """Where the weights of a word stand."""
    parts = ["=" + word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(p) % PLACES for p in parts]


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of each sentence that has words."""
    out, at = [], 0
    low = text or ""
    for m in [*_SENTENCE.finditer(low), None]:
        end = m.start() if m else len(low)
        if end > at and (words := set(_WORD.findall(low[at:end].lower()))):
            out.append((at, end, words))
        at = m.end() if m else at
    return out


def _blocks(words_to: np.ndarray) -> list[int]:
    """Where to cut the documents, so that a block holds some words only."""
    cuts = [0]
    while cuts[-1] < len(words_to):
        before = words_to[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(words_to, before + BLOCK_WORDS, "right"))))
    return cuts


def noisy_or(z: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Of sentences' logits: the documents' loss, and its slope by each logit."""
    total = np.bincount(doc, np.logaddexp(0, z), len(y))  # -log P(no sentence is toxic)
    less = np.maximum(np.expm1(np.minimum(total, 50)), 1e-6)
    loss = np.where(y == 1, total - np.log(less), total).sum()
    slope = np.where(y == 1, -1 / less, 1.0)
    return float(loss), slope[doc] / (1 + np.exp(-z))


def learn(bags, rounds: int = 100, rate: float = 0.1, shrink: float = 1.5e-4, refit: int = 40, settled: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias from (sentences as words, label) by proximal gradient steps.

    The last refit rounds no longer shrink the weights, of which they keep those at nought there.
    Either phase ends early once ten rounds lower the loss by less than the share settled.
    """
    ids: dict[str, int] = {}
    label = array("b")
    word, sentence, doc = array("i"), array("i"), array("i")
    for d, (bag, y) in enumerate(bags):
        label.append(y)
        for words in bag:
            doc.append(d)
            for w in sorted(words):
                word.append(ids.setdefault(w, len(ids)))
                sentence.append(len(doc) - 1)
    weights, bias = np.zeros(PLACES), -6.0
    y = np.array(label, np.float64)
    if not doc or len(set(label)) < 2:
        return weights, -math.inf
    word, sentence, doc = (np.array(x, np.int32) for x in (word, sentence, doc))
    own, feature = array("i"), array("i")
    for w, k in ids.items():
        p = places(w)
        own.extend([k] * len(p))
        feature.extend(p)
    n_words = len(ids)
    del ids
    own, feature = np.array(own, np.int32), np.array(feature, np.int32)
    used, feature = np.unique(feature, return_inverse=True)
    w = np.zeros(len(used))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    ends = np.searchsorted(doc, np.arange(1, len(y) + 1))  # of each document's sentences
    words_to = np.searchsorted(sentence, ends)
    cuts = _blocks(words_to)
    t = 0
    for shrinking, most in ((True, rounds), (False, refit)):
        losses: list[float] = []
        while len(losses) < most and not (len(losses) > 10 and losses[-11] - losses[-1] < settled * losses[-11]):
            t += 1
            of_word = np.bincount(own, w[feature], n_words)
            by_word, gb, loss = np.zeros(n_words), 0.0, 0.0
            for d0, d1 in zip(cuts, cuts[1:]):
                s0, s1 = ends[d0 - 1] if d0 else 0, ends[d1 - 1]
                w0, w1 = words_to[d0 - 1] if d0 else 0, words_to[d1 - 1]
                z = np.bincount(sentence[w0:w1] - s0, of_word[word[w0:w1]], s1 - s0) + bias
                part, dz = noisy_or(z, doc[s0:s1] - d0, y[d0:d1])
                by_word += np.bincount(word[w0:w1], dz[sentence[w0:w1] - s0], n_words)
                gb, loss = gb + dz.sum(), loss + part
            losses.append(loss / len(y) + (shrink * float(np.abs(w).sum()) if shrinking else 0))
            g, gb = np.bincount(feature, by_word[own], len(used)) / len(y), gb / len(y)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
            new = w - step * m / (1 - 0.9**t)
            w = np.sign(new) * np.maximum(np.abs(new) - step * shrink, 0) if shrinking else np.where(w == 0, 0, new)
            bias -= rate * mb / (1 - 0.9**t) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-4)
    weights[used] = w
    return weights, float(bias)


class Weights(dict):
    """Weights of words, each computed once while the table of known words is small."""

    def __init__(self, weights: np.ndarray, most: int = 500_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, w: str) -> float:
        if len(self) > self.most:
            self.clear()
        found = self[w] = float(self.weights[places(w)].sum())
        return found


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weight, self.bias = Weights(weights), bias

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, logit) of each sentence; the sum does not depend on the order of its words."""
        weight = self.weight.__getitem__
        return [(a, b, self.bias + math.fsum(map(weight, words))) for a, b, words in sentences(text)]

    def document(self, found: list[tuple[int, int, float]]) -> float:
        return -math.expm1(-sum(math.log1p(math.exp(z)) if z < 30 else z for _, _, z in found if z > -40))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 8000, sample_chars: int = 16_000_000):
    """A broadcast model. may_learn is a condition on the column id of the labels."""
    rows = labelled_sample(docs, labels, label, F.lit(True) if may_learn is None else may_learn, id_col, text_col, sample_docs, sample_chars)
    weights, bias = learn(([w for _, _, w in sentences(t)], y) for t, y in rows)
    return docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", offence: float = 0.5) -> DataFrame:
    """Per row: id, score, and spans (start, end, p) of sentences with p of at least offence."""
    least = math.log(offence / (1 - offence))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])

    def run(batches):
        scorer = Scorer(*model.value)
        for b in batches:
            found = [scorer.sentences(t) for t in b.column("text").to_pylist()]
            spans = [[{"start": x, "end": y, "p": 1 / (1 + math.exp(-min(z, 700)))} for x, y, z in f if z >= least] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "score": pa.array([scorer.document(f) for f in found], pa.float64()), "spans": pa.array(spans, kind)})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model, text_col: str = "text", reject: float = 0.7) -> DataFrame:
    """The rows of docs, all columns unchanged, that score less than reject."""

    def clean(batches):
        scorer = Scorer(*model.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([scorer.document(scorer.sentences(t)) < reject for t in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op2; rows of fold 1 of 3 are held out."""
    model = fit(docs, labels, fold(F.col("id"), 3) != 1)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("spans").alias("offending"))

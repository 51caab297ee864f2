"""Quality classification by compression with two zstandard dictionaries.

One dictionary is built from good and one from bad labelled texts: pieces of the whole texts, in
the order of their hashes, up to `dictionary_bytes`. A text that is like the good ones is shortened
more by the good dictionary. The difference of the two compressed sizes over the text's length is
all that the score is made of: a logistic curve calibrates it to a probability.

The dictionaries are built on one half and the calibration is fitted on the other half of at most
`sample_docs` labelled rows with at most `sample_chars` characters in all, those that come first by
a hash of the id; texts of more than an eighth of `sample_chars` are passed over. All rows are
scored whole, in one pass without a shuffle; what is broadcast has a fixed size.

Defined cases: null counts as empty; an empty text has the score of no difference; very long texts
are compressed whole; repeated rows are scored one by one; labels that are null or belong to no row
are ignored; if the rows that may be learnt from have one label or none, every score is the share of
label 1 (0.5 if there is none); other columns are neither read nor changed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import fold, labelled_sample

LEVEL = 9
PIECE = 4096  # bytes of a text that enter a dictionary together


def dictionary(texts: list[bytes], dictionary_bytes: int) -> bytes:
    """Pieces of all texts, in the order of their hashes, as many as there is room for."""
    pieces = sorted((t[k : k + PIECE] for t in texts for k in range(0, len(t), PIECE)), key=lambda p: (xxhash.xxh3_64_intdigest(p), p))
    out, n = [], 0
    for p in pieces:
        if n + len(p) <= dictionary_bytes:
            out.append(p)
            n += len(p)
    return b"".join(out)


class Sizes:
    """The normalised difference of a text's compressed sizes with the bad and the good dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for d in (good, bad):
            made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(d) >= 8 else None
            if made:
                made.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made) if made else zstandard.ZstdCompressor(level=LEVEL))

    def difference(self, text: bytes) -> float:
        good, bad = (len(c.compress(text)) for c in self.by)
        return (bad - good) / (len(text) + 1)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a ridge logistic curve, by Newton steps."""
    spread = x.std() + 1e-9
    z = np.c_[x / spread, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(hessian, z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1])


def learn(rows: list[tuple[bytes, int]], dictionary_bytes: int = 1 << 19) -> dict:
    build, rest = rows[::2], rows[1::2]
    y = np.array([y for _, y in rest], float)
    if len(set(y)) < 2 or len({y for _, y in build}) < 2:
        return {"share": float(np.mean([y for _, y in rows])) if rows else 0.5}
    good, bad = (dictionary([t for t, y in build if y == k], dictionary_bytes) for k in (1, 0))
    sizes = Sizes(good, bad)
    slope, offset = calibrate(np.array([sizes.difference(t) for t, _ in rest]), y)
    return {"good": good, "bad": bad, "slope": slope, "offset": offset}


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 8000, sample_chars: int = 32_000_000, dictionary_bytes: int = 1 << 19):
    """A broadcast model. may_learn is a condition on the column id of the labels."""
    rows = labelled_sample(docs, labels, label, F.lit(True) if may_learn is None else may_learn, id_col, text_col, sample_docs, sample_chars)
    return docs.sparkSession.sparkContext.broadcast(learn([(t.encode(), y) for t, y in rows], dictionary_bytes))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score and size_difference (over the text's length)."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("size_difference", T.DoubleType())])

    def run(batches):
        m = model.value
        sizes = None if "share" in m else Sizes(m["good"], m["bad"])
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            d = np.array([sizes.difference(t) if sizes else 0.0 for t in texts])
            p = 1 / (1 + np.exp(-np.clip(d * m["slope"] + m["offset"], -30, 30))) if sizes else np.full(len(texts), m["share"])
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "score": pa.array(p, pa.float64()), "size_difference": pa.array(d, pa.float64())})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op10; rows of fold 2 of 4 are held out."""
    model = fit(docs, labels, fold(F.col("id"), 4) != 2)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "size_difference")

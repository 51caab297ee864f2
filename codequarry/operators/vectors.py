"""Vector search by exact cosine, and answers put together from its hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.functions import cosine, has
from codequarry.operators.tables import keep_last

Encoder = Callable[[list[str]], "np.ndarray"]


def hashing_encoder(texts: list[str], size: int = 64) -> np.ndarray:
    """Unit vectors of hashed words: a deterministic stand-in where no embedding model is installed."""
    out = np.zeros((len(texts), size))
    for k, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = xxhash.xxh3_64_intdigest(w)
            out[k, h % size] += 1 - 2 * ((h >> 32) & 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def encode(df: DataFrame, encoder: Encoder, text_col: str = "text") -> DataFrame:
    """df with an embedding of each row's text."""
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = encoder(b.column(b.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v.astype(np.float32) for v in vectors], pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return df.mapInArrow(run, schema)


def index_chunks(current: DataFrame | None, chunks: DataFrame, encoder: Encoder) -> DataFrame:
    """The index with the chunks put in: of equal ids the last one, new ones in place of old ones."""
    new = encode(keep_last(chunks, "id"), encoder)
    if current is None:
        return new
    return current.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)


def search(index: DataFrame, vector: list[float], limit: int = 10, id_col: str = "id", kind: tuple[str, object] | None = None, repo: tuple[str, str] | None = None) -> DataFrame:
    """The nearest rows, with similarity rounded to 4 places; a scan and a top-k."""
    df = index.where(F.col(kind[0]) == kind[1]) if kind else index
    df = df.where(has(*repo)) if repo else df
    at = F.array(*[F.lit(float(x)) for x in vector])
    near = df.withColumn("similarity", F.round(cosine(F.col("embedding"), at), 4))
    return near.orderBy(F.desc_nulls_last("similarity"), id_col).limit(limit)


def similar_to(index: DataFrame, item, limit: int = 5, id_col: str = "id") -> DataFrame:
    """The rows nearest to a stored one, which is left out; none if it isn't there."""
    own = index.where(F.col(id_col) == item).select(F.col("embedding").alias("__own")).limit(1)
    near = index.where(F.col(id_col) != item).crossJoin(F.broadcast(own))  # one row
    near = near.withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("__own")), 4)).drop("__own")
    return near.orderBy(F.desc_nulls_last("similarity"), id_col).limit(limit)


def ask(hits: DataFrame, id_col: str = "id", least: float = 0.3) -> DataFrame:
    """One row: the texts of hits of more than the least similarity, best first, and the number of all hits."""
    good = F.when(F.col("similarity") > least, F.struct((-F.col("similarity")).alias("o"), F.col(id_col).alias("i"), F.col("text")))
    parts = F.transform(F.array_sort(F.collect_list(good)), lambda x: x["text"])
    return hits.agg(F.array_join(parts, "\n\n---\n\n").alias("context"), F.count("*").alias("result_count"))


def stats(index: DataFrame, kind: str, id_col: str = "id", most: int | None = None) -> DataFrame:
    """Numbers by kind over all rows, or over the first ones by id if their number is given."""
    rows = index if most is None else index.orderBy(id_col).limit(most)
    return rows.groupBy(kind).agg(F.count("*").alias("count"))

"""A stored vector collection: an inverted file of cells, searched by reading the nearest cells only.

Cells are learnt by k-means on unit vectors. The collection is a versioned store: `vectors` has each row
in the files of its cell, so that a search lists and reads only the cells it needs; `cells` has their
centres, sizes and widest angles. Hits are ranked by exact cosine.

The number of cells that a search reads (`probes`) is measured when cells are learnt: the least that
gives `recall` of the true nearest for stored vectors taken as queries. An exact search goes on
from there: by the triangle inequality of angles no vector of a cell is nearer to the query than the
cell's centre less its widest angle, so only cells that can still hold a hit are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.functions import cosine
from codequarry.operators.tables import keep_last
from codequarry.sources.versions import PART, Change, State, Store

MOST_CELLS = 16_384  # their centres go to all tasks
SAMPLE_PER_CELL = 256  # rows that k-means learns from
NO_CELL = -1  # of vectors without a direction: null, zero, or not finite
ASKED = 64  # stored vectors that the number of probes is measured with
NEAR = 10
ROWS, QUERIES = 4096, 8192  # of a cell, and of the queries sent to it, that one group multiplies
AT_A_TIME = 1 << 22  # products, or numbers of vectors, that a task holds at a time
NEARLY = 1e-12  # more than products of unit vectors are off by


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Unit rows; those without a direction are NaN."""
    out = np.full((len(column), size), np.nan)
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False)
    if fits.any():
        flat = column.filter(pa.array(fits)).flatten()
        out[fits] = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(np.isfinite(norm) & (norm > 0), out / norm, np.nan)


def _angle(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1, 1))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of vectors that all have a direction."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What functions.cosine gives for each pair of rows: sums run from the first entry to the last, so that not a bit differs."""
    dot = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]
    norm = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
    with np.errstate(all="ignore"):
        return np.where(norm > 0, dot(a, b) / norm, np.nan)


def _best(limit: int):
    """A group's rows and queries to each query's best rows by cosine, then by id."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["__q", "__k", "similarity"]
        if not len(rows) or not len(asked):
            return pa.table([asked["__q"].slice(0, 0), rows["__k"].slice(0, 0), pa.array([], pa.float64())], names=names)
        rows = rows.take(pc.sort_indices(rows["__k"], null_placement="at_start"))
        x, q = _vectors(rows["__x"]), _vectors(asked["__v"])
        # of equal vectors, no more than the first by id can be hits
        _, same = np.unique(x.view(f"V{x.shape[1] * 8}")[:, 0], return_inverse=True)
        order = np.argsort(same, kind="stable")
        nth = np.arange(len(x)) - np.searchsorted(same[order], same[order])
        kept = np.sort(order[nth < limit])
        x, ux, uq, k = x[kept], _unit(x[kept]), _unit(q), min(limit, len(kept))
        who, at, sim = [], [], []
        for part in np.array_split(np.arange(len(q)), max(1, len(q) * len(x) // AT_A_TIME)):
            dots = uq[part] @ ux.T
            least = np.partition(dots, len(x) - k, axis=1)[:, len(x) - k] - NEARLY
            w, a = np.nonzero(dots >= least[:, None])
            pieces = np.array_split(np.arange(len(w)), max(1, len(w) * x.shape[1] // AT_A_TIME))
            c = np.concatenate([_cosines(x[a[p]], q[part[w[p]]]) for p in pieces])
            order = np.lexsort((a, -c, w))
            w, a, c = w[order], a[order], c[order]
            top = np.arange(len(w)) - np.searchsorted(w, w) < limit
            who.append(part[w[top]])
            at.append(kept[a[top]])
            sim.append(c[top])
        sim = np.concatenate(sim)
        return pa.table([asked["__q"].take(pa.array(np.concatenate(who))), rows["__k"].take(pa.array(np.concatenate(at))), pa.array(sim, mask=np.isnan(sim))], names=names)

    return run


def learn_cells(rows: DataFrame, vec_col: str, cells: int | None = None, seed: int = 1) -> np.ndarray:
    """Unit centres of cells; as many as the root of the number of rows, unless given.

    K-means sees at most SAMPLE_PER_CELL rows for each cell, picked by a hash; every row gets a cell.
    """
    v = F.col(vec_col)
    good = rows.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    good = good.where(F.exists(v, lambda c: c != 0)).select(v.cast("array<double>").alias("v"))
    n = good.count()
    if not n:
        return np.zeros((0, 0))
    size = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first().size
    k = min(cells or max(1, round(n**0.5)), MOST_CELLS, n)
    share = min(1.0, SAMPLE_PER_CELL * k / n)
    sample = good.where(F.size("v") == size).where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < share * 1_000_000)
    if k == 1:
        return _unit(np.array(good.where(F.size("v") == size).first().v)[None])
    model = KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    centres = _unit(np.array(model.clusterCenters()))
    return centres[np.isfinite(centres).all(1)]


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _in_cells(rows: DataFrame, vec_col: str, centres: np.ndarray) -> DataFrame:
    """rows with their cell as _part, and the angle to its centre."""
    schema = T.StructType([*rows.schema.fields]).add(PART, "integer").add("_angle", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(b.schema.get_field_index(vec_col)), centres.shape[1])
            cell, angle = np.full(len(x), NO_CELL, np.int32), np.zeros(len(x))
            good = np.isfinite(x).all(1)
            if len(centres) and good.any():
                for at in np.array_split(np.flatnonzero(good), max(1, len(x) * len(centres) >> 22)):
                    dots = x[at] @ centres.T
                    cell[at] = dots.argmax(1)
                    angle[at] = _angle(dots.max(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], names=schema.names)

    return rows.mapInArrow(run, schema)


class Collection:
    """Rows with an id and a vector, and whatever columns else, stored under a folder."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.store = spark, Store(spark, folder)
        self.state = self.store.state(version)
        self.meta = self.state.meta
        if self.state.version:
            rows = self.store.read("cells", self.state).orderBy("cell").collect()  # at most MOST_CELLS
            self.cell_ids = np.array([r.cell for r in rows if r.cell != NO_CELL], int)
            self.centres = np.array([r.centre for r in rows if r.cell != NO_CELL]).reshape(len(self.cell_ids), -1 if len(self.cell_ids) else 0)
            self.widest = np.array([r.widest for r in rows if r.cell != NO_CELL])
            self.sizes = np.array([r.n for r in rows if r.cell != NO_CELL], int)

    # building ----------------------------------------------------------------------------

    @classmethod
    def build(cls, rows: DataFrame, folder: str, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None, recall: float = 0.97, order: str | None = None) -> Collection:
        """Learn cells and store rows; of equal ids the last by order, or any one."""
        spark, store = rows.sparkSession, Store(rows.sparkSession, folder)
        rows = keep_last(rows, id_col, order=order) if order else rows.dropDuplicates([id_col])
        centres = learn_cells(rows, vec_col, cells)
        meta = {"id": id_col, "vector": vec_col, "recall": recall}
        known = np.arange(len(centres))

        def rest(state: State) -> tuple[dict[str, Change], dict]:
            return {"cells": Change(_cells(store, state, centres, known))}, {"probes": _probes(store, state, centres, known)}

        store.commit({"vectors": Change(_in_cells(rows, vec_col, centres))}, meta=meta, then=(rest,))
        return cls(spark, folder)

    def upsert(self, rows: DataFrame, order: str | None = None) -> Collection:
        """Rows in place of stored ones of the same ids; only the cells that lose or gain rows are written anew."""
        key, vec = self.meta["id"], self.meta["vector"]
        rows = keep_last(rows, key, order=order) if order else rows.dropDuplicates([key])
        new = _in_cells(rows, vec, self.centres)
        old_places = self.store.read("vectors", self.state).select(key, PART).join(rows.select(key), key, "left_semi")
        touched = [r[0] for r in old_places.select(PART).union(new.select(PART)).distinct().collect()]  # numbers of cells
        kept = self.store.read("vectors", self.state, touched).join(rows.select(key), key, "left_anti")
        cells = lambda state: ({"cells": Change(_cells(self.store, state, self.centres, self.cell_ids))}, {})
        self.store.commit({"vectors": Change(kept.select(*new.columns).unionByName(new), touched)}, self.state, then=(cells,))
        return Collection(self.spark, self.store.folder)

    # reading -----------------------------------------------------------------------------

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        return self.store.read("vectors", self.state, cells)

    def nearest_cells(self, vector: list[float], n: int) -> list[int]:
        if not len(self.cell_ids):
            return []
        q = _unit(np.array([vector], float))[0]
        return self.cell_ids[np.argsort(-(self.centres @ q), kind="stable")[:n]].tolist()

    def search(self, vector: list[float], limit: int = 10, probes: int | None = None, where: F.Column | None = None) -> DataFrame:
        """The nearest rows of the nearest cells, with their similarity in double precision."""
        return self._top(self.rows(self.nearest_cells(vector, probes or self.meta["probes"])), vector, limit, where)

    def search_exact(self, vector: list[float], limit: int = 10, where: F.Column | None = None) -> DataFrame:
        """The nearest of all rows; a second search reads the cells that the first one doesn't rule out."""
        first = self.nearest_cells(vector, self.meta["probes"])
        if not first:
            return self._top(self.rows([]), vector, limit, where)
        found = self._top(self.rows(first), vector, limit, where).select("similarity").collect()
        q = _unit(np.array([vector], float))[0]
        least = _angle(self.centres @ q) - self.widest
        worst = _angle(np.array(found[-1].similarity)) if len(found) == limit else np.inf
        more = self.cell_ids[least <= worst + 1e-9].tolist()
        return self._top(self.rows(sorted({*first, *more})), vector, limit, where)

    def search_many(self, queries: DataFrame, limit: int = 10, probes: int | None = None, query_id: str = "query_id", query_vec: str = "query") -> DataFrame:
        """The nearest rows for each of many queries: query_id, id, similarity, rank.

        Queries are sent to their nearest cells, or to all rows at once if all cells are read. The rows of a cell and its
        queries are dealt into blocks of a bounded size by a hash; each pair of blocks is one group, which multiplies
        them and keeps a query's best rows, before these are gathered.
        """
        key, vec, n = self.meta["id"], self.meta["vector"], probes or self.meta["probes"]
        centres, ids = self.centres, self.cell_ids
        whole = n >= len(ids)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1), centres.shape[1])
                good = np.flatnonzero(np.isfinite(x).all(1))
                for at in np.array_split(good, max(1, len(good) * len(ids) // AT_A_TIME)):
                    cells = np.zeros((len(at), 1), int) if whole else ids[np.argsort(-(x[at] @ centres.T), axis=1, kind="stable")[:, :n]]
                    row = pa.array(np.repeat(at, cells.shape[1]))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(cells.reshape(-1).astype(np.int32))], ["__q", "__v", PART])

        asked = queries.select(F.col(query_id).alias("__q"), F.col(query_vec).alias("__v"))
        routed = asked.mapInArrow(route, T.StructType([*asked.schema.fields]).add(PART, "integer"))
        sent = {r[PART]: r["count"] for r in routed.groupBy(PART).count().collect()}  # at most MOST_CELLS
        held = {0: int(self.sizes.sum())} if whole else dict(zip(ids.tolist(), self.sizes.tolist(), strict=True))
        blocks = [(c, -(-max(held[c], 1) // ROWS), -(-m // QUERIES)) for c, m in sent.items()]
        blocks = F.broadcast(self.spark.createDataFrame(blocks, f"{PART} int, __rows int, __queries int"))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self.rows().where(F.col(PART) != NO_CELL).select(F.col(key).alias("__k"), F.col(vec).alias("__x"), (F.lit(0) if whole else F.col(PART)).alias(PART))
        rows = rows.join(blocks, PART).select(PART, deal("__k", "__rows").alias("__r"), every("__queries").alias("__s"), "__k", "__x")
        routed = routed.join(blocks, PART).select(PART, every("__rows").alias("__r"), deal("__q", "__queries").alias("__s"), "__q", "__v")
        found = T.StructType([T.StructField("__q", asked.schema["__q"].dataType), T.StructField("__k", rows.schema["__k"].dataType), T.StructField("similarity", T.DoubleType())])
        pair = (PART, "__r", "__s")
        best = rows.groupBy(*pair).cogroup(routed.groupBy(*pair)).applyInArrow(_best(limit), found)
        rank = F.row_number().over(Window.partitionBy("__q").orderBy(F.desc("similarity"), "__k"))
        return best.withColumn("rank", rank).where(F.col("rank") <= limit).withColumnsRenamed({"__q": query_id, "__k": key})

    def similar_to(self, item, limit: int = 5, exact: bool = False) -> DataFrame:
        """The rows nearest to a stored one, without it; none if it isn't there."""
        key, vec = self.meta["id"], self.meta["vector"]
        own = self.rows().where(F.col(key) == item).select(vec).first()
        if own is None or own[0] is None:
            return self._top(self.rows([]), [0.0], limit, None)
        return (self.search_exact if exact else self.search)(list(own[0]), limit, where=F.col(key) != item)

    def stats(self) -> DataFrame:
        """Rows of each cell."""
        return self.store.read("cells", self.state).select("cell", "n", "widest")

    def _top(self, rows: DataFrame, vector: list[float], limit: int, where: F.Column | None) -> DataFrame:
        rows = rows if where is None else rows.where(where)
        at = F.array(*[F.lit(float(x)) for x in vector])
        near = rows.withColumn("similarity", cosine(F.col(self.meta["vector"]), at)).drop(PART, "_angle")
        return near.orderBy(F.desc_nulls_last("similarity"), self.meta["id"]).limit(limit)


def _cells(store: Store, state: State, centres: np.ndarray, ids: np.ndarray) -> DataFrame:
    """The table of cells: every centre, with the number of its rows and their widest angle."""
    spark = store.spark
    found = {r[PART]: r for r in store.read("vectors", state).groupBy(PART).agg(F.count("*").alias("n"), F.max("_angle").alias("widest")).collect()}
    rows = [(int(k), c.tolist(), int(found[k].n) if k in found else 0, float(found[k].widest) if k in found else 0.0) for k, c in zip(ids.tolist(), centres, strict=True)]
    if NO_CELL in found:
        rows.append((NO_CELL, [], int(found[NO_CELL].n), 0.0))
    return spark.createDataFrame(rows, "cell int, centre array<double>, n bigint, widest double").withColumn(PART, F.lit(0))


def _probes(store: Store, state: State, centres: np.ndarray, ids: np.ndarray) -> int:
    """The least number of cells that gives the recall asked for, for a sample of stored vectors."""
    key, vec, recall = (state.meta[k] for k in ("id", "vector", "recall"))
    good = store.read("vectors", state).where(F.col(PART) != NO_CELL)
    asked = good.orderBy(F.xxhash64(key)).limit(ASKED).select(vec).collect()
    if not asked:
        return 1
    q = _unit(np.array([r[0] for r in asked], float))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), q.shape[1])
            dots = x @ q.T
            best = np.argsort(-dots, axis=0, kind="stable")[:NEAR].T.reshape(-1)  # of each query, in turn
            who = np.repeat(np.arange(len(q)), min(NEAR, len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(dots[best, who]), b.column(1).take(pa.array(best))], ["q", "dot", "cell"])

    tops = good.select(vec, PART).mapInArrow(nearest, "q bigint, dot double, cell int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("dot")))
    tops = tops.withColumn("r", rank).where(F.col("r") <= NEAR).collect()  # ASKED * NEAR rows
    place = np.empty((len(q), int(ids.max()) + 1), int)
    np.put_along_axis(place, ids[np.argsort(-(q @ centres.T), axis=1, kind="stable")], np.arange(len(ids))[None].repeat(len(q), 0), axis=1)
    needed = np.sort([place[r.q, r.cell] for r in tops])
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1

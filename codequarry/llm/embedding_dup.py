"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard.

Rows of equal vectors are one class, and only classes go on. A hash deals the classes to shards of
bounded size, and a task builds each shard's graph. Every class then queries every shard: the
graph's rows go to a few tasks for each shard, and each streams its block of the queries past the
graph. Hits are verified by cosine in double precision. Of the links that a task finds, it passes on
how many each query has, and those of a spanning forest, so a large group costs its size and not
its square; the forests are joined to components.

A query whose beam holds nothing but hits is repeated with a beam twice as wide, until it holds
something else. Besides, a fixed number of classes, half of them from those that links were found of, so that
there is something to measure however rare links are, is compared with all classes by brute force. If
the shares of their links that a search finds are less than `recall` in the mean over these classes,
beams are made twice as wide until they are not, and all is searched again with the last width.

Cost: n_shards searches for each class. The number of shards is fixed until a shard would hold
more than `shard_rows` classes. A task holds a shard as arrays: vectors twice (double and single precision,
12 bytes a component) and 24 neighbours of 4 bytes, some 2.4 GB for 250,000 vectors of 768 components.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and
rows with a null id, are linked with nothing; vectors of other lengths are never linked; repeated
rows of one id and vector count as one vector and are answered one by one; of ties in cosine all are
links; very long vectors are compared whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import components, forget, materialize

LINKS, BASE_LINKS = 12, 24  # of a node in the upper levels, and in the lowest
BUILD_BEAM = 48
STEP = 4  # nodes of each beam whose neighbours are visited at once


def beam_search(x: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best nodes of a level for each query, from its start nodes: ids (-1: none) and cosines.

    x: unit vectors of all nodes; near: neighbours of each (-1: none); q: unit queries;
    start: a row of nodes for each query.
    """
    n, m = len(x), near.shape[1]
    ids = np.full((len(q), beam), -1, np.int32)
    sims = np.full((len(q), beam), -np.inf, np.float32)
    chunk = max(1, 24_000_000 // n)
    for a in range(0, len(q), chunk):
        part = q[a : a + chunk]
        rows = np.arange(len(part))
        seen = np.zeros((len(part), n), bool)
        s = np.sort(start[a : a + chunk], axis=1)
        twice = np.zeros(s.shape, bool)
        twice[:, 1:] = s[:, 1:] == s[:, :-1]
        seen[rows[:, None], s] = True
        best = np.full((len(part), beam), -1, np.int32)
        sim = np.full((len(part), beam), -np.inf, np.float32)
        k = min(beam, s.shape[1])
        first = np.where(twice, -np.inf, np.einsum("qkd,qd->qk", x[s], part))
        order = np.argsort(-first, axis=1)[:, :k]
        best[:, :k], sim[:, :k] = np.take_along_axis(s, order, 1), np.take_along_axis(first, order, 1)
        best[sim == -np.inf] = -1
        done = best < 0
        while True:
            live = np.flatnonzero(~done.all(axis=1))
            if not len(live):
                break
            open_sim = np.where(done[live], -np.inf, sim[live])
            pick = np.argpartition(-open_sim, min(STEP, beam) - 1, axis=1)[:, :STEP]
            ok = np.take_along_axis(open_sim, pick, 1) > -np.inf
            nodes = np.where(ok, np.take_along_axis(best[live], pick, 1), -1)
            done[live[:, None], pick] = True
            nbrs = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(len(live), -1)
            # a node that two of the picked ones share is visited once
            nbrs = np.sort(nbrs, axis=1)
            nbrs[:, 1:][nbrs[:, 1:] == nbrs[:, :-1]] = -1
            fresh = (nbrs >= 0) & ~seen[live[:, None], nbrs]
            r, c = np.nonzero(fresh)
            seen[live[r], nbrs[r, c]] = True
            got = np.full(nbrs.shape, -np.inf, np.float32)
            got[r, c] = np.einsum("ij,ij->i", x[nbrs[r, c]], part[live[r]])
            all_sim = np.concatenate([sim[live], got], axis=1)
            all_ids = np.concatenate([best[live], nbrs], axis=1)
            all_done = np.concatenate([done[live], ~fresh], axis=1)
            keep = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            sim[live] = np.take_along_axis(all_sim, keep, 1)
            best[live] = np.where(sim[live] > -np.inf, np.take_along_axis(all_ids, keep, 1), -1)
            done[live] = np.take_along_axis(all_done, keep, 1) | (best[live] < 0)
        order = np.argsort(-sim, axis=1)
        ids[a : a + chunk], sims[a : a + chunk] = np.take_along_axis(best, order, 1), np.take_along_axis(sim, order, 1)
    return ids, sims


def choose(x: np.ndarray, q: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, those nearer to the query than to one chosen before; then the best of the rest."""
    v = np.where((ids >= 0)[:, :, None], x[ids], 0)
    to_q = np.where(ids >= 0, np.einsum("qkd,qd->qk", v, q), -np.inf)
    between = v @ v.transpose(0, 2, 1)
    n, k = ids.shape
    taken = np.zeros((n, k), bool)
    for c in range(k):
        rival = np.where(taken, between[:, c, :], -np.inf).max(axis=1)
        taken[:, c] = (ids[:, c] >= 0) & (to_q[:, c] > rival) & (taken.sum(axis=1) < most)
    rank = np.where(taken, 0, 1) * k + np.arange(k) + np.where(ids < 0, 10 * k, 0)
    out = np.take_along_axis(ids, np.argsort(rank, axis=1)[:, :most], 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def build_level(x: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of each node; nodes are added in growing batches, in their order."""
    n = len(x)
    near = np.full((n, most), -1, np.int32)
    have = 0
    while have < n:
        new = np.arange(have, min(n, max(have * 3 // 2, have + 128), have + 2048))
        q = x[new]
        mutual = q @ q.T
        np.fill_diagonal(mutual, -np.inf)
        k = min(BUILD_BEAM, len(new) - 1)
        own = np.argsort(-mutual, axis=1)[:, :k]
        ids, sims = new[own].astype(np.int32), np.take_along_axis(mutual, own, 1)
        if have:
            start = np.linspace(0, have - 1, min(have, 16)).astype(np.int32)
            old, old_sims = beam_search(x, near, q, np.broadcast_to(start, (len(q), len(start))), BUILD_BEAM)
            ids, sims = np.concatenate([ids, old], axis=1), np.concatenate([sims, old_sims], axis=1)
        order = np.argsort(-sims, axis=1)[:, : 2 * BUILD_BEAM]
        near[new] = choose(x, q, np.take_along_axis(ids, order, 1), most)
        # links back: each touched node chooses anew from its old and new neighbours
        src, col = np.nonzero(near[new] >= 0)
        to, back = near[new][src, col], new[src].astype(np.int32)
        touched, at = np.unique(to, return_inverse=True)
        order = np.lexsort((-np.einsum("ij,ij->i", x[to], x[back]), at))
        at, back = at[order], back[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        more = np.full((len(touched), most), -1, np.int32)
        more[at[nth < most], nth[nth < most]] = back[nth < most]
        ids = np.concatenate([near[touched], more], axis=1)
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        for a in range(0, len(touched), 2048):
            t, c = touched[a : a + 2048], ids[a : a + 2048]
            s = np.where(c >= 0, np.einsum("qkd,qd->qk", x[c], x[t]), -np.inf)
            near[t] = choose(x, x[t], np.take_along_axis(c, np.argsort(-s, axis=1), 1), most)
        have = new[-1] + 1
    return near


class Graph:
    """Levels from the lowest up; a node of level l is also in all levels below. Nodes are sorted by level, highest first."""

    def __init__(self, x: np.ndarray, level: np.ndarray, near: list[np.ndarray] | None = None):
        self.raw = x
        self.x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        self.level = level
        self.counts = [int((level >= k).sum()) for k in range(int(level.max()) + 1)]
        self.near = near or [build_level(self.x[:c], BASE_LINKS if not k else LINKS) for k, c in enumerate(self.counts)]

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        top = min(self.counts[-1], 64)
        at = np.broadcast_to(np.arange(top, dtype=np.int32), (len(q), top))
        for k in range(len(self.counts) - 1, 0, -1):
            at, _ = beam_search(self.x[: self.counts[k]], self.near[k], q, at, 8)
            at = np.where(at < 0, at[:, :1], at)
        return beam_search(self.x, self.near[0], q, at[:, :8] if len(self.counts) > 1 else at, beam)

    def linked(self, q: np.ndarray, beam: int, least: float) -> list[np.ndarray]:
        """Nodes whose cosine with each query, in double precision, is at least so much."""
        unit = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)
        norms = np.linalg.norm(self.raw, axis=1)
        found: list[np.ndarray] = [np.empty(0, np.int32)] * len(q)
        todo = np.arange(len(q))
        while len(todo):
            wide = min(beam, len(self.x))
            ids, sims = self.search(unit[todo], wide)
            hits = (ids >= 0) & (sims >= least - 1e-4)
            for i, row, hit in zip(todo, ids, hits, strict=True):
                near = row[hit]
                cos = self.raw[near] @ q[i] / (norms[near] * np.linalg.norm(q[i]))
                found[i] = near[cos >= least]
            todo = todo[hits.all(axis=1)] if wide < len(self.x) else todo[:0]
            beam *= 2
        return found


_GRAPH = "dim int, shard int, kind int, pos int, node {id}, n long, v array<double>, near array<int>, upper array<array<int>>"


def _build(pdf):
    """The rows of a shard's graph: each node with its neighbours in the levels it is in."""
    pdf = pdf.copy()
    draw = np.random.default_rng(len(pdf)).random(len(pdf))
    pdf["level"] = np.minimum(6, np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS))).astype(int)
    pdf = pdf.sort_values(["level", "node"], ascending=[False, True], ignore_index=True)
    g = Graph(np.array(pdf["v"].tolist(), np.float64), pdf["level"].to_numpy())
    pdf["kind"], pdf["pos"] = 0, np.arange(len(pdf))
    pdf["near"] = list(g.near[0])
    pdf["upper"] = [[g.near[k][i] for k in range(1, lv + 1)] for i, lv in enumerate(pdf["level"])]
    return pdf[["dim", "shard", "kind", "pos", "node", "n", "v", "near", "upper"]]


def _array(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
    """A column of lists of one length as rows of an array."""
    n = sum(b.num_rows for b in batches)
    return np.concatenate([b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False) for b in batches]).reshape(n, -1)


def _list(batches: list[pa.RecordBatch], name: str) -> list:
    return [x for b in batches for x in b.column(b.schema.get_field_index(name)).to_pylist()]


def _graph(batches: list[pa.RecordBatch]) -> tuple[Graph, list, np.ndarray]:
    """Of a shard's graph rows: the graph, its nodes and their numbers of vectors."""
    order = np.argsort(_list(batches, "pos"))
    nodes, upper = _list(batches, "node"), _list(batches, "upper")
    level = np.array([len(upper[i]) for i in order])
    near = [_array(batches, "near")[order]]
    near += [np.array([upper[i][k - 1] for i in order if len(upper[i]) >= k], np.int32) for k in range(1, level.max() + 1)]
    return Graph(_array(batches, "v")[order], level, near), [nodes[i] for i in order], np.array(_list(batches, "n"))[order]


class Forest:
    """Links that join what no earlier one of the same graph has joined."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (parent := up.setdefault(x, x)) != x:
            up[x] = up[parent]
            x = up[x]
        return x

    def new(self, x, others: list) -> list:
        out = []
        for y in others:
            a, b = self.root(x), self.root(y)
            if a != b:
                self.up[a] = b
                out.append(y)
        return out


def _search(batches, beam: int, least: float, type_, tell: bool):
    """Rows come sorted by shard and block, a graph's before its queries; both may span batches.

    Gives per query with links: their number of vectors, those of the forest, and all if they are to be told.
    """
    key, rows, graph, forest = None, [], None, Forest()
    for b in batches:
        keys = list(zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("dim", "shard", "block", "kind")], strict=True))
        ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        at = 0
        for end in ends if keys else []:
            part, k = b.slice(at, end - at), keys[at]
            at = end
            if k[3] == 0:
                if k != key:
                    key, rows, graph, forest = k, [], None, Forest()
                rows.append(part)
                continue
            if key is None or key[:3] != k[:3]:
                continue  # no graph: the shard is empty
            graph = graph or _graph(rows)
            g, nodes, n = graph
            found = g.linked(_array([part], "v"), beam, least)
            links = [(q, [nodes[i] for i in f if nodes[i] != q], sum(int(n[i]) for i in f if nodes[i] != q)) for q, f in zip(_list([part], "node"), found, strict=True)]
            links = [x for x in links if x[1]]
            many = pa.list_(type_)
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([q for q, _, _ in links], type_),
                "n": pa.array([w for _, _, w in links], pa.int64()),
                "forest": pa.array([forest.new(q, x) for q, x, _ in links], many),
                "links": pa.array([x if tell else None for _, x, _ in links], many),
            })


def _audit(classes: DataFrame, found: DataFrame, least: float, queries: int, id_type: str):
    """All links of so many classes by brute force, as (node, other); and these classes, as rows (node).

    Half of them are from those with links in found.
    """
    spark = classes.sparkSession
    first = lambda df: df.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(queries // 2).select("node", "dim", "v")
    linked = classes.join(found.select("node").distinct(), "node", "left_semi")
    asked = list({r.node: r for r in first(linked).unionByName(first(classes)).collect()}.values())
    by_dim = {}
    for r in asked:
        by_dim.setdefault(r.dim, []).append((r.node, r.v))
    sent = spark.sparkContext.broadcast({d: ([n for n, _ in x], np.array([v for _, v in x], np.float64)) for d, x in by_dim.items()})

    def compare(batches):
        for b in batches:
            out, dims = [], b.column(b.schema.get_field_index("dim"))
            for d, (nodes, q) in sent.value.items():
                same = b.filter(pc.equal(dims, d))
                if same.num_rows:
                    v, others = _array([same], "v"), _list([same], "node")
                    cos = (v @ q.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1))
                    out += [{"node": nodes[j], "other": others[i]} for i, j in np.argwhere(cos >= least) if nodes[j] != others[i]]
            yield pa.RecordBatch.from_pylist(out, schema) if out else pa.RecordBatch.from_pydict({f.name: pa.array([], f.type) for f in schema}, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    t = to_arrow_type(classes.schema["node"].dataType)
    schema = pa.schema([("node", t), ("other", t)])
    truth = classes.select("node", "dim", "v").mapInArrow(compare, f"node {id_type}, other {id_type}")
    return truth, spark.createDataFrame([(r.node,) for r in asked], T.StructType([T.StructField("node", classes.schema["node"].dataType)]))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, beam: int = 32, n_shards: int = 8, shard_rows: int = 250_000, blocks: int = 3, audit_queries: int = 512, recall: float = 0.99) -> DataFrame:
    """Per row: id, n_links, component_id and kept (id = component_id)."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_dtype = vectors.schema[id_col].dataType
    id_type, arrow_type = id_dtype.simpleString(), to_arrow_type(id_dtype)
    v = F.col(vector_col).cast("array<double>")
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    rows = materialize(vectors.select(F.col(id_col).alias("id"), v.alias("v")).withColumn("ok", F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("ok", F.coalesce(F.col("ok") & finite & (norm > 0), F.lit(False))))
    classes = rows.where("ok").groupBy("v").agg(F.min("id").alias("node"), F.count_distinct("id").alias("n"), F.first(F.size("v")).alias("dim"))
    classes = materialize(classes)
    total = classes.count()
    n_shards = max(n_shards, -(-total // shard_rows))
    shard = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(n_shards)).cast("int")
    dealt = classes.select("node", "v", "n", "dim", shard.alias("shard"))
    graphs = materialize(dealt.repartition(n_shards, "shard").groupBy("dim", "shard").applyInPandas(_build, _GRAPH.format(id=id_type)))
    empty = lambda kind: F.lit(None).cast(kind)
    schema = f"node {id_type}, n long, forest array<{id_type}>, links array<{id_type}>"

    def searched(queries: DataFrame, beam: int, blocks: int, tell: bool) -> DataFrame:
        left = graphs.withColumn("block", F.explode(F.array(*[F.lit(k) for k in range(blocks)])))
        right = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.lit(0).alias("pos"), "node", "n", "v", empty("array<int>").alias("near"), empty("array<array<int>>").alias("upper"), F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)).cast("int").alias("block"))
        both = left.unionByName(right).repartition(n_shards * blocks, "shard", "block").sortWithinPartitions("dim", "shard", "block", "kind")
        return both.mapInArrow(lambda it: _search(it, beam, least, arrow_type, tell), schema)

    found, first = materialize(searched(classes, beam, blocks, False)), beam
    truth, asked = _audit(classes, found, least, audit_queries, id_type)
    truth = materialize(truth)
    audited = classes.join(F.broadcast(asked), "node", "left_semi")  # audit_queries rows at most

    def measured(beam: int) -> float:
        """The mean share of links found, over the audited classes with links; 1 if none has any."""
        pairs = searched(audited, beam, 1, True).select("node", F.explode("links").alias("other")).withColumn("hit", F.lit(1.0))
        each = truth.join(pairs, ["node", "other"], "left").groupBy("node").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))
        return each.agg(F.coalesce(F.avg("share"), F.lit(1.0))).first()[0]

    while measured(beam) < recall and beam < shard_rows:
        beam *= 2
    if beam > first:
        forget(found)
        found = materialize(searched(classes, beam, blocks, False))
    weights = found.groupBy("node").agg(F.sum("n").alias("others"))
    edges = found.select("node", F.explode("forest").alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    labels = components(edges)
    known = classes.join(weights, "node", "left").join(labels, "node", "left")
    known = known.select(F.col("v").alias("cv"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.join(known, F.when(F.col("ok"), F.col("v")) == F.col("cv"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def embedding_dup_digest(vectors: DataFrame) -> DataFrame:
    """The columns of query op5."""
    return near_duplicates(vectors)

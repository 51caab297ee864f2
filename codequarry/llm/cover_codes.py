"""Vector code compression: product codes learnt by Lloyd's rounds over partition-local cover trees.

Vectors become whole numbers and are cut into equal parts; each part position has a codebook. A task
packs its rows into blocks, and builds for each block and part position a cover tree in its simplified
form: a node of level i covers its points within 2**i, its children are points of the node, the
node's own among them, farther than 2**(i-1) from each other, and each covers what lies within that
distance of it and of no earlier child. Points are stored in the order of the tree, so a subtree is a run
of them and its sum a difference of cumulative sums. The blocks with their trees are written once
to the shared folder.

A Lloyd round sends the codebooks to the blocks. For a node with radius r (of its points, not of its
level) let the nearest entry be at distance d and the second at d2: if d2 - d > 2 r, the triangle
inequality gives the whole subtree to the nearest, and its cumulative sum is added at once. Only other nodes
descend; what remains at the leaves is compared exactly, in whole numbers, ties to the lower index.
Each task passes on one sum and count for each entry, so a round shuffles little however many rows
there are, and the driver holds the codebooks only.

Defined cases: rows whose vector is null, or holds a null or non-finite component or one of 2**26 or more
after scaling, are dropped, and so are empty vectors and those of another than the commonest length
(see whole_vectors); where a length is no multiple of the number of parts, zeros are appended;
repeated rows count as often as they occur; the starting entries are of the smallest ids, rows of
one id by their numbers, null ids last; with fewer rows than entries there are fewer entries; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import materialize
from codequarry.llm.whole_vectors import whole_vectors

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
BITS = 26  # of a whole number: squared distances of parts of 1024 components fit 63 bits
LEAF = 8  # points that a node may hold without children
BLOCK_BYTES = 1 << 22  # of a block's numbers, as int64
NODE = ("lo", "hi", "centre", "radius2", "child", "n_children")  # of a tree's nodes, as int64 columns


def build_tree(points: np.ndarray, part: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover trees of the points of each part, all at once and level by level.

    part: of each point, ascending. Returns (order, nodes): the points' indices in tree order, and a
    row of NODE for each node, the roots first; lo, hi and centre are places in that order. Children of a node stand
    together. A node without children holds equal points, or at most LEAF of them.
    """
    order = np.arange(len(points))
    lo = np.searchsorted(part, np.arange(n_parts), "left")
    hi = np.searchsorted(part, np.arange(n_parts), "right")
    centre = np.minimum(lo, max(len(points) - 1, 0))  # a point's index until the end
    radius2 = np.zeros(n_parts, np.int64)
    if len(points):
        apart = ((points - points[centre[part]]) ** 2).sum(1)
        np.maximum.at(radius2, part, apart)
    levels, child, n_children, done = [(lo, hi, centre, radius2)], [], [], 0
    while True:
        lo, hi, centre, radius2 = levels[-1]
        first = np.zeros(len(lo), np.int64)
        many = np.zeros(len(lo), np.int64)
        split = np.flatnonzero((hi - lo > LEAF) & (radius2 > 0))
        done += len(lo)
        if not len(split):
            child.append(first)
            n_children.append(many)
            break
        # half of the level's distance 2**i, squared; 2**i is the least that is not below the radius
        half2 = np.int64(1) << np.maximum(2 * np.ceil(np.log2(radius2[split]) / 2 - 1e-9).astype(np.int64) - 2, 0)
        half2[radius2[split] == 1] = 0
        sizes = hi[split] - lo[split]
        node = np.repeat(np.arange(len(split)), sizes)
        place = np.repeat(lo[split] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(node))
        child_of, apart = np.empty(len(node), np.int64), np.empty(len(node), np.int64)
        picks_node, picks_point, open_ = [], [], np.arange(len(node))
        pick = centre[split]
        while len(open_):
            at = node[open_]
            have = np.full(len(split), -1, np.int64)
            if picks_node:  # then each node's first point that no child covers yet
                starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                who = at[starts]
                pick = np.zeros(len(split), np.int64)
                pick[who] = order[place[open_[starts]]]
            else:
                who = np.arange(len(split))
            have[who] = sum(map(len, picks_node)) + np.arange(len(who))
            picks_node.append(who)
            picks_point.append(pick[who])
            d2 = ((points[order[place[open_]]] - points[pick[at]]) ** 2).sum(1)
            near = d2 <= half2[at]
            child_of[open_[near]], apart[open_[near]] = have[at[near]], d2[near]
            open_ = open_[~near]
        nodes, picked = np.concatenate(picks_node), np.concatenate(picks_point)
        rank = np.argsort(nodes, kind="stable")  # children of a node together
        new = np.empty(len(rank), np.int64)
        new[rank] = np.arange(len(rank))
        child_of = new[child_of]
        by_child = np.argsort(child_of, kind="stable")
        order[place] = order[place[by_child]]
        counts = np.bincount(child_of, minlength=len(rank))
        ends = np.cumsum(counts)
        reach = np.zeros(len(rank), np.int64)
        np.maximum.at(reach, child_of, apart)
        low = place[ends - counts]
        per_node = np.bincount(nodes, minlength=len(split))
        first[split], many[split] = done + np.cumsum(per_node) - per_node, per_node
        child.append(first)
        n_children.append(many)
        levels.append((low, low + counts, picked[rank], reach))
    at = np.empty(len(points), np.int64)
    at[order] = np.arange(len(points))
    lo, hi, centre, radius2 = (np.concatenate([level[k] for level in levels]) for k in range(4))
    centre = at[centre] if len(points) else centre
    return order, np.stack([lo, hi, centre, radius2, np.concatenate(child), np.concatenate(n_children)], axis=1)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of points and entries, as int64."""
    if max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)) < 1 << 20 and points.shape[1] < 1 << 10:
        p, e = points.astype(np.float64), entries.astype(np.float64)  # whole numbers below 2**53
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)).astype(np.int64)
    return np.stack([((points - e) ** 2).sum(1) for e in entries], axis=1)


def assign(points: np.ndarray, nodes: np.ndarray, books: np.ndarray, sums: np.ndarray, counts: np.ndarray, codes: np.ndarray | None = None) -> int:
    """Give every point its nearest entry by the trees of one block.

    points: in tree order; books: part, entry, component. Adds to sums (as books) and counts (part,
    entry), or sets codes of the points. Returns how many distances were computed.
    """
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
    computed, n_entries = 0, books.shape[1]
    n_parts = len(books)
    root_part = np.arange(n_parts)
    front = root_part[nodes[:n_parts, 1] > nodes[:n_parts, 0]]
    front_part = front
    while len(front):
        down, down_part = [], []
        for p in np.unique(front_part).tolist():
            own = front[front_part == p]
            for some in np.array_split(own, max(1, len(own) >> 14)):
                lo, hi, centre, radius2, child, n_children = nodes[some].T
                d2 = squared(points[centre], books[p])
                computed += d2.size
                best = d2.argmin(1)
                sure = radius2 == 0
                if n_entries > 1:
                    nearest = np.sqrt(np.partition(d2, 1, axis=1)[:, :2].astype(np.float64))
                    sure |= nearest[:, 1] - nearest[:, 0] > 2 * np.sqrt(radius2.astype(np.float64)) * (1 + 1e-9) + 1e-6
                else:
                    sure[:] = True
                _give(p, lo[sure], hi[sure], best[sure], total, sums, counts, codes)
                leaf = ~sure & (n_children == 0)
                if leaf.any():
                    sizes = (hi - lo)[leaf]
                    at = np.repeat(lo[leaf] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    d2 = squared(points[at], books[p])
                    computed += d2.size
                    _give(p, at, at + 1, d2.argmin(1), total, sums, counts, codes)
                inner = ~sure & (n_children > 0)
                sizes = n_children[inner]
                below = np.repeat(child[inner] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                down.append(below)
                down_part.append(np.full(len(below), p))
        front, front_part = np.concatenate(down), np.concatenate(down_part)
    return computed


def _give(p: int, lo: np.ndarray, hi: np.ndarray, entry: np.ndarray, total: np.ndarray, sums: np.ndarray, counts: np.ndarray, codes: np.ndarray | None) -> None:
    """The runs lo to hi of points go to these entries of part p."""
    if codes is None:
        np.add.at(sums[p], entry, total[hi] - total[lo])
        np.add.at(counts[p], entry, hi - lo)
    else:
        sizes = hi - lo
        codes[np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = np.repeat(entry, sizes)


def _blocks(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """Blocks of rows(id, label, x) with their trees, in the shared folder."""
    width = max(1, -(-length // parts))
    block_rows = max(1, BLOCK_BYTES // (8 * width * parts))
    out = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType))])
    out = out.add("points", T.BinaryType()).add("place", T.BinaryType()).add("nodes", T.BinaryType())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                some = b.slice(at, block_rows)
                n = some.num_rows
                x = np.zeros((n, width * parts), np.int64)
                x[:, :length] = some.column("x").flatten().to_numpy().reshape(n, length)
                points = np.ascontiguousarray(x.reshape(n, parts, width).transpose(1, 0, 2)).reshape(parts * n, width)
                order, nodes = build_tree(points, np.repeat(np.arange(parts), n), parts)
                lists = [pa.LargeListArray.from_arrays(pa.array([0, n]), some.column(c)).cast(pa.list_(some.column(c).type)) for c in ("id", "label")]
                data = [points[order].astype("<i4"), order.astype("<i4"), nodes.astype("<i8")]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([d.tobytes()], pa.binary()) for d in data)], out.names)

    return materialize(rows.select("id", "label", "x").mapInArrow(pack, out))


def _opened(b: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for k in range(b.num_rows):
        points, place, nodes = (np.frombuffer(b.column(c)[k].as_buffer(), t) for c, t in (("points", "<i4"), ("place", "<i4"), ("nodes", "<i8")))
        yield k, points.reshape(-1, width).astype(np.int64), place, nodes.reshape(-1, len(NODE))


def learn(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after so many rounds of Lloyd's method."""
    for _ in range(rounds):

        def sum_up(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for b in batches:
                for _, points, _, nodes in _opened(b, books.shape[2]):
                    assign(points, nodes, books, sums, counts)
            used = np.flatnonzero(counts)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(sums.reshape(-1, books.shape[2])[used].reshape(-1)), books.shape[2]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts.reshape(-1)[used]), lists], ["entry", "n", "sums"])

        each = blocks.select("points", "place", "nodes").mapInArrow(sum_up, "entry bigint, n bigint, sums array<bigint>")
        total = each.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(books.shape[2]))).alias("sums"))
        books = books.copy()
        for r in total.collect():  # a row for each entry of the codebooks
            books.reshape(-1, books.shape[2])[r.entry] = [s // r.n for s in r.sums]
    return books


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (two hex digits for each part) and error of every row."""
    parts, width = len(books), books.shape[2]
    label = blocks.schema["labels"].dataType.elementType

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, points, place, nodes in _opened(b, width):
                codes, n = np.empty(len(points), np.int64), len(points) // parts
                assign(points, nodes, books, np.zeros(0), np.zeros(0), codes)
                part = place // n
                apart = ((points - books[part, codes]) ** 2).sum(1)
                error, by_row = np.zeros(n, np.int64), np.empty((n, parts), np.uint8)
                np.add.at(error, place % n, apart)
                by_row[place % n, part] = codes
                text = by_row.tobytes().hex()
                text = [text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([b.column("ids")[k].values, b.column("labels")[k].values, pa.array(text, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return blocks.mapInArrow(give, T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label)]).add("code", "string").add("error", "long"))


def codebooks_of(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(blocks of all kept rows with their trees, codebooks as part, entry, component)."""
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    keep = {"id": id_col} | ({"label": label_col} if label_col else {})
    rows, length = whole_vectors(embeddings, vec_col, keep, scale, BITS)
    rows = rows if label_col else rows.withColumn("label", F.lit(None).cast("int"))
    first = [r.x for r in rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    width = max(1, -(-length // parts))
    start = np.zeros((len(first), width * parts), np.int64)
    if first:
        start[:, :length] = first
    blocks = _blocks(rows, length, parts)
    return blocks, learn(blocks, start.reshape(-1, parts, width).transpose(1, 0, 2), rounds if first else 0)


def code_digest(embeddings: DataFrame, label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and the codebooks' checksum of every kept row."""
    blocks, books = codebooks_of(embeddings, label_col=label_col)
    coded = materialize(encode(blocks, books))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    same = coded["label"].eqNullSafe(totals["label"])
    return coded.join(totals, same).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))

"""Embedding whitening by a distributed Jacobi-Davidson eigensolver.

The covariance matrix is never made. What the solver needs is its product with a few vectors, which
is one pass over the distinct vectors, centred before they are multiplied: each task adds up
(x - m) ((x - m)' u) over its blocks. The solver holds on the driver only vectors of the embedding's
length:

* The search space, a few tens of vectors, is kept orthonormal together with its product. Rayleigh-Ritz
  in it gives the present approximations (e, u) with residuals r = V u - e u.
* Each unfinished approximation gets a correction t from the projected equation
  (I - QQ')(V - e I)(I - QQ') t = -r, where Q holds the locked vectors and the present approximations.
  It is solved by a few steps of MINRES; the equations of all approximations take their steps together,
  so that a step is one pass over the data.
* A leading approximation whose residual has reached double precision is locked and deflated. When
  the search space is full it is restarted from its best vectors. Two approximations more than asked for
  are followed, so that a component that comes late is not passed over.
* The locked vectors are multiplied once more; if a residual isn't what it was, the search goes on.

Whitened values are checked on the data: their covariance over the distinct vectors against the identity.

Defined cases: rows whose vector is null or holds null or non-finite entries, or one of 2**53 or more
after scaling, are dropped, and so are empty vectors and those of another than the commonest length
(see whole_vectors); repeated vectors count once in the fit, and each row is answered; a component whose eigenvalue
is zero to double precision has no whitened value and no rows, so vectors that are all equal, or one
vector alone, give none; of equal eigenvalues any orthonormal vectors may come; a deviation that does
not fit a long is null; null ids stay; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import materialize
from codequarry.llm.whole_vectors import whole_vectors

SCALE, COMPONENTS, BITS = 256, 4, 53
BLOCK_BYTES = 1 << 22  # of a block's numbers
INNER = 6  # steps of MINRES for a correction
GUARD = 2  # approximations that are followed beyond those asked for
WIDTH = 36  # vectors of the search space before a restart
OUTER = 300
FAN_IN = 1024  # partial sums that the driver adds; more are added in tasks first
EPS = np.finfo(float).eps


def _block(b: pa.RecordBatch, length: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(-1, length)


class FitList:
    """The distinct vectors as blocks in the shared folder, and sums over them."""

    def __init__(self, rows: DataFrame, length: int):
        self.length = length

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, BLOCK_BYTES // (8 * length))
            for b in batches:
                x = _block(b, length)
                for at in range(0, len(x), step):
                    some = x[at : at + step]
                    small = np.abs(some).max() < 1 << 31
                    data = some.astype("<i4" if small else "<i8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([len(some)]), pa.array([data], pa.binary())], ["n", "data"])

        self.blocks = materialize(rows.select("x").distinct().mapInArrow(pack, "n bigint, data binary"))
        self.parts = self.blocks.rdd.getNumPartitions()
        self.n = self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        self.sums = self._total(lambda x: x.sum(0), np.int64).reshape(length) if self.n else np.zeros(length, np.int64)
        self.mean = self.sums / max(self.n, 1)

    def _total(self, f: Callable[[np.ndarray], np.ndarray], kind=np.float64) -> np.ndarray:
        """The sum of f(x) over all blocks x."""
        length = self.length

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for n, data in zip(b.column("n").to_pylist(), b.column("data"), strict=True):
                    x = np.frombuffer(data.as_buffer(), "<i8" if data.as_buffer().size == 8 * n * length else "<i4").reshape(n, length)
                    made = f(x.astype(np.int64) if kind is np.int64 else x.astype(np.float64))
                    total = made if total is None else total + made
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([sum(np.frombuffer(v.as_buffer(), kind) for v in b.column("sum")).tobytes()], pa.binary())], ["sum"])

        sums = self.blocks.mapInArrow(each, "sum binary")
        if self.parts > FAN_IN:
            sums = sums.repartition(FAN_IN // 32).mapInArrow(add, "sum binary")
        return np.sum([np.frombuffer(r[0], kind) for r in sums.collect()], axis=0)

    def product(self, u: np.ndarray) -> np.ndarray:
        """The covariance matrix times the columns of u."""
        mean = self.mean

        def f(x: np.ndarray) -> np.ndarray:
            z = x - mean
            return z.T @ (z @ u)

        return self._total(f).reshape(u.shape) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(self._total(lambda x: ((x - mean) ** 2).sum(0)).sum() / self.n)

    def whitened_error(self, u: np.ndarray, e: np.ndarray) -> float:
        """The largest entry of the whitened values' covariance minus the identity, centred before multiplying."""
        mean, k = self.mean, len(e)
        white = lambda x: ((x - mean) @ u) / np.sqrt(e)
        middle = self._total(lambda x: white(x).sum(0)) / self.n

        def f(x: np.ndarray) -> np.ndarray:
            w = white(x) - middle
            return w.T @ w

        return float(np.abs(self._total(f).reshape(k, k) / self.n - np.eye(k)).max())


def minres(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, least: float) -> np.ndarray:
    """Approximate solutions of the equations product(x) = b, a column each, by steps of MINRES.

    Minimises each residual over the Krylov space by short recurrences of conjugate directions. Stops
    when all residuals have fallen by the factor least.
    """
    dot = lambda x, y: np.einsum("ij,ij->j", x, y)
    over = lambda x, y: np.where(y > 0, x / np.where(y > 0, y, 1), 0)
    x, r, goal = np.zeros_like(b), b.copy(), least * np.linalg.norm(b, axis=0)
    p, s = [b.copy()], [product(b)]
    for k in range(steps):
        size = dot(s[-1], s[-1])
        step = over(dot(r, s[-1]), size)
        x += step * p[-1]
        r -= step * s[-1]
        if k + 1 == steps or (np.linalg.norm(r, axis=0) <= goal).all():
            break
        new_p, new_s = s[-1].copy(), product(s[-1])
        for old_p, old_s in list(zip(p, s, strict=True))[::-1][:2]:
            back = over(dot(new_s, old_s), dot(old_s, old_s))
            new_p -= back * old_p
            new_s -= back * old_s
        size = np.linalg.norm(new_s, axis=0)
        scale = np.where(size > 0, size, 1)
        p, s = [p[-1], new_p / scale], [s[-1], new_s / scale]
    return x


def _orthonormal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what t adds to the spans of the bases."""
    kept = np.zeros((len(t), 0))
    for column in t.T:
        v, size = column.copy(), np.linalg.norm(column)
        for _ in range(3):  # again until rounding no longer shows
            for basis in (*bases, kept):
                v -= basis @ (basis.T @ v)
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-10 * size:
            kept = np.column_stack([kept, v / left])
    return kept


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], length: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading eigenpairs of the symmetric matrix behind product: (values falling, vectors, residuals)."""
    random = np.random.default_rng(1)
    wanted = min(wanted, length)
    q, e = np.zeros((length, 0)), np.zeros(0)
    w = _orthonormal(random.standard_normal((length, min(length, 2 * (wanted + GUARD)))))
    aw = product(w)
    best, since = np.inf, 0
    for _ in range(OUTER):
        theta, y = np.linalg.eigh((w.T @ aw + aw.T @ w) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        w, aw = w @ y, aw @ y
        r = aw - w * theta
        r -= q @ (q.T @ r)
        size = np.linalg.norm(r, axis=0)
        norm = max([*e, theta[0] if len(theta) else 0.0])
        spanned = w.shape[1] + q.shape[1] >= length
        # double precision, or as near as the rounding of the sums lets it come
        since = 0 if size[0] < best / 2 else since + 1
        best = min(best, size[0])
        stuck = since >= 3 and size[0] <= 1e4 * EPS * norm
        while len(theta) and q.shape[1] < wanted and (size[0] <= 16 * EPS * norm or spanned or stuck):
            q, e = np.column_stack([q, w[:, :1]]), np.append(e, theta[0])
            w, aw, r, theta, size = w[:, 1:], aw[:, 1:], r[:, 1:], theta[1:], size[1:]
            best, since, stuck = np.inf, 0, False
        if q.shape[1] == wanted:
            q = np.linalg.qr(q)[0]
            aq = product(q)
            values, y = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
            values, y = values[::-1], y[:, ::-1]
            q, aq = q @ y, aq @ y
            left = np.linalg.norm(aq - q * values, axis=0)
            if spanned or left.max() <= 1e4 * EPS * norm:
                return np.maximum(values, 0), q, left
            w, aw, q, e = np.column_stack([q, w]), np.column_stack([aq, aw]), q[:, :0], e[:0]
            continue
        if w.shape[1] > WIDTH:
            keep = 2 * (wanted + GUARD)
            w, aw = w[:, :keep], aw[:, :keep]
        front = min(wanted - q.shape[1] + GUARD, w.shape[1])
        known = np.column_stack([q, w[:, :front]])
        open_ = np.flatnonzero(size[:front] > 16 * EPS * norm)
        shift = theta[:front][open_]
        off = lambda x, known=known: x - known @ (known.T @ x)
        t = minres(lambda x, off=off, shift=shift: off(product(off(x)) - off(x) * shift), -off(r[:, :front][:, open_]), INNER, 1e-2)
        t = _orthonormal(t, q, w)
        if not t.shape[1]:
            t = _orthonormal(random.standard_normal((length, min(2, length - q.shape[1] - w.shape[1]))), q, w)
        w, aw = np.column_stack([w, t]), np.column_stack([aw, product(t)])
    raise ArithmeticError("residuals have not reached double precision")


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every kept row and component."""
    spark = embeddings.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, length = whole_vectors(embeddings, vec_col, {"id": id_col}, scale, BITS)
    if not length:
        return spark.createDataFrame([], out)
    rows = rows.withColumn("id", F.col("id").cast("long"))
    fit = FitList(rows, length)
    trace = fit.trace()
    e, u, _ = jacobi_davidson(fit.product, length, components)
    some = e > length * EPS * trace
    e, u = e[some], u[:, some]
    if not len(e):
        return spark.createDataFrame([], out)
    error, n, sums, mean = fit.whitened_error(u, e), fit.n, fit.sums, fit.mean

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for b in batches:
            x = _block(b, length)
            white = ((x - mean) @ u) / np.sqrt(e)
            reach = max((n * int(abs(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0) + int(np.abs(sums).max())
            if reach * reach * length < 1 << 63:
                far = pa.array(((n * x - sums) ** 2).sum(1))
            else:
                exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
                far = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            row = pa.array(np.repeat(np.arange(len(x)), k))
            one = lambda v, kind: pa.array(np.full(len(x) * k, v), kind)
            columns = [b.column("id").take(row), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), one(n, pa.int64()), far.take(row),
                       pa.array(white.reshape(-1)), pa.array(np.tile(e / trace, len(x))), one(error, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in out.split(", ")])

    return rows.select("id", "x").mapInArrow(project, out)

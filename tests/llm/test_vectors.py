"""Whitening and vector codes against plain numpy, and their defined cases."""

import math

import numpy as np
import pytest

from codequarry.llm import cover_codes, whitening

KIND = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, kind=KIND):
    return spark.createDataFrame(rows, kind)


def plain_codes(x, entries, rounds, parts):
    """Codes and errors of x (rows, components) by full comparison; the first entries rows start."""
    n, w = len(x), x.shape[1] // parts
    p = x.reshape(n, parts, w)
    books = p[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((p[:, :, None] - books[None]) ** 2).sum(3)
        code = d.argmin(2)
        if r < rounds:
            for k in range(parts):
                for e in range(books.shape[1]):
                    own = p[code[:, k] == e, k]
                    if len(own):
                        books[k, e] = np.floor_divide(own.sum(0), len(own))
    return code, d.min(2).sum(1)


@pytest.mark.parametrize("spread,width", [(3, 4), (200, 4), (200, 1), (5000, 7)])
def test_trees_are_cover_trees_and_give_the_nearest_entries(spread, width):
    rng = np.random.default_rng(spread + width)
    n, parts = 700, 3
    points = rng.integers(-spread, spread, (n * parts, width))
    points[: n // 3] = points[0]  # a third are equal
    order, nodes = cover_codes.build_tree(points, np.repeat(np.arange(parts), n), parts)
    assert sorted(order.tolist()) == list(range(n * parts))
    at = points[order]
    for lo, hi, centre, radius2, child, many in nodes.tolist():
        apart = ((at[lo:hi] - at[centre]) ** 2).sum(1)
        assert lo <= centre < hi and apart.max() == radius2
        assert many or radius2 == 0 or hi - lo <= cover_codes.LEAF
        if many:
            kids = nodes[child : child + many]
            level = math.ceil(math.log2(radius2) / 2)
            assert kids[0, 0] == lo and kids[-1, 1] == hi and (kids[1:, 0] == kids[:-1, 1]).all()
            assert (at[kids[:, 2]] == at[centre]).all(1).any() and (kids[:, 3] <= 4.0 ** (level - 1)).all()
            between = ((at[kids[:, 2]][:, None] - at[kids[:, 2]][None]) ** 2).sum(2)
            assert between[~np.eye(many, dtype=bool)].min() > 4.0 ** (level - 1) * (radius2 > 1)
    books = rng.integers(-spread, spread, (parts, 20, width))
    books[:, 7] = books[:, 3]  # a tie
    sums, counts, codes = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), np.empty(n * parts, np.int64)
    cover_codes.assign(at, nodes, books, sums, counts)
    cover_codes.assign(at, nodes, books, sums, counts, codes)
    for p in range(parts):
        own = at[order // n == p]
        best = ((own[:, None] - books[p][None]) ** 2).sum(2).argmin(1)
        assert (codes[order // n == p] == best).all()
        assert (sums[p] == [own[best == e].sum(0) for e in range(20)]).all()
        assert counts[p].tolist() == np.bincount(best, minlength=20).tolist()


def test_far_subtrees_are_assigned_whole():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-5, 5, (2000, 4)) + k * 1000 for k in range(4)])
    order, nodes = cover_codes.build_tree(points, np.zeros(len(points), np.int64), 1)
    books = np.array([[[k * 1000] * 4 for k in range(4)]])
    computed = cover_codes.assign(points[order], nodes, books, np.zeros(books.shape, np.int64), np.zeros((1, 4), np.int64))
    assert computed < 400


def test_large_numbers_are_compared_exactly():
    big = 1 << 25
    points = np.array([[big, -big], [big - 1, -big]])
    books = np.array([[big - 1, -big + 1], [big, -big + 1]])
    assert cover_codes.squared(points, books).tolist() == [[2, 1], [1, 2]]


def test_codes_match_full_comparison(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 32)).astype(np.float32)
    x[300:600] = x[299]  # a group of copies
    rows = [(int(i), v.tolist(), int(i) % 3 or None) for i, v in enumerate(x)]
    got = cover_codes.code_digest(frame(spark, rows).repartition(5)).toPandas().sort_values("vec_id")
    code, error = plain_codes(np.floor(256 * x.astype(float)).astype(np.int64), 64, 2, 16)
    assert got.code.tolist() == ["".join(f"{c:02x}" for c in r) for r in code]
    assert got.error.tolist() == error.tolist()
    label = np.arange(900) % 3
    assert got.label_error.tolist() == [int(error[label == k].sum()) for k in label]
    assert got.codebooks_sha256.nunique() == 1


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(5, [0.5] * 16, 1), (5, [0.5] * 16, 1), (None, [1.0] * 16, None), (1, [-0.001] * 16, None)]
    bad = [(7, None, 1), (8, [nan] * 16, 1), (9, [None] * 16, 1), (10, [inf] * 16, 1), (11, [], 1), (12, [1.0] * 8, 1), (13, [1e9] * 16, 1)]
    df = frame(spark, good + bad).selectExpr("vec_id", "embedding", "label", "1 AS x", "2 AS id", "'a' AS code")
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in cover_codes.code_digest(df).collect()}
    # entries by ascending id: -1, 128 twice, 256; equal parts take the lower of two equal entries
    assert got == {(1, "00" * 16, 0, 0), (5, "01" * 16, 0, 0), (None, "03" * 16, 0, 0)}
    assert cover_codes.code_digest(df).count() == 4
    assert cover_codes.code_digest(frame(spark, [])).count() == 0
    blocks, books = cover_codes.codebooks_of(frame(spark, [(1, [1.0] * 5, 1)]), label_col=None, parts=4)
    assert books.shape == (4, 1, 2) and books[2, 0].tolist() == [256, 0]


def plain_components(x, k):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    z = u - s / n
    e, v = np.linalg.eigh(z.T @ z / n)
    return n, s, e[::-1][:k], v[:, ::-1][:, :k], e.sum()


def test_whitening_matches_a_dense_solver(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(600, 24)) * np.linspace(1, 2, 24)).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 300, axis=0)])
    df = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]).repartition(4)
    got = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    whole = np.floor(256 * x.astype(float)).astype(np.int64)
    n, s, e, v, trace = plain_components(whole, 4)
    assert n == 600 and got.n.unique().tolist() == [600] and len(got) == 3600
    made = got.whitened.to_numpy().reshape(-1, 4)
    want = (whole - s / n) @ v / np.sqrt(e)
    assert np.abs(made * np.sign((made * want).sum(0)) - want).max() < 1e-9
    assert got.deviation.tolist()[::4] == ((n * whole - s) ** 2).sum(1).tolist()
    assert np.allclose(got.explained.to_numpy()[:4], e / trace, rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


@pytest.mark.parametrize("values", [np.arange(150, 0, -1.0), np.r_[[9.0] * 3, [8.999999] * 3, np.ones(80)], [4.0], [3.0, 0, 0, 0, 0, 0], np.ones(20)])
def test_solver_finds_leading_pairs_of_hard_spectra(values):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((len(values), len(values))))[0]
    matrix = (q * values) @ q.T
    e, v, left = whitening.jacobi_davidson(lambda u: matrix @ u, len(values), 4)
    k = min(4, len(values))
    assert np.allclose(e, values[:k], atol=1e-12 * values[0])
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-13
    assert left.max() <= 1e-12 * values[0] and np.abs(matrix @ v - v * e).max() <= 1e-12 * values[0]


def test_minres_solves_indefinite_equations():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    matrix = (q * np.r_[-3:0, 1:10]) @ q.T
    b = rng.standard_normal((12, 3))
    assert np.abs(matrix @ whitening.minres(lambda u: matrix @ u, b, 14, 1e-14) - b).max() < 1e-8


def test_whitening_of_odd_rows(spark):
    nan = float("nan")
    good = [(1, [0.0, 1.0], 1), (1, [0.0, 1.0], 1), (None, [1.0, 0.5], 1), (3, [-2.0, -0.001], None)]
    bad = [(7, None, 1), (8, [nan, 1.0], 1), (9, [None, 1.0], 1), (11, [], 1), (12, [1.0], 1), (13, [3e38, 1.0], 1)]
    df = frame(spark, good + bad).selectExpr("vec_id", "embedding", "1 AS x", "2 AS id", "3 AS n")
    got = whitening.whiten(df).toPandas()
    assert len(got) == 8 and set(got.component) == {1, 2} and set(got.n) == {3}
    assert got.vec_id.isna().sum() == 2 and abs(got.explained.drop_duplicates().sum() - 1) < 1e-12
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0  # no variance
    large = [(i, [float(2**42 * (i % 2)), float(i)], 1) for i in range(40)]
    far = whitening.whiten(spark.createDataFrame(large, "vec_id long, embedding array<double>, label int")).where("component = 1")
    assert far.where("deviation is null").count() == 40  # beyond a long

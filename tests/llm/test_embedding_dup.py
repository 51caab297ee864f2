"""Graph search for near vectors against brute force."""

import duckdb
import numpy as np
import pytest

from codequarry.llm import embedding_dup
from codequarry.llm.sql import EMBEDDING_DUP


def brute(ids, x, least=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in np.argwhere(near):
        parent[root(i)] = root(j)
    least_id = {}
    for i, d in enumerate(ids):
        least_id[root(i)] = min(d, least_id.get(root(i), d))
    return {d: (int(near[i].sum()), least_id[root(i)]) for i, d in enumerate(ids)}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(400, 32))
    parts = [rng.normal(size=(1500, 32))]
    for c in centers:  # tight clusters, some of them wider than a beam
        k = int(rng.choice([2, 3, 5])) if rng.random() > 0.02 else 120
        parts.append(c + 0.12 * rng.normal(size=(k, 32)))
    parts.append(np.repeat(rng.normal(size=(1, 32)), 300, axis=0))
    x = np.concatenate(parts).astype(np.float32)
    ids = rng.permutation(len(x)) * 3
    return ids.tolist(), x


def test_links_and_components(spark, vectors):
    ids, x = vectors
    rows = [(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    nan, inf = float("nan"), float("inf")
    odd = [(-1, None), (-2, [0.0] * 32), (-3, [nan] * 32), (-4, [None] * 32), (-5, []), (-6, [inf] * 32), (-7, [1.0, 2.0]), (-8, [2.0, 4.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd + [rows[5], rows[5]], "vec_id long, embedding array<float>").selectExpr("*", "1 as n", "2 as node", "3 as v", "4 as id")
    got = {}
    for r in embedding_dup.embedding_dup_digest(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
        assert r.kept == (r.vec_id == r.component_id)
    want = brute(ids, x.astype(np.float64))
    assert len(got[rows[5][0]]) == 3 and sum(map(len, got.values())) == len(rows) + len(odd) + 2
    for k in range(1, 7):
        assert got[-k] == [(0, -k)]
    assert got[-7] == [(1, -8)] and got[-8] == [(1, -8)] and got[None] == [(0, None)]
    wrong = [i for i in want if got[i][0] != want[i]]
    found, true = sum(min(got[i][0][0], want[i][0]) for i in want), sum(n for n, _ in want.values())
    assert all(got[i][0][0] <= want[i][0] for i in want) and found >= 0.995 * true
    assert len(wrong) <= 0.01 * len(want)


def test_matches_sql(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    got = sorted(tuple(r) for r in embedding_dup.embedding_dup_digest(spark.read.parquet(path)).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
        assert got == sorted(con.execute(EMBEDDING_DUP).fetchall())


def test_a_shard_is_searched_with_full_recall(vectors):
    _, x = vectors
    x = np.unique(x.astype(np.float64), axis=0)
    level = np.sort(np.minimum(3, np.floor(-np.log(np.random.default_rng(1).random(len(x))) / np.log(12))).astype(int))[::-1]
    g = embedding_dup.Graph(x, level)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = u @ u.T >= 0.95
    found = g.linked(x, 32, 0.95)
    hit = sum(truth[i][f].sum() for i, f in enumerate(found))
    assert hit >= 0.995 * truth.sum() and hit == sum(map(len, found))


def test_rare_links_are_audited(spark):
    """One pair in 2,000 vectors: the audit has classes with links to measure."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 24))
    x[1] = x[0] + 0.01
    classes = spark.createDataFrame([(i, 1, 24, v.tolist()) for i, v in enumerate(x)], "node long, n long, dim int, v array<double>")
    found = spark.createDataFrame([(0, 1), (1, 1)], "node long, n long")
    truth, asked = embedding_dup._audit(classes, found, 0.95, 8, "bigint")
    assert {tuple(r) for r in truth.collect()} == {(0, 1), (1, 0)} and asked.count() <= 8


def test_beams_widen_until_the_audit_passes(spark, vectors):
    """From beams of one node, the audit leads to wide enough ones."""
    ids, x = vectors
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embedding_dup.near_duplicates(df, beam=1).collect()}
    want = brute(ids, x.astype(np.float64))
    assert sum(min(got[i], want[i][0]) for i in want) >= 0.98 * sum(n for n, _ in want.values())


def test_empty_table(spark):
    assert embedding_dup.embedding_dup_digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0

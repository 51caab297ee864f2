"""MinHash near-duplicates against exact similarities of all pairs."""

import random

import duckdb
import pytest

from codequarry.llm import near_dup
from codequarry.llm.sql import NEAR_DUP


def exact(rows, k, percent):
    """Components over all pairs of the given (id, text) rows."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                c = len(a & b)
                if 100 * c >= percent * (len(a) + len(b) - c):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((str(d), len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def check(spark, rows, k, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as n", "3 as component", "4 as id")
    got = near_dup.near_duplicates(docs, k=k, percent=percent).collect()
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in got), key=str) == exact(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.fixture(scope="module")
def crowd():
    """A large group of near copies around the threshold, exact copies, chains and odd texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(220):
        w = base[:]
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, "One Text\tthat  many documents share, in\x0bother spacing") for i in range(60)]
    rows += [(3000, "ONE text that many documents share, in other spacing"), (4000, None), (4001, ""), (4002, " \n"), (4003, "a"), (4004, "A"), (4005, "a b"), (None, "a b"), (None, "only here without a name")]
    chain = [word() for _ in range(60)]
    for i in range(12):
        rows.append((5000 + i, " ".join(chain[i : i + 45])))
    rows += rows[:3]
    rng.shuffle(rows)
    return rows


def test_crowd_matches_all_pairs(spark, crowd):
    check(spark, crowd, 3, 85)


def test_library_default_matches_all_pairs(spark, crowd):
    check(spark, crowd, 5, 80)


def test_documents_match_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in near_dup.near_dup_digest(docs).collect())
    with duckdb.connect() as con:
        con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
        want = sorted(con.execute(NEAR_DUP).fetchall())
    assert got == want


def test_drop_keeps_one_of_each_group(spark, crowd):
    docs = spark.createDataFrame(crowd, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as component")
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect() if r.doc_id is not None]
    want = {c for _, _, c in exact(crowd, 5, 80) if c is not None} | {4000, 4001, 4002}
    assert sorted(ids) == sorted(want)


def test_empty_table(spark):
    assert near_dup.near_dup_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bounds_widen_with_the_batches():
    most = near_dup.most_unequal(0.85, 1e-5)
    assert most == sorted(most) and all(n * 64 * 0.075 < m for n, m in zip(near_dup.BATCHES, most, strict=True))


def test_no_step_has_a_long_plan(spark):
    """The driver plans a query anew after each of its stages, so a long plan takes most of its memory."""
    rows = [(i, " ".join(f"w{(i // 2) * 40 + j}" for j in range(40)) + (" x" if i % 2 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for out in (near_dup.near_dup_digest(docs), near_dup.drop_near_duplicates(docs)):
        assert out._jdf.queryExecution().executedPlan().toString().count(" Exchange ") <= 4
        assert out.count() in (20, 40)

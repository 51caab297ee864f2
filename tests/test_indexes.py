"""The versioned store, the term index and the vector collection."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.functions import cosine
from codequarry.operators import knowledge, search, vector_index, vectors
from codequarry.operators.knowledge import Knowledge
from codequarry.operators.term_index import TermIndex, term_grams
from codequarry.operators.vector_index import NO_CELL, Collection
from codequarry.sources import stores
from codequarry.sources.versions import PART, Change, Store, WriteConflict, part_of


def services(spark, rows):
    return Knowledge.of(spark, services=spark.createDataFrame(rows, "repo string, name string, ord long"))


def names(kb):
    return sorted((r.repo, r.name) for r in kb.services.select("repo", "name").collect())


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet")}


def test_a_save_that_fails_leaves_the_old_state(spark, tmp_path):
    folder = str(tmp_path)
    stores.save(services(spark, [("a", "A", 0), ("b", "B", 1)]), folder)
    bad = services(spark, [("a", "new", 0)])
    # fails while the last table is being written, when others already are
    bad.semantic_layers = bad.semantic_layers.unionByName(spark.range(1).selectExpr("cast(null as string) repo_name", "cast(raise_error('lost') as bigint) ord"), allowMissingColumns=True)
    for write in (stores.save, stores.upsert):
        with pytest.raises(Exception, match="lost"):
            write(bad, folder)
        assert names(stores.load(spark, folder)) == [("a", "A"), ("b", "B")] and Store(spark, folder).versions() == [1]
    assert Store(spark, folder).vacuum() > 0  # what the failed jobs have left
    assert names(stores.load(spark, folder)) == [("a", "A"), ("b", "B")]


def test_upsert_writes_touched_buckets_only_and_versions_stay(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(f"r{k}", f"N{j}", k * 3 + j) for k in range(20) for j in range(3)]
    stores.save(services(spark, rows), folder, parts=8)
    before = files(folder)
    pinned = stores.load(spark, folder, 1)
    state = stores.upsert(services(spark, [("r4", "new", 0)]), folder)
    new = files(folder) - before
    assert before <= files(folder) and len({f.split(f"{PART}=")[1].split("/")[0] for f in new}) == 1
    want = sorted([(r, n) for r, n, _ in rows if r != "r4"] + [("r4", "new")])
    assert names(stores.load(spark, folder)) == want and names(pinned) == sorted((r, n) for r, n, _ in rows)
    one = stores.load(spark, folder, repo="r4")
    assert names(one) == [("r4", "new")]
    assert len(one.services.inputFiles()) == 1  # of its bucket
    stores.upsert(Knowledge.of(spark), folder, spark.createDataFrame([("r5",)], "repo string"))
    assert "r5" not in {r for r, _ in names(stores.load(spark, folder))}
    assert names(stores.load(spark, folder, state.version)) == want
    Store(spark, folder).vacuum(keep=1)
    with pytest.raises(LookupError):
        stores.load(spark, folder, 1)
    assert "r5" not in {r for r, _ in names(stores.load(spark, folder))}


def test_writers_at_the_same_time(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    frame = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], f"{PART} int, v string")
    base = store.commit({"t": Change(frame(range(4), "old"))})
    store.commit({"t": Change(frame([1], "one"), [1])}, base)
    store.commit({"t": Change(frame([2], "two"), [2])}, base)  # of other parts: goes on top
    with pytest.raises(WriteConflict):
        store.commit({"t": Change(frame([1], "late"), [1])}, base)
    with pytest.raises(ValueError):
        store.commit({"t": Change(frame([3], "x"), [2])})
    assert sorted((r[PART], r.v) for r in store.read("t").collect()) == [(0, "old"), (1, "one"), (2, "two"), (3, "old")]
    store.commit({"t": Change(frame([], "x"), [0, 1, 2])})
    assert [r.v for r in store.read("t").collect()] == ["old"] and store.read("t", parts=[0]).count() == 0
    assert store.state(0).tables == {} and len(store.versions()) == 4


def test_parts_are_pruned_in_the_plan(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({"t": Change(spark.range(1000).withColumn(PART, part_of("id", parts=10)))})
    df = store.read("t", parts=[3])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_part", plan)
    assert all(f"{PART}=3/" in f for f in df.inputFiles()) and 0 < df.count() < 1000


WORDS = ["user", "User Service", "abc", "ab", "a", "", "Überblick", "a.b*c", "xx" * 300 + "needle", "İstanbul"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(3)
    text = lambda: rng.choice([None, rng.choice(WORDS), " ".join(rng.choices(WORDS, k=3))])
    field = "named_struct('name', f, 'type', 't', 'constraints', cast(null as array<string>), 'description', d, 'annotations', cast(null as array<string>), 'tags', cast(null as string), 'json_name', cast(null as string), 'optional', true, 'nullable', true, 'field_number', 1)"
    rows = spark.createDataFrame([(f"r{k % 7}", text(), text(), text(), text(), k) for k in range(300)], "repo string, name string, description string, f string, d string, ord long")
    recipe = "named_struct('question', name, 'steps', cast(null as array<struct<action:string,service:string,purpose:string>>), 'answer_format', description)"
    kb = Knowledge.of(
        spark,
        schemas=rows.selectExpr("repo", "name", "description", f"array({field}) as fields", "ord"),
        apis=rows.selectExpr("repo", "name as path", "d as method", "f as handler", "description", "ord"),
        services=rows.selectExpr("repo", "name", "description", "ord"),
        dependencies=rows.selectExpr("repo", "name", "f as ecosystem", "ord"),
        semantic_layers=rows.selectExpr("repo as repo_name", f"array({recipe}) as query_recipes", "ord"),
    )
    return kb, TermIndex.build(kb, str(tmp_path_factory.mktemp("terms")), parts=4, gram_parts=2)


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("query", ["needle", "USER serv ab", "über stanbul zzz", "nothing like it", ""])
def test_searches_by_index_are_searches_by_scan(indexed, query):
    kb, index = indexed
    keep = ["kind", "name", "repo", "score", "ord", "branch"]
    assert rows_of(index.hits(query).select(*keep)) == rows_of(search.hits(kb, query).select(*keep))
    assert [r.score for r in index.search(query, 9).collect()] == [r.score for r in search.search(kb, query, 9).collect()]


@pytest.mark.parametrize("value", ["Needle", "ab", "", "ÜBER"])
def test_lookups_by_index_are_lookups_by_scan(indexed, value):
    kb, index = indexed
    assert rows_of(index.find_contains("schemas", "name", value)) == rows_of(knowledge.find_contains(kb.schemas, "name", value))
    assert rows_of(index.find_exact("dependencies", "ecosystem", value)) == rows_of(knowledge.find_exact(kb.dependencies, "ecosystem", value))
    assert rows_of(index.find_bidirectional("services", "name", value)) == rows_of(knowledge.find_bidirectional(kb.services, "name", value))
    assert rows_of(index.find_api(value, "user")) == rows_of(knowledge.find_api(kb.apis, value, "user"))
    assert rows_of(index.list_recipes(value)) == rows_of(knowledge.list_recipes(kb.semantic_layers, value))


def test_records_of_equal_texts_share_postings(spark, tmp_path):
    def built(copies):
        rows = [(f"repo-{k}", f"Pkg-{k % 40}", "pip" if k % 3 else None, k) for k in range(40 * copies)]
        kb = Knowledge.of(spark, dependencies=spark.createDataFrame(rows, "repo string, name string, ecosystem string, ord long"))
        return kb, TermIndex.build(kb, str(tmp_path / f"{copies}"), parts=4, gram_parts=2)

    size = lambda index: index.store.read("postings", index.state).count()
    (_, few), (kb, many) = built(3), built(30)
    assert size(few) == size(many)  # ten times the rows before
    want = knowledge.dependency_usage(kb.dependencies, "PKG-12").select("repo", "name", "count", "ord")
    got = many.dependency_usage("PKG-12").select("repo", "name", "count", "ord")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 30
    assert many.look_up(["pkg-12"], "dependencies")["dependencies"].buckets < 4


def test_an_index_reads_candidates(indexed):
    _, index = indexed
    some, none = (index.look_up([t], "schemas")["schemas"] for t in ("needle", "absent words"))
    assert 0 < some.rows.count() < 300 and (none.buckets, none.rows.count()) == (0, 0)
    index.state.meta["most"] = 10
    try:
        assert index.look_up(["use"], "schemas")["schemas"].rows.count() == 300  # a scan is no dearer
    finally:
        index.state.meta["most"] = 100_000
    assert term_grams("Needle") == ["nee", "eed", "edl", "dle"] and term_grams("Ab") == ["ab"]


KIND = "id long, kind string, embedding array<float>, ord long"


def clustered(n=1500, d=16, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(25, d))
    return (middle[rng.integers(0, 25, n)] + 0.2 * rng.normal(size=(n, d))).astype(np.float32)


@pytest.fixture(scope="module")
def collection(spark, tmp_path_factory):
    x = clustered()
    nan = float("nan")
    rows = [(k, "ab"[k % 2], v.tolist(), k) for k, v in enumerate(x)] + [(5000, "a", None, 0), (5001, "a", [0.0] * 16, 0), (5002, "a", [nan] * 16, 0), (5003, "b", [], 0)]
    df = spark.createDataFrame(rows, KIND)
    return df, Collection.build(df, str(tmp_path_factory.mktemp("vectors")))


def test_exact_search_is_the_scan(collection):
    df, c = collection
    for k in range(5):
        at = np.random.default_rng(k).normal(size=16).tolist()
        want = vectors.search(df.where("id < 5000"), at, 10).collect()
        got = c.search_exact(at, 10).collect()
        assert [round(r.similarity, 4) for r in got] == [r.similarity for r in want]
        want = vectors.search(df.where("id < 5000"), at, 4, kind=("kind", "b")).collect()
        assert [r.id for r in c.search_exact(at, 4, where=F.col("kind") == "b").collect()] == [r.id for r in want]


def test_a_search_reads_few_cells_with_the_recall_asked_for(spark, collection):
    df, c = collection
    assert c.meta["probes"] < len(c.cell_ids) / 4
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(clustered(60, seed=9) + 0)], "query_id long, query array<float>")
    ids = lambda p: {(r.query_id, r.id) for r in c.search_many(queries, 10, p).collect()}
    assert len(ids(None) & ids(len(c.cell_ids))) >= 0.9 * 600
    one = c.search(df.first().embedding, 10)
    read = {f.split(f"{PART}=")[1].split("/")[0] for f in one.inputFiles()}
    assert len(read) == c.meta["probes"] and one.first().id == 0


def test_many_queries_are_multiplied_in_blocks_to_the_same_bits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "ROWS", 64)
    monkeypatch.setattr(vector_index, "QUERIES", 16)
    monkeypatch.setattr(vector_index, "AT_A_TIME", 4096)
    x = clustered(300, seed=4).astype(np.float32)
    x = np.concatenate([x, x[:1].repeat(150, 0), 3 * x[:40]])  # copies, and others of the same direction
    rows = [(k, "a", v.tolist(), 0) for k, v in enumerate(x)] + [(1000, "a", None, 0), (1001, "a", [0.0] * 16, 0)]
    df = spark.createDataFrame(rows, KIND)
    c = Collection.build(df, str(tmp_path / "c"))
    asked = df.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = df.where("id < 1000").crossJoin(asked.where("query_id < 1000")).withColumn("similarity", cosine(F.col("embedding"), F.col("query")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    want = pairs.withColumn("rank", rank).where("rank <= 10").select("query_id", "id", "similarity", "rank")
    got = c.search_many(asked, 10, len(c.cell_ids))
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan  # no row for each pair
    assert {(r.query_id, r.rank) for r in c.search_many(asked, 3, 1).collect()} >= {(k, 1) for k in range(0, 300, 5)}


def test_a_collection_is_opened_again_and_upserted(spark, collection):
    df, c = collection
    c = Collection(spark, c.store.folder)
    assert c.rows().count() == 1504 and c.rows().where(F.col(PART) == NO_CELL).count() == 4
    assert {r.cell: r.n for r in c.stats().collect()}[NO_CELL] == 4 and c.stats().agg(F.sum("n")).first()[0] == 1504
    before = files(c.store.folder.removeprefix("file:"))
    moved = spark.createDataFrame([(7, "a", [9.0] + [0.0] * 15, 1), (7, "a", [0.0] * 15 + [9.0], 2), (9000, "b", [0.0] * 15 + [8.0], 1)], KIND)
    new = c.upsert(moved, order="ord")
    touched = {f.split(f"{PART}=")[1].split("/")[0] for f in files(c.store.folder.removeprefix("file:")) - before if f.startswith("vectors")}
    assert len(touched) <= 2 and new.rows().count() == 1505
    top = new.search_exact([0.0] * 15 + [1.0], 2).collect()
    assert [r.id for r in top] == [7, 9000] and new.rows().where("id = 7").count() == 1
    assert [r.id for r in new.similar_to(7, 1).collect()] == [9000] and new.similar_to(-1).count() == 0
    assert c.rows().count() == 1504  # the version that was opened


def test_collections_of_few_or_no_vectors(spark, tmp_path):
    none = Collection.build(spark.createDataFrame([], KIND), str(tmp_path / "none"))
    assert none.search_exact([1.0], 5).count() == 0 and none.search([1.0], 5).count() == 0
    one = Collection.build(spark.createDataFrame([(1, "a", [1.0, 2.0], 0)], KIND), str(tmp_path / "one"))
    assert [r.id for r in one.search([2.0, 1.0], 5).collect()] == [1]


def test_a_lookup_indexes_the_table_it_looks_into(spark, tmp_path):
    """index_find_api and index_dependency_usage built the postings of all tables before."""
    rows = spark.createDataFrame([(f"r{k}", f"Pkg-{k}", k) for k in range(30)], "repo string, name string, ord long")
    kb = Knowledge.of(spark, dependencies=rows, apis=rows.selectExpr("repo", "name as path", "ord"))
    first = TermIndex.build(kb, str(tmp_path), parts=4, gram_parts=2, kinds=("apis",))
    assert set(first.state.tables) == {"apis", "postings", "grams"}
    assert first.find_api("PKG-12").count() == 1
    with pytest.raises(LookupError):
        first.dependency_usage("pkg-12")
    both = first.having(kb, "apis", "dependencies")
    assert both.dependency_usage("pkg-12").count() == both.find_api("pkg-12").count() == 1
    runs = lambda index, name: set(index.state.tables[name]["parts"].items())
    assert runs(first, "apis") == runs(both, "apis") and runs(first, "postings") < runs(both, "postings")
    assert both.having(kb, "dependencies") is both
    assert rows_of(both.find_exact("apis", "path", "pkg-7")) == rows_of(knowledge.find_exact(kb.apis, "path", "pkg-7"))


def test_numbers_of_records_are_counted_from_stored_postings(spark, tmp_path, monkeypatch):
    """They were made of the tables' texts once more before."""
    rows = spark.createDataFrame([(f"r{k}", f"Pkg-{k}", k) for k in range(30)], "repo string, name string, ord long")
    read, names = Store.read, []
    monkeypatch.setattr(Store, "read", lambda self, name, *more: (names.append(name), read(self, name, *more))[1])
    index = TermIndex.build(Knowledge.of(spark, dependencies=rows), str(tmp_path), parts=4, gram_parts=2, kinds=("dependencies",))
    assert names == ["dependencies", "postings"]
    n = {r.gram: r.n for r in index.store.read("grams", index.state).collect()}
    assert n["pkg"] == 30 and n["-12"] == 1

"""Work that is dear for each row is dealt over tasks, however few the files and row groups of a table."""

import ast
import random
import time

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from codequarry.operators import relations
from codequarry.operators.extract import closed, closed_each, java, jsts, places, pyast
from codequarry.operators.knowledge import Knowledge
from codequarry.sources import stores
from codequarry.sources.versions import PART, Change, Store, WriteConflict

SF = "/root/testdata/sf0.001"
SPREAD = [
    "py_routes",
    "py_models",
    "py_services",
    "js_services",
    "java_services",
    "java_entities",
    "sql_columns",
    "prisma_fields",
    "java_relations",
]


@pytest.mark.parametrize("name", SPREAD)
def test_files_of_one_row_group_are_dealt_over_tasks(spark, name):
    tasks = entry.queries()[name](spark, SF).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= spark.sparkContext.defaultParallelism  # one before
    most, all_ = max(r["count"] for r in tasks), sum(r["count"] for r in tasks)
    assert most <= 4 * all_ / len(tasks)


@pytest.mark.parametrize("name", ["py_models", "js_services", "java_entities", "sql_columns", "prisma_fields", "java_relations"])
def test_lists_of_a_record_are_made_once(spark, name):
    """A filter on the list, moved below the step that makes it, made it two or three times."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "+- Filter" in line or line.startswith("Filter")]
    assert filters and not any(f in line for line in filters for f in ("regexp_", "RLIKE", "from_json"))


def test_only_records_of_the_kinds_asked_for_leave_python(spark):
    source = "class A(Base):\n    x: int = 1\nclass BService:\n    def f(self): ...\n@app.get('/p')\ndef g(): ...\nclass CService(BaseModel):\n    y: str\n"
    files = spark.createDataFrame([("a.py", source), ("b.py", "def broken(:"), ("c.py", None)], "path string, content string")
    all_ = pyast.parse(files).collect()
    assert {r.kind for r in all_} == {"schema", "service", "api", "error"}
    for kinds in (["service"], ["schema", "api"], ["error"], []):
        assert sorted(pyast.parse(files, kinds=kinds).collect()) == sorted(r for r in all_ if r.kind in kinds)


def test_bodies_of_few_hits_are_those_of_many(spark):
    rng = random.Random(7)
    texts = ["", "class", "}}class{", "class {{}", "é𝄞class é { } class }", *("".join(rng.choices(["{", "}", "class ", "é", "𝄞x\n"], [4, 4, 2, 3, 3], k=rng.randint(1, 60))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, content string").withColumn("h", places(F.col("content"), "class"))
    got = df.select("k", closed(F.col("content"), F.col("h")).alias("many"), closed_each(F.col("content"), F.col("h")).alias("few")).collect()
    assert all(r.many == r.few for r in got) and sum(len(r.few) for r in got) > 300


@pytest.mark.parametrize(("services", "code", "names"), [(java.services, "@Service\nclass A { String s = \"%s\"; void f() { BRepository.x(); } } %s", ["B"]), (jsts.services, "class AService { s = '%s'; xasync(b: C) { } }\n// %s", ["xasync"])])
def test_long_words_and_ends_without_braces_are_read_once(spark, services, code, names):
    """The time grew with the square of a word's length, and of that of the text behind the last brace."""
    files = spark.createDataFrame([("a", code % ("a" * 200_000, "; " * 100_000))], "path string, content string")
    start = time.perf_counter()
    [row] = services(files).collect()
    assert time.perf_counter() - start < 20
    assert (row.data_accessed if services is java.services else [m.name for m in row.methods]) == names


def test_routing_makes_no_row_for_each_pair(spark):
    rows = [(f"r{k}" if k else None, [("E", f"d{k}", k % 2 == 0), ("F" if k % 4 else "", None, None)], k) for k in range(40)]
    rows += [("r3", [("E", "of r3", True), ("G", "alone", True)], 40)]
    kb = Knowledge.of(spark, contexts=spark.createDataFrame(rows, "repo_name string, data_ownership array<struct<entity:string,description:string,is_source_of_truth:boolean>>, ord long"))
    routed = relations.data_routing(kb.contexts)
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # lists are made before sources meet them
    got = {(r.entity, r.ord): [(c.service, c.notes) for c in r.also_available_in] for r in routed.collect()}
    copies = [(f"r{k}", f"d{k}") for k in range(1, 40, 2)]
    assert got.keys() == {("E", k) for k in range(0, 41, 2)} | {("G", 40)} and got["G", 40] == []
    assert got["E", 0] == [] and got["E", 2] == copies and got["E", 40] == [c for c in copies if c[0] != "r3"]


def test_statements_are_walked_in_the_order_of_the_tree():
    source = "x = [lambda: 1]\nif x:\n    class A(Base):\n        é: int = 'é'; y: str\r\nelse:\n    try: pass\n    except E:\n        def f(a=(lambda: 2)): ...\n    finally:\n        class B(Base): z: int = 1\nmatch x:\n    case 1:\n        async def g():\n            class C(Base):\n                q: int = \"\"\"\r\n\f\"\"\"\n"
    tree = ast.parse(source)
    kinds = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)
    found = [n for n in pyast.statements(tree) if isinstance(n, kinds)]
    assert found == [n for n in ast.walk(tree) if isinstance(n, kinds)] and len(found) == 5
    cut = pyast.LINE.findall(source)
    assert [pyast.segment(n, cut) for n in found] == [ast.get_source_segment(source, n) for n in found]


def test_an_upsert_writes_only_what_it_changes(spark, tmp_path):
    """It wrote the buckets of its repositories in all tables before, and a save shuffled all rows."""
    rows = spark.createDataFrame([(f"r{k}", f"n{k}", k) for k in range(40)], "repo string, name string, ord long")
    store, folder = Store(spark, str(tmp_path)), str(tmp_path)
    first = stores.save(Knowledge.of(spark, services=rows, dependencies=rows.where("ord < 20")), folder)
    one = rows.where("repo = 'r30'").withColumn("name", F.lit("new"))
    second = stores.upsert(Knowledge.of(spark, services=one), folder)
    assert second.tables["dependencies"]["parts"] == first.tables["dependencies"]["parts"]  # r30 has none
    changed = {p for p, run in second.tables["services"]["parts"].items() if first.tables["services"]["parts"].get(p) != run}
    assert len(changed) == 1
    assert sorted(r.name for r in stores.load(spark, folder).services.collect()) == sorted(["new", *(f"n{k}" for k in range(40) if k != 30)])
    assert stores.load(spark, folder).dependencies.count() == 20
    stores.upsert(Knowledge.of(spark, services=rows.where("repo = 'r3'")), folder)  # its dependencies go
    assert {r.repo for r in stores.load(spark, folder).dependencies.collect()} == {f"r{k}" for k in range(20)} - {"r3"}
    with pytest.raises(ValueError):
        stores.upsert(Knowledge.of(spark, services=rows), folder, rows.where("repo = 'r3'").select("repo"))
    with pytest.raises(WriteConflict):  # the bucket of r30 was changed since
        store.commit({"services": Change(rows.withColumn(PART, F.lit(0)).limit(0), [], guarded=changed)}, first)

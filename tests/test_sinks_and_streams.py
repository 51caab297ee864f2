"""Files written from tasks, the change feed, stateful ingest, and stored chunks."""

import json

import pytest
from pyspark.sql import functions as F

from codequarry.operators import manifest
from codequarry.plans import pipeline, plugins
from codequarry.sources import changes, page_files, stores
from codequarry.sources.versions import Store
from codequarry.streaming import ingest


def tree(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file()}


def test_files_are_written_by_tasks_all_or_none(spark, tmp_path):
    target = tmp_path / "out"
    rows = spark.range(200).selectExpr("concat('d', id % 7, '/f', id, '.md') as file", "concat('body ', id) as body").repartition(5)
    page_files.write_tree(rows, str(target))
    assert tree(target) == {f"d{k % 7}/f{k}.md": f"body {k}" for k in range(200)}
    page_files.write_tree(rows.limit(3).withColumn("body", F.lit(None).cast("string")), str(target))
    assert set(tree(target).values()) == {""} and len(tree(target)) == 3
    before = tree(target)
    for bad in ("if(id = 150, raise_error('lost'), 'x')", "if(id = 150, '../x', concat('f', id))"):
        failing = spark.range(200).selectExpr(f"cast({bad} as string) as file", "'b' as body").repartition(5)
        with pytest.raises(Exception, match="lost|no name of a file"):
            page_files.write_tree(failing, str(target))
        assert tree(target) == before and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="FileExists|out"):
        page_files.write_tree(rows, str(target), overwrite=False)
    assert tree(target) == before
    page_files.write_tree(rows.limit(0), str(target))
    assert target.is_dir() and not tree(target)


def run(df, name, folder):
    got = []
    query = df.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return got


def test_each_change_arrives_once(spark, tmp_path):
    repo = tmp_path / "shop"
    (repo / "src").mkdir(parents=True)
    (repo / "node_modules").mkdir()
    for name in ("a.py", "src/b.py", "c.txt", "node_modules/x.js"):
        (repo / name).write_text(name)
    feed = lambda: changes.stream_changes(spark, str(tmp_path / "state"), str(repo), maxsize=1000)
    seen = lambda rows: sorted((r.path, r.change, bytes(r.content) if r.content is not None else None) for r in rows)
    assert seen(run(feed(), "q", tmp_path)) == [("a.py", "added", b"a.py"), ("c.txt", "added", b"c.txt"), ("src/b.py", "added", b"src/b.py")]
    assert run(feed(), "q", tmp_path) == []
    (repo / "a.py").write_text("edited")
    (repo / "new.py").write_text("x" * 2000)
    (repo / "c.txt").unlink()
    assert seen(run(feed(), "q", tmp_path)) == [("a.py", "changed", b"edited"), ("c.txt", "deleted", None), ("new.py", "added", None)]
    assert run(feed(), "q", tmp_path) == []
    assert len(list((tmp_path / "state").glob("*.gz"))) <= 2


def test_only_real_changes_pass(spark, tmp_path):
    """Batches as files of a folder: a replay, a touched file and an unknown deletion give nothing."""
    source = tmp_path / "in"
    batches = [
        [("r", "a", "added", "1"), ("r", "b", "added", "2"), ("s", "a", "added", "1")],
        [("r", "a", "added", "1"), ("r", "b", "added", "2"), ("s", "a", "added", "1")],
        [("r", "a", "changed", "1"), ("r", "b", "changed", "3"), ("r", "x", "deleted", None)],
        [("s", "a", "deleted", None), ("r", "c", "added", "")],
        [("s", "a", "added", "9"), ("r", "c", "deleted", None)],
    ]
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "repo string, path string, change string, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("repo string, path string, change string, text string").parquet(str(source))
        real = changes.real_changes(stream.select("repo", "path", "change", F.col("text").cast("binary").alias("content")))
        got.append(sorted((r.repo, r.path, r.change) for r in run(real, "q", tmp_path)))
    assert got == [
        [("r", "a", "added"), ("r", "b", "added"), ("s", "a", "added")], [], [("r", "b", "changed")],
        [("r", "c", "added"), ("s", "a", "deleted")], [("r", "c", "deleted"), ("s", "a", "added")],
    ]


def test_chunks_with_rows_without_ids(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/a.json").write_text("\n".join(json.dumps({"id": f"c{k}", "text": str(k)}) for k in range(20)) + '\n{"id": null, "text": "x"}\n\n')
    (tmp_path / "lines/b.json").write_text("\n" + json.dumps([{"id": "c1", "text": "later"}, {"id": "z", "text": "1"}, {"id": "z", "text": "2"}], indent=1))
    got = {r.id: r.text for r in stores.load_chunks(spark, str(tmp_path / "lines")).collect()}
    assert got == {f"c{k}": str(k) for k in range(20)} | {"c1": "later", "z": "2"}


def test_a_plugin_that_raises_loses_no_other_file(spark):
    def headings(path, content):
        for line in content.splitlines():
            if line == "!":
                raise ValueError("no")
            yield {"name": line, "type": "heading", "fields": [{"name": "f", "type": "t"}], "relationships": []}

    rows = [("r", "a.txt", "A\nB"), ("r", "b.txt", "C\n!"), ("r", "c.txt", "D"), ("r", "n.txt", None), ("r", "x.md", "E")]
    kb, errors = pipeline.extract(spark.createDataFrame(rows, "repo string, path string, content string"), [plugins.plugin("text", "schemas", headings, [".txt"])])
    got = [(r.source_file, r.name, r.fields[0].name) for r in kb.schemas.orderBy("ord").collect()]
    assert got == [("a.txt", "A", "f"), ("a.txt", "B", "f"), ("b.txt", "C", "f"), ("c.txt", "D", "f")]
    assert sorted((r.source_file, r.description.split(":")[0]) for r in errors.collect()) == [("b.txt", "ValueError"), ("n.txt", "AttributeError")]
    with pytest.raises(Exception, match="must be a string"):
        plugins.table_function(headings)(F.lit(1), F.lit("x")).collect()


def test_changes_become_versions_of_a_store(spark, tmp_path):
    repo, store = tmp_path / "shop", str(tmp_path / "kb")
    repo.mkdir()
    (repo / "a.py").write_text("class AService:\n    def f(self): pass\n")
    (repo / "b.py").write_text("class BService:\n    def f(self): pass\n")
    feed = lambda: changes.real_changes(changes.stream_changes(spark, str(tmp_path / "state"), str(repo)))

    def names():
        ingest.ingest_changes(feed(), store, str(tmp_path / "q")).awaitTermination()
        return sorted(r.name for r in stores.load(spark, store).services.collect())

    assert names() == ["AService", "BService"]
    (repo / "a.py").write_text("class NewService:\n    def f(self): pass\n")
    (repo / "b.py").unlink()
    assert names() == ["NewService"] and names() == ["NewService"]
    assert len(Store(spark, store).versions()) == 2
    rows = spark.createDataFrame([("data_routing", "{}")], "kind string, body string")
    assert stores.get_relationships(spark, store).count() == 0
    stores.set_relationships(rows, store)
    assert [tuple(r) for r in stores.get_relationships(spark, store).collect()] == [("data_routing", "{}")]


def test_languages_for_a_model(spark):
    paths = spark.createDataFrame([("a/B.PY",), ("c.toml",), ("d",), ("e.tsx",)], "p string")
    assert [r[0] for r in paths.select(manifest.model_language(F.col("p"))).collect()] == ["python", "unknown", "unknown", "typescript"]

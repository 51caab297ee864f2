"""Files to knowledge, stores, manifest, enrichment and streaming, on small inputs."""

import json
import random

import pytest

from codequarry.operators import answers, enrich, knowledge, manifest, search, vectors
from codequarry.operators.extract import pyast
from codequarry.operators.knowledge import Knowledge
from codequarry.plans import pipeline
from codequarry.sources import files as source
from codequarry.sources import stores
from codequarry.streaming import ingest

PY = 'class UserService:\n    """Keeps users."""\n    def create_user(self, email: str, name: str) -> User:\n        return 1\n'
FILES = {
    "src/user_service.py": PY,
    "src/_hidden.py": "x = 1\n",
    "src/broken.py": "def broken(:",
    "requirements.txt": "fastapi==0.109.0\n",
    "db/schema.sql": "CREATE TABLE users (id INT PRIMARY KEY, email VARCHAR(99) UNIQUE);",
    "conf/bad.yaml": "a: [unclosed",
    "conf/list.json": "[1, 2]",
    "src/many.py": "class BService:\n    def run(self):\n        pass\n\nclass AService:\n    def run(self):\n        pass\n",
    "api.json": json.dumps({"openapi": "3", "paths": {"/api/users": {"get": {"operationId": "list_users"}}}}),
    "node_modules/skip.js": "app.get('/no', f)",
    "logo.png": "x",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repos") / "shop"
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    (root / "bad.txt").write_bytes(b"a\xffb")
    (root / ".git").mkdir()
    return root


@pytest.fixture(scope="module")
def extracted(spark, repo):
    kb, errors = pipeline.extract(source.as_text(source.read_files(spark, str(repo))))
    return kb, errors


def test_file_source_lists_hidden_names_and_prunes(spark, repo):
    rows = {r.path: r for r in source.as_text(source.read_files(spark, str(repo))).collect()}
    assert set(rows) == (set(FILES) | {"bad.txt"}) - {"node_modules/skip.js"}
    assert rows["bad.txt"].content == "ab" and rows["src/_hidden.py"].repo == "shop"
    assert source.read_files(spark, str(repo), extensions=".py", maxsize="30").count() == 2
    assert source.discover_local([str(repo.parent)]) == [repo] and source.discover_clones(str(repo.parent)) == [repo]


def test_extract_and_find(extracted):
    kb, errors = extracted
    services = kb.services.orderBy("ord").collect()
    assert [r.name for r in services] == ["BService", "AService", "UserService"]  # by path, then place in the file
    assert (services[2].methods[0].name, services[2].methods[0].params[0].name) == ("create_user", "email")
    assert [(r.name, r.version, r.ecosystem) for r in kb.dependencies.collect()] == [("fastapi", "0.109.0", "pip")]
    assert [(r.repo, r.name, len(r.fields)) for r in kb.schemas.collect()] == [("shop", "users", 2)]
    assert [(r.path, r.method, r.handler) for r in kb.apis.collect()] == [("/api/users", "GET", "list_users")]
    assert sorted(r.source_file for r in errors.collect()) == ["conf/bad.yaml", "src/broken.py"]
    assert knowledge.find_exact(kb.schemas, "name", "USERS").count() == 1
    s = knowledge.summary(kb).first()
    assert (s.total_schemas, s.total_apis, s.total_services, s.total_dependencies) == (1, 1, 3, 1)
    assert [r.kind for r in search.search(kb, "user", 10).collect()] and search.search(kb, "nothing like it", 10).count() == 0
    assert search.search(kb, "user", 1).count() == 1


def test_registry():
    assert pipeline.languages_of("a/b.py")[0] == "python" and pipeline.languages_of("a.xyz") == []
    assert {"python", "java", "go", "javascript"} <= {x.language for x in pipeline.default_extractors()}


def test_stores_round_trip(spark, extracted, tmp_path):
    kb, _ = extracted
    stores.save(kb, str(tmp_path / "kb"))
    again = stores.load(spark, str(tmp_path / "kb"))
    for name, df in kb.named().items():
        assert sorted(map(str, df.collect())) == sorted(map(str, again.named()[name].select(*df.columns).collect()))
    whole = {"schemas": [{"repo": "r", "name": "User", "type": "model", "fields": [{"name": "id", "type": "int"}]}, {"name": "B"}], "services": [], "contexts": []}
    (tmp_path / "kb.json").write_text(json.dumps(whole, indent=2))
    loaded = stores.load_json(spark, str(tmp_path / "kb.json"))
    assert [(r.name, r.ord, len(r.fields)) for r in loaded.schemas.orderBy("ord").collect()] == [("User", 0, 1), ("B", 1, 0)]
    assert stores.load_json(spark, str(tmp_path / "none.json")).schemas.count() == 0
    stores.save_tree(kb, str(tmp_path / "docs"), {"data_routing": [1]})
    assert "| id | INT | primary_key |" in (tmp_path / "docs/markdown/schemas/users.md").read_text()
    assert json.loads((tmp_path / "docs/context/relationships.json").read_text()) == {"data_routing": [1]}
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("docs")) == ["docs"]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "text": "1"}, {"id": "a", "text": "2"}]))
    assert [r.text for r in stores.load_chunks(spark, str(tmp_path / "c.json")).collect()] == ["2"]


def test_what_is_saved_is_loaded(spark, tmp_path):
    """Fifty records through each pair of save and load."""
    rows = spark.range(50).selectExpr("'r' as repo", "concat('S', id) as name", "'model' as type", "concat('f', id) as source_file", "id as ord")
    kb = Knowledge.of(spark, schemas=rows)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    stores.save_json(kb, str(tmp_path / "json"))
    assert same(kb.schemas, stores.load_json_tables(spark, str(tmp_path / "json")).schemas)
    stores.save_file(kb, str(tmp_path / "kb.json"), {"data_routing": [1]})
    assert same(kb.schemas, stores.load_json(spark, str(tmp_path / "kb.json")).schemas)
    whole = json.loads((tmp_path / "kb.json").read_text())
    assert whole["summary"]["total_schemas"] == 50 and len(whole["schemas"]) == 50 and whole["apis"] == []
    assert stores.load_relationships(str(tmp_path / "kb.json")) == {"data_routing": [1]} and stores.load_relationships(str(tmp_path / "no")) == {}
    stores.save_chunks(kb, str(tmp_path / "chunks"))
    chunks = stores.load_chunks(spark, str(tmp_path / "chunks"))
    assert chunks.count() == 50 and {r.id for r in chunks.collect()} == {f"schema:S{k}:f{k}" for k in range(50)}
    stores.save_all(kb, str(tmp_path / "all"))
    assert stores.load_chunks(spark, str(tmp_path / "all/chunks")).count() == 50
    page = stores.index_page(kb)
    assert "| Data Schemas | 50 (50 unique) |" in page and "- S0\n- S1\n" in page and "- None found" in page


def test_answers_become_records(spark, tmp_path):
    files = spark.createDataFrame([("r", "a.py", "x")], "repo string, path string, content string")
    one = enrich.extract(files, None, enrich.OfflineProvider())
    answers.save_answers(one, str(tmp_path / "cache"))
    again = enrich.extract(files, answers.stored_answers(spark, str(tmp_path / "cache")), enrich.OfflineProvider())
    assert again.first().cached and answers.stored_answers(spark, str(tmp_path / "none")) is None
    m = manifest.manifest(files)
    p = answers.repo_prompts(m, manifest.file_tree(files)).first()
    assert "Repository: r" in p.prompt and "a.py" in p.prompt and len(p.key) == 20 and p.file_count == 1
    split = spark.createDataFrame([("r", 1, "# T", '{"purpose_summary": "p", "when_to_use": ["w"]}')], "repo string, file_count int, markdown string, json string")
    c = answers.contexts(split, "m").first()
    assert (c.repo_name, c.purpose, c.domain, c.when_to_use, c.data_ownership) == ("r", "p", "", ["w"], [])
    kb = Knowledge.of(spark, contexts=answers.contexts(split, "m"), schemas=spark.createDataFrame([("r", "S", 1)], "repo string, name string, ord long"))
    s = answers.semantic_prompts(kb).first()
    assert '"name":"S"' in s.prompt and s.prompt.endswith("[]")
    stored = answers.built_relationships(*[spark.createDataFrame([(k,)], "name string") for k in "abc"])
    assert {r.kind: json.loads(r.body)["name"] for r in stored.collect()} == {"data_routing": "a", "service_chains": "b", "service_map": "c"}


def test_many_repositories_are_listed_in_tasks(spark, tmp_path):
    for k in range(70):
        (tmp_path / f"r{k}").mkdir()
        (tmp_path / f"r{k}" / "a.txt").write_text(str(k))
    rows = source.read_files(spark, *[str(tmp_path / f"r{k}") for k in range(70)])
    assert rows.rdd.getNumPartitions() > 8 and {(r.repo, bytes(r.content)) for r in rows.collect()} == {(f"r{k}", str(k).encode()) for k in range(70)}


def test_manifest(spark, repo):
    rows = {r.path: r for r in manifest.manifest(source.as_text(source.read_files(spark, str(repo)))).collect()}
    assert "logo.png" not in rows and rows["requirements.txt"].tier == 1 and rows["src/user_service.py"].tier == 2
    assert "def create_user" in rows["src/user_service.py"].shown and "return 1" not in rows["src/user_service.py"].shown
    small = {r.path: r.tier for r in manifest.manifest(source.as_text(source.read_files(spark, str(repo))), 10).collect()}
    assert small["src/user_service.py"] == 3
    tree = manifest.file_tree(spark.createDataFrame([("r", "a/b.py"), ("r", "a/c/d.py"), ("r", "e.py")], "repo string, path string")).first().tree
    assert tree == "a/\n  b.py\n  c/\n    d.py\ne.py"


def test_enrichment_rows_never_fail(spark):
    class Broken:
        def complete(self, prompt):
            raise ValueError("no")

    files = spark.createDataFrame([("a", "text"), ("b", "x" * 200)], "path string, content string")
    got = {r.path: r for r in enrich.extract(files, None, Broken(), max_size=100).collect()}
    assert got["a"].error == "ValueError: no" and got["b"].error == "too large" and got["a"].json is None
    assert enrich.first_json('say {"a": {"b": "}"}} and {x}') == '{"a": {"b": "}"}}' and enrich.first_json("none") is None
    ctx = enrich.split_context(spark.createDataFrame([('# T\n---METADATA---\n{"purpose": "p"}',)], "answer string")).first()
    assert ctx.markdown == "# T" and json.loads(ctx.json) == {"purpose": "p"}
    answers_ = ['# T\ntext\n```json\n{"purpose_summary": "p"}\n```', '# T\n{"purpose_summary": "p"}', "# T {not json}", '# T {"other": 1}', "# T", None]
    got = enrich.split_context(spark.createDataFrame([(a,) for a in answers_], "answer string")).collect()
    assert [r.markdown for r in got] == ["# T\ntext", "# T", "# T {not json}", '# T {"other": 1}', "# T", ""]
    assert json.loads(got[0].json) == json.loads(got[1].json) == {"purpose_summary": "p"}


def test_vector_index(spark):
    chunks = spark.createDataFrame([("a", "user service", 1), ("b", "payment api", 2), ("a", "user table", 3)], "id string, text string, ord long")
    index = vectors.index_chunks(None, chunks, vectors.hashing_encoder)
    index = vectors.index_chunks(index, spark.createDataFrame([("b", "payment page", 1)], "id string, text string, ord long"), vectors.hashing_encoder)
    assert {r.id: r.text for r in index.collect()} == {"a": "user table", "b": "payment page"}
    at = vectors.hashing_encoder(["user table"])[0].tolist()
    best = vectors.search(index, at, 1).first()
    assert best.id == "a" and best.similarity == 1.0


def test_python_records():
    assert pyast.records("def broken(:")[0]["kind"] == "error"
    code = "class A(BaseModel):\n    x: int = Field(ge=1)\n"
    assert [(r["type"], r["fields"][0]["constraints"]) for r in pyast.records(code)] == [("model", []), ("interface", ["ge=1"])]


def test_stream_replaces_repositories(spark, tmp_path):
    state = {"kb": Knowledge.of(spark)}
    put = lambda kb: state.update(kb=Knowledge(**{k: spark.createDataFrame(v.collect(), v.schema) for k, v in kb.named().items()}))
    row = lambda repo, code: spark.createDataFrame([(repo, "a.py", code)], ingest.FILES)
    for code in (PY, PY.replace("UserService", "OrderService")):
        row("one", code).write.mode("append").parquet(str(tmp_path / "in"))
        q = ingest.ingest(ingest.changed_files(spark, str(tmp_path / "in")), lambda: state["kb"], put, str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert [r.name for r in state["kb"].services.collect()] == ["OrderService"]


def test_included_repositories(spark):
    names = ["shop/web", "shop/old-web", "shopping/app", "other/shop", None]
    rows = spark.createDataFrame([(n,) for n in names], "full_path string")
    get = lambda **kw: {r.full_path for r in source.included(rows, **kw).collect()}
    assert get() == set(names)
    assert get(namespaces=["shop"], exclude=["old"]) == {"shop/web", "shopping/app"}
    assert get(owners=["shop", "other"]) == {"shop/web", "shop/old-web", "other/shop"}
    assert get(exclude=["^sh", "^$"]) == {"other/shop"}


def greedy(sizes, room):
    kept = set()
    for tokens, path in sorted((-t, p) for p, t in sizes):
        if -tokens <= room:
            kept.add(path)
            room += tokens
    return kept


def test_budget_keeps_what_a_fold_over_all_files_keeps(spark):
    rng = random.Random(5)
    repos = {f"r{k}": [(f"f{i:03}", rng.choice([0, 1, 2, 3, 7, 7, 7, 20, 40, 300])) for i in range(rng.choice([1, 5, 60, 300]))] for k in range(12)}
    spent = {r: rng.choice([0, 50, 99, 100, 101]) for r in repos}
    rows = [(r, p, t) for r, files in repos.items() for p, t in files] + [("r0", "none", None), ("unknown", "f", 1)]
    files = spark.createDataFrame(rows, "repo string, path string, tokens bigint")
    got = manifest.within_budget(files, spark.createDataFrame(list(spent.items()), "repo string, tokens bigint"), 100).collect()
    assert len(got) == len(rows) - 1
    for r, of in repos.items():
        assert {x.path for x in got if x.repo == r and x.kept} == greedy(of, 100 - spent[r]), r

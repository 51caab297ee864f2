"""From files to records, contexts, semantic layers and relationships."""

import json

from pyspark.sql import functions as F

from codequarry.operators import answers
from codequarry.operators.knowledge import Knowledge
from codequarry.plans import analysis
from codequarry.sources import stores
from codequarry.streaming import progress

SQL = "CREATE TABLE orders (\n  id INT PRIMARY KEY,\n  total INT\n);\n"


def told(seen):
    class Told:
        """Answers by what stands in the prompt, and says each prompt's first line in a file."""

        def __init__(self, seen):
            self.seen = str(seen)

        def complete(self, prompt):
            with open(self.seen, "a") as f:
                f.write(prompt.split("\n")[0] + "\n")
            if "bad" in prompt and "Key files" in prompt:
                raise TimeoutError("late")
            if "Key files" in prompt:
                return '# Shop\n---METADATA---\n{"purpose_summary": "sells", "domain": "trade", "data_ownership": [{"entity": "Order", "description": "d", "is_source_of_truth": true}]}'
            if prompt.startswith("###"):
                return 'So: {"service_map": [{"service": "shop", "n": 1}], "data_routing": "none", "service_chains": []}'
            return json.dumps({"entity_descriptions": {"orders": "what is sold"}, "field_descriptions": {"orders": {"total": "in cents"}}, "api_descriptions": {"GET /orders": "lists"}, "query_recipes": [{"question": "how many?"}]})

    return Told(seen)


def test_a_run_with_answers(spark, tmp_path):
    for repo in ("shop", "bad", "empty"):
        (tmp_path / "code" / repo).mkdir(parents=True)
    (tmp_path / "code/shop/db.sql").write_text(SQL)
    (tmp_path / "code/shop/app.js").write_text("const app = express();\napp.get('/orders', list);\n")
    (tmp_path / "code/bad/db.sql").write_text(SQL)
    (tmp_path / "code/empty/x.png").write_bytes(b"\0")
    log = progress.ProgressLog(spark, str(tmp_path / "log"))
    asker = analysis.Asker(told(tmp_path / "seen"), "m", str(tmp_path / "cache"))
    loaded = []
    made = analysis.crawl(spark, [str(tmp_path / "code")], str(tmp_path / "out"), log, asker, loaded.append)
    repos = {r.repo: (r.has_context, r.error) for r in made.repositories.collect()}
    assert repos["shop"] == (True, None) and repos["bad"] == (False, "TimeoutError: late")
    kb = loaded[0]
    assert [(r.repo_name, r.purpose, r.model) for r in kb.contexts.collect()] == [("shop", "sells", "m")]
    got = {r.repo: (r.description, {f.name: f.description for f in r.fields}) for r in kb.schemas.collect()}
    assert got["shop"][0] == "what is sold" and got["shop"][1]["total"] == "in cents" and got["shop"][1]["id"] is None
    assert got["bad"][0] != "what is sold" and got["bad"][1]["total"] is None
    assert [(r.path, r.business_description) for r in made.apis.collect()] == [("/orders", "lists")]
    assert kb.semantic_layers.first().query_recipes[0].question == "how many?"
    assert [(r.kind, json.loads(r.body)) for r in stores.get_relationships(spark, str(tmp_path / "out/store")).collect()] == [("service_map", {"service": "shop", "n": 1})]
    assert [(r.repo, r.description) for r in made.errors.collect()] == [("bad", "context: TimeoutError: late")]
    assert (tmp_path / "out/docs/context/shop/context.md").read_text().strip() == "# Shop"
    # a second run asks for nothing but what failed
    first = (tmp_path / "seen").read_text().splitlines()
    assert sorted(first) == ["### shop", "Repository: bad", "Repository: shop", "Repository: shop"]  # a context and a layer
    analysis.crawl(spark, [str(tmp_path / "code")], str(tmp_path / "out"), log, asker)
    assert (tmp_path / "seen").read_text().splitlines()[len(first) :] == ["Repository: bad"]
    runs = [(r.status, r.stage_index) for r in progress.status(progress.read(spark, log.path)).collect()]
    assert runs == [("completed", 4)] * 2


def test_a_run_without_answers(spark, tmp_path):
    (tmp_path / "code/shop").mkdir(parents=True)
    (tmp_path / "code/shop/db.sql").write_text(SQL)
    made = analysis.crawl(spark, [str(tmp_path / "code")], str(tmp_path / "out"), progress.ProgressLog(spark, str(tmp_path / "log")))
    assert made.kb.schemas.count() == 1 and made.relationships.count() == 0 and made.repositories.first().file_count == 1


def test_semantic_answers_by_repository(spark):
    schemas = [("a", "S", "old", [{"name": "f", "description": "x"}], 1), ("b", "S", "old", None, 2), (None, "S", None, None, 3)]
    kb = Knowledge.of(
        spark,
        schemas=spark.createDataFrame(schemas, "repo string, name string, description string, fields array<struct<name:string,description:string>>, ord long").withColumn("fields", F.transform("fields", lambda f: F.struct(f["name"], F.lit(None).cast("string").alias("type"), F.array().cast("array<string>").alias("constraints"), f["description"], F.array().cast("array<string>").alias("annotations"), *[F.lit(None).cast(t).alias(n) for n, t in (("tags", "string"), ("json_name", "string"), ("optional", "boolean"), ("nullable", "boolean"), ("field_number", "int"))]))),
        services=spark.createDataFrame([("a", "V", 1), ("a", None, 2)], "repo string, name string, ord long"),
        apis=spark.createDataFrame([("a", "/p", "GET", 1), ("b", "/p", "GET", 2), ("a", None, None, 3)], "repo string, path string, method string, ord long"),
    )
    said = [
        ("a", '{"entity_descriptions": {"S": "one", "S": "two", "T": null}, "field_descriptions": {"S": {"f": "y", "g": "z"}}, "api_descriptions": {"GET /p": "get"}, "service_descriptions": {"V": "serves"}}'),
        ("b", '{"field_descriptions": {"S": {"f": "y"}}, "entity_descriptions": 3}'),
        ("c", None), ("d", "no json"),
    ]
    said_ = spark.createDataFrame(said, "repo string, json string")
    out, apis = answers.apply_semantic(kb, said_)
    assert [(r.repo, r.description, [(f.name, f.description) for f in r.fields]) for r in out.schemas.orderBy("ord").collect()] == [("a", "two", [("f", "y")]), ("b", "old", []), (None, None, [])]
    assert [r.description for r in out.services.orderBy("ord").collect()] == ["serves", None]
    assert [r.business_description for r in apis.orderBy("ord").collect()] == ["get", None, None]
    layers = {r.repo_name: r for r in answers.semantic_layers(said_, "m").collect()}
    assert layers["a"].field_descriptions == {"S": {"f": "y", "g": "z"}} and layers["b"].entity_descriptions == {} and "c" not in layers
    assert layers["d"].query_recipes == [] and layers["d"].field_descriptions == {}


def test_prompts_on_relations_hold_each_context_once(spark):
    owner = "array<struct<entity:string,description:string,is_source_of_truth:boolean>>"
    rows = [("r0", "p", "", ["w"], [("E", None, True), (None, "d", None)], [("s", "why")], 0)] + [(f"r{k}", None, "d" * (k % 50), None, [], None, k) for k in range(1, 400)]
    contexts = spark.createDataFrame(rows, f"repo_name string, purpose string, domain string, when_to_use array<string>, data_ownership {owner}, service_dependencies array<struct<service:string,reason:string>>, ord long")
    first = answers.context_summaries(contexts).where("repo = 'r0'").first().summary
    assert first == "### r0\n**Purpose:** p\n**When to use:**\n- w\n**Data ownership:**\n- E:  (source of truth)\n- unknown: d\n**Dependencies:**\n- s: why"
    one = answers.relationship_prompts(contexts).collect()
    assert len(one) == 1 and one[0].repo_count == 400 and one[0].prompt.startswith(first + "\n\n### r1\n")
    many = answers.relationship_prompts(contexts, 1000).collect()
    assert sum(r.repo_count for r in many) == 400 and max(len(r.prompt) for r in many) < 1000 + 150 and len(many) < 25
    assert sorted(x.split("\n")[0] for r in many for x in r.prompt.split("\n\n")) == sorted(f"### r{k}" for k in range(400))
    assert answers.relationship_prompts(contexts.limit(0)).count() == 0

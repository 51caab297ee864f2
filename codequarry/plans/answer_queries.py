"""Queries on a model's answers, stored hits and a forge's listing, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import answers, knowledge, tables, vectors
from codequarry.plans.queries import _AT, _COS, CTE, query
from codequarry.plans.tables import conversation_layers, part_apis, table


def _event_answers(spark, sf_dir):
    """Each event as an answer of one flow, a service with a method, and, of every third, a schema without a name."""
    flow = "named_struct('source', concat('user-', user_id), 'target', event_type, 'type', if(value < 5, null, 'stream'), 'description', props)"
    logic = "named_struct('name', concat('S', event_id % 100), 'methods', array(named_struct('name', 'run', 'params', '(x)')), 'dependencies', array(event_type))"
    body = f"to_json(named_struct('data_flows', array({flow}), 'business_logic', array({logic}), 'schemas', if(event_id % 3 = 0, array(named_struct('type', 'model')), null)))"
    e = table(spark, sf_dir, "events")
    return e.selectExpr("'events' as repo", "concat('e/', event_id) as path", "event_id as ord", f"if(event_id % 10 = 9, null, {body}) as json", "if(event_id % 10 = 9, 'too large', null) as error")


@query("SELECT 'e/' || event_id AS source_file, 'user-' || user_id AS source, event_type AS target, CASE WHEN value < 5 THEN '' ELSE 'stream' END AS type, props AS description FROM events WHERE event_id % 10 <> 9")
def answer_flows(spark, sf_dir):
    kb, _ = answers.records(_event_answers(spark, sf_dir))
    return kb.data_flows.select("source_file", "source", "target", "type", "description")


@query("SELECT 'schema' AS kind, 'e/' || event_id AS source_file, 'unknown' AS name, 'model' AS type, '' AS more FROM events WHERE event_id % 10 <> 9 AND event_id % 3 = 0 UNION ALL SELECT 'service', 'e/' || event_id, 'S' || event_id % 100, 'unknown', 'run(x):' || event_type FROM events WHERE event_id % 10 <> 9 UNION ALL SELECT 'error', 'e/' || event_id, '', '', 'too large' FROM events WHERE event_id % 10 = 9")
def answer_records(spark, sf_dir):
    kb, errors = answers.records(_event_answers(spark, sf_dir))
    schemas = kb.schemas.select(F.lit("schema").alias("kind"), "source_file", "name", "type", F.lit("").alias("more"))
    call = F.element_at("methods", 1)
    services = kb.services.select(F.lit("service"), "source_file", "name", "type", F.concat(call["name"], call["params_raw"], F.lit(":"), F.element_at("dependencies", 1)))
    return schemas.union(services).union(errors.select(F.lit("error"), "source_file", F.lit(""), F.lit(""), "description"))


@query("WITH " + CTE["apis"] + " SELECT ord, CASE WHEN path LIKE '%1' THEN 'about ' || method || ' ' || path END AS business_description FROM apis")
def api_descriptions(spark, sf_dir):
    apis = part_apis(spark, sf_dir)
    keys = apis.where("path like '%1'").selectExpr("concat(method, ' ', path) as key").distinct()
    return answers.describe_apis(apis, keys.withColumn("description", F.concat(F.lit("about "), "key"))).select("ord", "business_description")


@query("WITH " + CTE["recipes"] + ", f AS (SELECT question, ord, turn FROM recipes WHERE contains(lower(question), 'that') ORDER BY ord, turn LIMIT 3) SELECT 'QUERY RECIPES (step-by-step instructions to answer similar questions):' || chr(10) || string_agg(chr(10) || 'Q: ' || question || chr(10) || '  Answer format: text' || chr(10), '' ORDER BY ord, turn) || chr(10) || '---' || chr(10) || chr(10) || 'none' AS context FROM f")
def ask_with_recipes(spark, sf_dir):
    rows = knowledge.recipe_match(knowledge.recipes(conversation_layers(spark, sf_dir)), "is that so", order=("ord", "pos"))
    return answers.with_recipes(spark.createDataFrame([("none",)], "context string"), rows)


@query(f"SELECT 'unknown' AS type, vec_id::VARCHAR AS name, source AS repo, {_COS} AS score, left(text, 200) AS preview FROM embeddings JOIN documents ON vec_id = doc_id ORDER BY score DESC, vec_id LIMIT 20")
def hit_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.col("source").alias("repo"))
    hits = vectors.search(table(spark, sf_dir, "embeddings").join(d, "vec_id"), _AT, 20, "vec_id")
    return answers.normalized_hits(hits.selectExpr("cast(vec_id as string) as id", "cast(null as string) as type", "cast(null as string) as name", "repo", "text", "similarity"))


@query("SELECT c_custkey AS id, 'org/' || c_name AS full_path, 'main' AS default_branch, round(100.0 * c_nationkey / (c_nationkey + 3), 6) AS python_share, c_mktsegment AS last_activity FROM customer WHERE c_custkey % 4 <> 0")
def listed_repositories(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    listing = c.selectExpr("c_custkey as id", "c_name as name", "concat('org/', c_name) as full_name", "'' as description", "cast(null as string) as default_branch", "'' as clone_url", "'' as ssh_url", "map('python', double(c_nationkey), 'go', 3d) as languages", "cast(null as array<string>) as topics", "c_mktsegment as updated_at", "c_custkey % 4 = 0 as archived")
    return answers.listed_repositories(listing).select("id", "full_path", "default_branch", F.round(F.col("languages")["python"], 6).alias("python_share"), "last_activity")


@query("WITH p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a FROM part), q AS (SELECT DISTINCT p_brand || repeat('x', 900) || split_part(p_name, ' ', 1) AS b FROM part) SELECT a, count(*) AS n FROM p JOIN q ON contains(lower(b), lower(a)) GROUP BY a")
def long_name_matches(spark, sf_dir):
    """Short names inside very long ones."""
    p = table(spark, sf_dir, "part")
    pairs = tables.substring_pairs(p.selectExpr("split_part(p_name, ' ', 1) as a"), "a", p.selectExpr("concat(p_brand, repeat('x', 900), split_part(p_name, ' ', 1)) as b"), "b")
    return pairs.groupBy("a").agg(F.count("*").alias("n"))

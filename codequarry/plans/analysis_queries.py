"""Queries on semantic answers, prompts and answers on relationships, and the progress of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import answers, knowledge
from codequarry.plans.queries import query
from codequarry.plans.tables import knowledge as kb_of
from codequarry.plans.tables import table
from codequarry.sources.shared import new_folder
from codequarry.streaming import progress


def _semantic_answers(spark, sf_dir):
    """An answer for each nation, supplier and part: what some of them are, in the repository that they stand in."""
    n, r, s, p = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "part"))
    nations = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # five regions
    entity = "if(n_nationkey % 3 = 0, map(n_name, concat('in ', r_name)), null) as entity_descriptions"
    field = "if(n_nationkey % 2 = 0, map(n_name, map('n_nationkey', 'key', 'other', 'no')), null) as field_descriptions"
    out = nations.selectExpr("r_name as repo", entity, field)
    out = out.select("repo", F.to_json(F.struct("entity_descriptions", "field_descriptions")).alias("json"))
    suppliers = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).where("s_suppkey % 2 = 0")  # 25 nations
    out = out.union(suppliers.selectExpr("n_name", "to_json(named_struct('service_descriptions', map(s_name, concat('serves ', n_name))))"))
    verb = "element_at(array('GET', 'POST', 'PUT', 'DELETE'), p_size % 4 + 1)"
    return out.union(p.where("p_size % 5 = 0").selectExpr("p_type", f"to_json(named_struct('api_descriptions', map(concat({verb}, ' /api/', lower(p_type), '/', p_size), concat('size ', p_size))))"))


@query(
    "SELECT 'schema' AS kind, r_name AS repo, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'in ' || r_name END AS told, CASE WHEN n_nationkey % 2 = 0 THEN 'key' END AS field FROM nation JOIN region ON n_regionkey = r_regionkey"
    " UNION ALL SELECT 'schema', r_name, r_name, NULL, NULL FROM region"
    " UNION ALL SELECT 'service', n_name, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'serves ' || n_name END, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey"
    " UNION ALL SELECT 'api', p_type, '/api/' || lower(p_type) || '/' || p_size, CASE WHEN p_size % 5 = 0 THEN 'size ' || p_size END, NULL FROM part"
)
def semantic_answers(spark, sf_dir):
    kb, apis = answers.apply_semantic(kb_of(spark, sf_dir), _semantic_answers(spark, sf_dir))
    none = F.lit(None).cast("string")
    schemas = kb.schemas.select(F.lit("schema").alias("kind"), "repo", "name", F.col("description").alias("told"), F.try_element_at("fields", F.lit(1))["description"].alias("field"))
    services = kb.services.select(F.lit("service"), "repo", "name", "description", none)
    return schemas.union(services).union(apis.select(F.lit("api"), "repo", "path", "business_description", none))


@query("SELECT 'conv-' || conv_id AS repo, text AS question FROM conversations WHERE role = 'user'")
def answer_layers(spark, sf_dir):
    """Each user's turn as a semantic answer with one recipe."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    said = asked.selectExpr("concat('conv-', conv_id) as repo", "to_json(named_struct('query_recipes', array(named_struct('question', text)))) as json")
    return knowledge.recipes(answers.semantic_layers(said, "given")).select("repo", "question")


@query(
    "SELECT '### ' || s_name || chr(10) || '**Purpose:** keeps ' || n_name || chr(10) || '**Domain:** ' || n_name || chr(10) || '**Data ownership:**' || chr(10) || '- ' || n_name || ': ' || s_name"
    " || CASE WHEN s_suppkey % 10 = 0 THEN ' (source of truth)' ELSE '' END || chr(10) || '**Dependencies:**' || chr(10) || '- the SUPPLIER#' || lpad((s_suppkey // 10)::VARCHAR, 9, '0') || ' service: ' AS summary, 1::BIGINT AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey"
)
def relationship_summaries(spark, sf_dir):
    """What all prompts on relationships hold, each summary with its number of times."""
    prompts = answers.relationship_prompts(kb_of(spark, sf_dir).contexts, 2000)
    return prompts.select(F.explode(F.split("prompt", "\n\n")).alias("summary")).groupBy("summary").agg(F.count("*").alias("n"))


@query(
    "SELECT 'service_map' AS kind, event_type AS subject, user_id::VARCHAR AS more FROM events UNION ALL SELECT 'data_routing', 'e' || event_id, NULL FROM events WHERE event_id % 2 = 0"
    " UNION ALL SELECT 'data_routing', 'f' || event_id, 'x' FROM events WHERE event_id % 2 = 0"
)
def answer_relationships(spark, sf_dir):
    """Each event as an answer with one service and, of every second, two routes."""
    routes = "if(event_id % 2 = 0, array(named_struct('subject', concat('e', event_id), 'more', null), named_struct('subject', concat('f', event_id), 'more', 'x')), null)"
    said = table(spark, sf_dir, "events").selectExpr(f"to_json(named_struct('service_map', array(named_struct('subject', event_type, 'more', cast(user_id as string))), 'data_routing', {routes})) as json")
    return answers.answered_relationships(said).select("kind", F.get_json_object("body", "$.subject").alias("subject"), F.get_json_object("body", "$.more").alias("more"))


_STREAMED = ["documents", "orders", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS job, 'completed' AS status, count(*) AS rows FROM {t}" for t in _STREAMED))
def stream_progress(spark, sf_dir):
    """Whole tables as streams, and what the listener's table says of them when they have ended."""
    folder = new_folder(spark)
    log = progress.ProgressLog(spark, f"{folder}/progress")
    listener = log.listener()
    spark.streams.addListener(listener)
    try:
        runs = []
        for name in _STREAMED:
            # a pattern, since a stream's path that is none must be a folder
            stream = spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")
            q = stream.writeStream.queryName(name).format("noop").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
            q.awaitTermination()
            if not log.wait(q.runId):
                raise TimeoutError(f"no end of {name} in the log")
            runs.append(str(q.runId))
    finally:
        spark.streams.removeListener(listener)
    return progress.status(progress.read(spark, log.path).where(F.col("run").isin(runs))).select("job", "status", "rows")

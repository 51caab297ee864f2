"""Queries on the driver's tables, each with DuckDB SQL of the same result where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import cache_key, token_estimate
from codequarry.operators import graph, knowledge, relations, render, search, tables, vectors, views
from codequarry.plans.tables import conversation_layers, event_flows, line_dependencies, nation_schemas, part_apis, supplier_contexts, supplier_services, table
from codequarry.plans.tables import knowledge as kb_of

QUERIES = {}
SQL: dict[str, str] = {}

#: The knowledge tables of codequarry.plans.tables, flat.
CTE = {
    "schemas": "schemas AS (SELECT r_name AS repo, n_name AS name, 'table' AS type, n_nationkey::BIGINT AS ord, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name, 'entity', 1000 + r_regionkey, NULL FROM region)",
    "services": "services AS (SELECT n_name AS repo, s_name AS name, 'Supplier#' || lpad((s_suppkey // 10)::VARCHAR, 9, '0') AS dep, n_name AS accessed, s_suppkey AS ord FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "apis": "apis AS (SELECT p_type AS repo, '/api/' || lower(p_type) || '/' || p_size AS path, ['GET', 'POST', 'PUT', 'DELETE'][p_size % 4 + 1] AS method, p_brand AS handler, p_name AS description, p_partkey AS ord FROM part)",
    "deps": "deps AS (SELECT 'repo-' || l_suppkey AS repo, 'pkg-' || l_partkey AS name, '1.' || l_linenumber AS version, CASE l_returnflag WHEN 'A' THEN 'pip' WHEN 'N' THEN 'npm' ELSE 'go' END AS ecosystem, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)",
    "flows": "flows AS (SELECT 'user-' || user_id % 50 AS source, event_type AS target, CASE WHEN value < 5 THEN NULL ELSE 'stream' END AS type, event_id AS ord FROM events)",
    "contexts": "contexts AS (SELECT s_name AS repo, 'keeps ' || n_name AS purpose, n_name AS entity, s_suppkey % 10 = 0 AS sot, 'the SUPPLIER#' || lpad((s_suppkey // 10)::VARCHAR, 9, '0') || ' service' AS dep, s_suppkey AS ord FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "recipes": "recipes AS (SELECT 'conv-' || conv_id AS repo, text AS question, conv_id AS ord, turn FROM conversations WHERE role = 'user')",
}


def _with(*names: str, more: str = "") -> str:
    return "WITH " + ", ".join([CTE[n] for n in names] + ([more] if more else [])) + " "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _score(c: str, q: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    terms = " + ".join(f"CAST(contains({low}, '{t}') AS DOUBLE)" for t in q.split())
    return f"(CASE WHEN {low} = '{q}' THEN 10.0 WHEN contains({low}, '{q}') THEN 5.0 ELSE {terms} END)::DOUBLE"


Q1 = "the of than"


@query(f"SELECT doc_id, lang, source, {_score('text', Q1)} + {_score('lang', Q1)} AS score FROM documents WHERE {_score('text', Q1)} + {_score('lang', Q1)} > 0 ORDER BY score DESC, doc_id LIMIT 50")
def kw_search_topk(spark, sf_dir):
    return search.top_matches(table(spark, sf_dir, "documents"), Q1, ["text", "lang"], 50, "doc_id").select("doc_id", "lang", "source", "score")


Q2 = "red nation_1 brand#1"
_HITS = (
    _with("schemas", "services", "apis", "deps", "recipes")
    + f"""SELECT kind, name, repo, score FROM (
 SELECT 'schema' AS kind, name, repo, {_score('name', Q2)} + CASE WHEN type = 'table' THEN {_score("'n_nationkey'", Q2)} + {_score("'int'", Q2)} ELSE 0 END AS score, 1 AS b, ord, 0 AS t FROM schemas
 UNION ALL SELECT 'api', method || ' ' || path, repo, {_score('path', Q2)} + {_score('method', Q2)} + {_score('handler', Q2)} + {_score('description', Q2)}, 2, ord, 0 FROM apis
 UNION ALL SELECT 'service', name, repo, {_score('name', Q2)}, 3, ord, 0 FROM services
 UNION ALL SELECT 'dependency', name, repo, {_score('name', Q2)} + {_score('ecosystem', Q2)}, 4, ord, 0 FROM deps
 UNION ALL SELECT 'recipe', question, repo, ({_score('question', Q2)} + {_score("'text'", Q2)}) * 1.5, 5, ord, turn FROM recipes) """
)


@query(_HITS + "WHERE score > 0")
def kw_search_branches(spark, sf_dir):
    return search.hits(kb_of(spark, sf_dir), Q2).select("kind", "name", "repo", "score")


@query(f"SELECT * FROM ({_HITS} WHERE score > 0 ORDER BY score DESC, b, ord LIMIT 40) WHERE kind = 'api' AND contains(lower(repo), 'o')")
def kw_search_post_filter(spark, sf_dir):
    return search.search(kb_of(spark, sf_dir), Q2, 40, "api", "o").select("kind", "name", "repo", "score")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def find_contains(spark, sf_dir):
    return knowledge.find_contains(table(spark, sf_dir, "part"), "p_name", "RING").select("p_partkey", "p_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = 'nation_7'")
def find_exact(spark, sf_dir):
    return knowledge.find_exact(table(spark, sf_dir, "nation"), "n_name", "Nation_7").select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(n_name, 'NATION_12') OR contains('NATION_12', n_name)")
def find_bidirectional(spark, sf_dir):
    return knowledge.find_bidirectional(table(spark, sf_dir, "nation"), "n_name", "NATION_12").select("n_nationkey", "n_name")


@query(_with("apis") + "SELECT method, path, handler FROM apis WHERE contains(lower(path), 'promo') AND upper(method) = 'GET'")
def find_api(spark, sf_dir):
    return knowledge.find_api(part_apis(spark, sf_dir), "PROMO", "get").select("method", "path", "handler")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'high') AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
def list_filter_limit(spark, sf_dir):
    return knowledge.list_records(table(spark, sf_dir, "orders"), 100, "o_orderkey", contains={"o_orderpriority": "HIGH"}, equals={"o_orderstatus": "F"}).select("o_orderkey", "o_orderpriority")


@query(_with("apis") + "SELECT handler, arg_min(path, ord) AS path, min(ord) AS ord FROM apis GROUP BY handler")
def distinct_keep_first(spark, sf_dir):
    return tables.keep_first(part_apis(spark, sf_dir), "handler").select("handler", "path", "ord")


@query(_with("deps") + "SELECT name, arg_min(version, ord) AS version, arg_min(ecosystem, ord) AS ecosystem FROM deps WHERE contains(lower(name), '7') AND ecosystem = 'pip' GROUP BY name ORDER BY min(ord) LIMIT 100")
def list_dependencies(spark, sf_dir):
    return knowledge.list_dependencies(line_dependencies(spark, sf_dir), "7", "PIP").select("name", "version", "ecosystem")


@query(_with("deps") + "SELECT repo, name, version, (SELECT count(*) FROM deps WHERE contains(name, 'pkg-12')) AS count FROM deps WHERE contains(name, 'pkg-12')")
def dependency_usage(spark, sf_dir):
    return knowledge.dependency_usage(line_dependencies(spark, sf_dir), "PKG-12").select("repo", "name", "version", "count")


@query(_with("deps") + "SELECT name, count(*) AS usage_count, arg_min(ecosystem, ord) AS ecosystem, arg_min(version, ord) AS version FROM deps GROUP BY name ORDER BY count(*) DESC, min(ord) LIMIT 50")
def top50_usage(spark, sf_dir):
    return knowledge.top_dependencies(line_dependencies(spark, sf_dir)).select("name", "usage_count", "ecosystem", "version")


@query(_with("recipes") + "SELECT repo, question, (SELECT count(*) FROM recipes WHERE contains(lower(question), 'that')) AS count FROM recipes WHERE contains(lower(question), 'that') ORDER BY ord, turn LIMIT 50")
def list_recipes(spark, sf_dir):
    return knowledge.list_recipes(kb_of(spark, sf_dir).semantic_layers, "that").select("repo", "question", "count")


@query(
    _with("schemas", "services", "apis", "deps", "contexts")
    + """SELECT t.repo, schemas_count, apis_count, services_count, dependencies_count, coalesce(purpose, '') AS purpose, c.repo IS NOT NULL AS has_context, coalesce(eco, '') AS ecosystems
 FROM (SELECT repo, count(*) FILTER (k = 's')::BIGINT AS schemas_count, count(*) FILTER (k = 'a')::BIGINT AS apis_count, count(*) FILTER (k = 'v')::BIGINT AS services_count, count(*) FILTER (k = 'd')::BIGINT AS dependencies_count
   FROM (SELECT repo, 's' AS k FROM schemas UNION ALL SELECT repo, 'a' FROM apis UNION ALL SELECT repo, 'v' FROM services UNION ALL SELECT repo, 'd' FROM deps UNION ALL SELECT repo, 'c' FROM contexts) GROUP BY repo) t
 LEFT JOIN contexts c ON c.repo = t.repo
 LEFT JOIN (SELECT repo, string_agg(ecosystem || '=' || n, ',' ORDER BY ecosystem) AS eco FROM (SELECT repo, ecosystem, count(*) AS n FROM deps GROUP BY 1, 2) GROUP BY repo) e ON e.repo = t.repo"""
)
def repo_rollup(spark, sf_dir):
    eco = F.array_join(F.transform(F.array_sort(F.map_entries("ecosystems")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return knowledge.repo_rollup(kb_of(spark, sf_dir)).select("repo", "schemas_count", "apis_count", "services_count", "dependencies_count", "purpose", "has_context", F.coalesce(eco, F.lit("")).alias("ecosystems"))


@query(
    _with("schemas", "services", "apis", "deps", "contexts", "recipes")
    + """SELECT (SELECT count(*) FROM schemas) AS total_schemas, (SELECT count(DISTINCT lower(name)) FROM schemas) AS unique_schemas, (SELECT count(*) FROM apis) AS total_apis, (SELECT count(*) FROM deps) AS total_dependencies,
 (SELECT count(DISTINCT name) FROM deps) AS unique_dependencies, (SELECT count(*) FROM services) AS total_services, (SELECT count(*) FROM contexts) AS total_contexts, (SELECT count(DISTINCT repo) FROM recipes) AS total_semantic_layers,
 (SELECT count(*) FROM recipes) AS total_query_recipes, 0::BIGINT AS total_glossary_terms"""
)
def kb_summary(spark, sf_dir):
    return knowledge.summary(kb_of(spark, sf_dir))


_NODES = """nodes AS (SELECT 'schema:' || name AS id, name AS label, 'schema' AS type, arg_min(repo, ord) AS repo FROM schemas GROUP BY name
 UNION ALL SELECT 'service:' || name, name, 'service', arg_min(repo, ord) FROM services GROUP BY name
 UNION ALL SELECT 'api:' || method || ' ' || path, method || ' ' || path, 'api', arg_min(repo, ord) FROM apis GROUP BY method, path
 UNION ALL SELECT 'dep:' || name, name, 'dependency', NULL FROM (SELECT name FROM deps GROUP BY name ORDER BY count(*) DESC, min(ord) LIMIT 50))"""
_EDGES = """edges AS (SELECT 'service:' || name AS source, 'service:' || dep AS target, 'depends_on' AS type, 'depends on' AS label FROM services WHERE dep IN (SELECT name FROM services)
 UNION ALL SELECT 'service:' || name, 'schema:' || accessed, 'data_access', 'reads' FROM services WHERE accessed IN (SELECT name FROM schemas)
 UNION ALL SELECT 'schema:' || name, 'schema:' || target, 'relationship', 'belongs_to' FROM schemas WHERE target IN (SELECT name FROM schemas)
 UNION ALL SELECT 'api:' || method || ' ' || path, 'service:' || (SELECT min(s.name) FROM services s WHERE contains(lower(s.name), lower(handler)) OR contains(lower(handler), lower(s.name))), 'handler', 'handled by' FROM apis WHERE EXISTS (SELECT 1 FROM services s WHERE contains(lower(s.name), lower(handler)) OR contains(lower(handler), lower(s.name)))
 UNION ALL SELECT CASE WHEN source IN (SELECT name FROM services) THEN 'service:' || source ELSE source END, CASE WHEN target IN (SELECT name FROM services) THEN 'service:' || target ELSE target END, 'data_flow', 'data flow' FROM flows)"""
_GRAPH = _with("schemas", "services", "apis", "deps", "flows", more=f"{_NODES}, {_EDGES}")


@query(_GRAPH + "SELECT id, label, type, repo FROM nodes")
def graph_nodes(spark, sf_dir):
    return graph.nodes(kb_of(spark, sf_dir)).select("id", "label", "type", "repo")


@query(_GRAPH + "SELECT source, target, type, label FROM edges")
def graph_edges(spark, sf_dir):
    return graph.edges(kb_of(spark, sf_dir))


@query(_GRAPH + "SELECT 'type:' || type AS name, count(*) AS count FROM nodes GROUP BY type UNION ALL SELECT 'total_nodes', count(*) FROM nodes UNION ALL SELECT 'total_edges', count(*) FROM edges")
def graph_stats(spark, sf_dir):
    kb = kb_of(spark, sf_dir)
    return graph.stats(graph.nodes(kb), graph.edges(kb))


_N = "schema:NATION_3"


@query(_GRAPH + f"SELECT 'incoming' AS direction, n.id, n.label, n.type AS node_type, e.type AS edge FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = '{_N}' UNION ALL SELECT 'outgoing', n.id, n.label, n.type, e.type FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = '{_N}'")
def node_neighbours(spark, sf_dir):
    kb = kb_of(spark, sf_dir)
    return graph.neighbours(graph.edges(kb), graph.nodes(kb), _N)


@query(_GRAPH + f"SELECT DISTINCT id FROM (SELECT target AS id FROM edges WHERE source = '{_N}' UNION ALL SELECT source FROM edges WHERE target = '{_N}' UNION ALL SELECT '{_N}')")
def connected_ids(spark, sf_dir):
    return graph.connected(graph.edges(kb_of(spark, sf_dir)), _N)


@query(_GRAPH + "SELECT source, target, type, label FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)")
def drop_dangling(spark, sf_dir):
    kb = kb_of(spark, sf_dir)
    return graph.drop_dangling(graph.edges(kb), graph.nodes(kb))


@query(_GRAPH.rstrip() + ", shown AS (SELECT id FROM nodes WHERE type IN ('schema', 'service') AND (contains(lower(label), '1') OR contains(lower(id), '1'))) SELECT source, target, type, label FROM edges WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)")
def visible_edges(spark, sf_dir):
    kb = kb_of(spark, sf_dir)
    return graph.drop_dangling(graph.edges(kb), graph.visible_nodes(graph.nodes(kb), ["schema", "service"], "1"))


@query(_with("schemas") + "SELECT 'references_to' AS direction, target AS other, 'belongs_to' AS type, 'n_regionkey' AS via FROM schemas WHERE contains(lower(name), 'asia') AND target IS NOT NULL UNION ALL SELECT 'referenced_by', name, 'belongs_to', 'n_regionkey' FROM schemas WHERE lower(target) = (SELECT lower(name) FROM schemas WHERE contains(lower(name), 'asia') ORDER BY ord LIMIT 1)")
def schema_relationships(spark, sf_dir):
    kb = kb_of(spark, sf_dir)
    return relations.schema_relationships(kb.schemas, "Asia")


@query(_with("services") + "SELECT 'depends_on' AS direction, arg_max(dep, ord) AS other FROM services WHERE contains(lower(name), '#00000000') UNION ALL SELECT 'depended_by', name FROM services WHERE lower(dep) = (SELECT lower(name) FROM services WHERE contains(lower(name), '#00000000') ORDER BY ord LIMIT 1)")
def service_deps(spark, sf_dir):
    return relations.service_dependencies(supplier_services(spark, sf_dir), "#00000000")


@query("WITH h AS (SELECT DISTINCT p_brand AS handler FROM part), s AS (SELECT DISTINCT split_part(p_brand, '#', 2) AS name FROM part) SELECT handler, min(name) AS service FROM h JOIN s ON contains(lower(handler), lower(name)) OR contains(lower(name), lower(handler)) GROUP BY handler")
def handler_theta_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return graph.handler_matches(p.selectExpr("p_brand as handler"), p.selectExpr("split_part(p_brand, '#', 2) as name"))


@query(
    _with("contexts")
    + """SELECT a.entity, a.repo AS source_of_truth, a.repo AS query_this_when, coalesce((SELECT string_agg(b.repo || ':eventual:' || b.repo, ',' ORDER BY b.ord) FROM contexts b WHERE b.entity = a.entity AND NOT b.sot AND b.repo <> a.repo), '') AS also FROM contexts a WHERE a.sot"""
)
def data_routing(spark, sf_dir):
    rows = relations.data_routing(kb_of(spark, sf_dir).contexts)
    also = F.array_join(F.transform("also_available_in", lambda c: F.concat_ws(":", c["service"], c["freshness"], c["notes"])), ",")
    return rows.select("entity", "source_of_truth", "query_this_when", also.alias("also"))


_MATCH = "m AS (SELECT c.repo, c.ord, min(o.repo) AS depends_on FROM contexts c JOIN contexts o ON o.repo <> c.repo AND (contains(lower(c.dep), lower(o.repo)) OR contains(lower(o.repo), lower(c.dep))) GROUP BY c.repo, c.ord)"


@query(_with("contexts", more=_MATCH) + "SELECT repo, depends_on FROM m")
def dep_match_theta(spark, sf_dir):
    return relations.dependency_matches(kb_of(spark, sf_dir).contexts).select("repo", "depends_on")


@query(
    _with("contexts", more=_MATCH)
    + """, r0 AS (SELECT DISTINCT depends_on AS root FROM m WHERE depends_on NOT IN (SELECT repo FROM m)), r AS (FROM r0 UNION SELECT DISTINCT repo FROM m WHERE NOT EXISTS (FROM r0)),
 s AS (SELECT root, root AS service, 0 AS pos FROM r WHERE root IN (SELECT depends_on FROM m) UNION ALL SELECT root, m.repo, row_number() OVER (PARTITION BY root ORDER BY m.ord) FROM r JOIN m ON m.depends_on = root),
 k AS (SELECT root, string_agg(service, '|' ORDER BY service) AS k FROM s GROUP BY root HAVING count(*) >= 2), f AS (SELECT min(root) AS root FROM k GROUP BY k)
SELECT s.root || ' Dependency Chain' AS name, s.pos::INTEGER AS pos, s.service, left(c.purpose, 120) AS action, CASE WHEN s.pos = 0 THEN '' ELSE s.root END AS data_passed FROM s JOIN f ON f.root = s.root LEFT JOIN contexts c ON c.repo = s.service"""
)
def service_chains(spark, sf_dir):
    return relations.service_chains(kb_of(spark, sf_dir).contexts)


@query(_with("contexts") + "SELECT repo AS service, purpose, entity AS domain, entity AS data_owned FROM contexts")
def service_map(spark, sf_dir):
    return relations.service_map(kb_of(spark, sf_dir).contexts).select("service", "purpose", "domain", F.array_join("data_owned", ",").alias("data_owned"))


@query(_with("services") + "SELECT name AS source, dep AS target, 'dependency' AS type, name || ' depends on ' || dep AS description FROM services")
def flows_fallback(spark, sf_dir):
    kb = kb_of(spark, sf_dir)
    return relations.data_flows(kb.data_flows.where("false"), kb.services).select("source", "target", "type", "description")


@query(_with("flows") + "SELECT source, target, count(*) AS count, coalesce(arg_min_null(type, ord), 'data') AS type FROM flows GROUP BY source, target")
def flow_links(spark, sf_dir):
    return views.flow_links(kb_of(spark, sf_dir).data_flows)


@query(_with("flows") + "SELECT source AS id FROM flows UNION SELECT target FROM flows")
def flow_nodes(spark, sf_dir):
    return views.flow_nodes(event_flows(spark, sf_dir))


@query(_with("flows") + "SELECT coalesce(type, 'other') AS type, count(*) AS count FROM flows GROUP BY 1")
def flow_type_counts(spark, sf_dir):
    return views.counts(event_flows(spark, sf_dir), "type", "other")


@query("SELECT event_type AS method, count(*) AS count, round(100 * count(*) / sum(count(*)) OVER ())::INTEGER AS percent FROM events GROUP BY event_type")
def method_mix(spark, sf_dir):
    return views.method_mix(table(spark, sf_dir, "events"), "event_type")


_PATH = "regexp_replace(url, '^[a-z]+://[^/]+', '')"


@query(f"SELECT CASE WHEN contains({_PATH}, '/') THEN split_part({_PATH}, '/', 2) ELSE 'root' END AS \"group\", count(*) AS count FROM pages GROUP BY 1")
def api_prefix_groups(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr("regexp_replace(url, '^[a-z]+://[^/]+', '') as path").transform(views.api_groups)


@query(_with("apis") + "SELECT split_part(path, '/', 3) AS segment, row_number() OVER (PARTITION BY split_part(path, '/', 3) ORDER BY CASE method WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 WHEN 'PUT' THEN 2 ELSE 4 END, path, ord)::INTEGER AS rank, method, path FROM apis")
def api_segment_groups(spark, sf_dir):
    return views.api_segments(part_apis(spark, sf_dir))


@query("SELECT DISTINCT 'lang' AS facet, lang AS value FROM documents UNION SELECT DISTINCT 'source', source FROM documents")
def facet_values(spark, sf_dir):
    return views.facet_values(table(spark, sf_dir, "documents"), "lang", "source")


@query(_with("deps") + "SELECT count(DISTINCT name) AS unique_dependencies, count(DISTINCT repo) AS repos, count(*) AS records FROM deps")
def dep_facets(spark, sf_dir):
    return views.dependency_facets(line_dependencies(spark, sf_dir))


@query(_with("deps") + "SELECT ecosystem, count(*) AS count FROM deps GROUP BY ecosystem")
def ecosystem_counts(spark, sf_dir):
    return views.counts(line_dependencies(spark, sf_dir), "ecosystem", "unknown")


@query(_with("services") + "SELECT name, repo FROM services WHERE contains(lower(name), '42') OR contains(lower(repo), '42') ORDER BY name")
def browse_services(spark, sf_dir):
    return views.browse(supplier_services(spark, sf_dir), "42", ("name", "repo")).select("name", "repo")


@query(_with("deps") + "SELECT ecosystem, name, ord FROM deps WHERE contains(name, '99') AND ecosystem = 'npm'")
def browse_dependencies(spark, sf_dir):
    return views.browse(line_dependencies(spark, sf_dir), "99", ("name",), {"ecosystem": "npm"}, ("ecosystem", "name")).select("ecosystem", "name", "ord")


@query(_with("schemas") + "SELECT name, CASE WHEN type = 'table' THEN 1 ELSE 0 END AS n FROM schemas ORDER BY n DESC, name LIMIT 10")
def schemas_by_fields(spark, sf_dir):
    return views.sort_schemas(kb_of(spark, sf_dir).schemas, "fields").select("name", F.size("fields").alias("n")).limit(10)


_AT = [round(((7 * k) % 11 - 5) / 5, 2) for k in range(64)]
_COS = f"round(list_cosine_similarity(embedding::DOUBLE[], {_AT}::DOUBLE[]), 4)"


@query(f"SELECT vec_id, label, {_COS} AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return vectors.search(table(spark, sf_dir, "embeddings"), _AT, 10, "vec_id").select("vec_id", "label", "similarity")


@query(f"SELECT vec_id, label, {_COS} AS similarity FROM embeddings WHERE label = 3 ORDER BY similarity DESC, vec_id LIMIT 10")
def vector_filtered(spark, sf_dir):
    return vectors.search(table(spark, sf_dir, "embeddings"), _AT, 10, "vec_id", ("label", 3)).select("vec_id", "label", "similarity")


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 17)), 4) AS similarity FROM embeddings WHERE vec_id <> 17 ORDER BY similarity DESC, vec_id LIMIT 5")
def vector_similar(spark, sf_dir):
    return vectors.similar_to(table(spark, sf_dir, "embeddings"), 17, 5, "vec_id").select("vec_id", "similarity")


@query(f"WITH h AS (SELECT vec_id, {_COS} AS similarity, text FROM embeddings JOIN documents ON vec_id = doc_id ORDER BY similarity DESC, vec_id LIMIT 5) SELECT string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY similarity DESC, vec_id) FILTER (similarity > 0.2) AS context, count(*) AS result_count FROM h")
def ask_context(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return vectors.ask(vectors.search(chunks, _AT, 5, "vec_id"), "vec_id", 0.2)


@query("SELECT label, count(*) AS count FROM embeddings GROUP BY label")
def vector_stats(spark, sf_dir):
    return vectors.stats(table(spark, sf_dir, "embeddings"), "label", "vec_id")


@query(_with("recipes") + "SELECT repo, question FROM recipes WHERE contains(lower(question), 'thereand') OR contains(lower(question), 'eneau') OR contains(lower(question), 'what') ORDER BY ord, turn LIMIT 3")
def recipe_match(spark, sf_dir):
    rows = knowledge.recipes(conversation_layers(spark, sf_dir))
    return knowledge.recipe_match(rows, "What is thereand EnEau", order=("ord", "pos")).select("repo", "question")


@query(_with("schemas") + "SELECT s.name, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'about ' || n_name END, NULL) AS description, CASE WHEN n_nationkey % 3 = 0 THEN 'key of ' || n_name END AS field_description FROM schemas s LEFT JOIN nation ON n_name = s.name")
def semantic_merge(spark, sf_dir):
    more = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").selectExpr("n_name as name", "concat('about ', n_name) as description", "map('n_nationkey', concat('key of ', n_name)) as field_descriptions")
    merged = knowledge.semantic_merge(kb_of(spark, sf_dir).schemas, more)
    return merged.select("name", "description", F.try_element_at("fields", F.lit(1))["description"].alias("field_description"))


@query(_with("contexts") + "SELECT repo AS repo_name, CASE WHEN ord % 4 = 0 THEN 'better' ELSE purpose END AS purpose FROM contexts")
def context_merge(spark, sf_dir):
    c = supplier_contexts(spark, sf_dir)
    return knowledge.context_merge(c, c.where("ord % 4 = 0").withColumn("purpose", F.lit("better"))).select("repo_name", "purpose")


@query("SELECT doc_id, source, 'old' AS v FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 2 = 0) UNION ALL SELECT doc_id + 1000000, source, 'new' FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 2 = 0")
def repo_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "'old' as v")
    new = d.where("source in ('src1', 'src2') and doc_id % 2 = 0").selectExpr("doc_id + 1000000 as doc_id", "source", "'new' as v")
    return knowledge.upsert_repo(d, new, "source")


@query(_with("apis") + "SELECT 'api:' || method || ':' || path || ':routes.py' AS id, method || ' ' || path AS name, 'API Endpoint: ' || method || ' ' || path || chr(10) || 'Handler: ' || handler || chr(10) || 'Repository: ' || repo || chr(10) || 'Source: routes.py' || chr(10) || 'Description: ' || description AS text FROM apis")
def chunk_render(spark, sf_dir):
    return render.chunks(kb_of(spark, sf_dir)).where("type = 'api'").select("id", "name", "text")


@query(_with("schemas") + "SELECT 'schema:' || name || ':db/nation.sql' AS id, 'Schema: ' || name || chr(10) || 'Type: table' || chr(10) || 'Repository: ' || repo || chr(10) || 'Source: db/nation.sql' || chr(10) || 'Fields:' || chr(10) || '  - n_nationkey: int (primary_key)' || chr(10) || 'Relationship: belongs_to to ' || target AS text FROM schemas WHERE type = 'table'")
def chunk_render_schema(spark, sf_dir):
    return render.chunks(kb_of(spark, sf_dir)).where("type = 'schema' and id like '%nation.sql'").select("id", "text")


@query(_with("apis") + "SELECT 'api:' || method || ':' || path || ':routes.py' AS id, arg_max('Handler: ' || handler, ord) AS handler FROM apis GROUP BY 1")
def chunk_dedup_last(spark, sf_dir):
    rows = tables.keep_last(render.chunks(kb_of(spark, sf_dir)).where("type = 'api'"), "id")
    return rows.select("id", F.element_at(F.split("text", "\n"), 2).alias("handler"))


@query(_with("apis") + "SELECT 'api/' AS dir, count(DISTINCT split_part(path, '/', 2)) AS pages, count(*) AS lines FROM apis")
def api_pages(spark, sf_dir):
    pages = render.api_pages(part_apis(spark, sf_dir))
    return pages.agg(F.count("*").alias("pages"), F.sum(F.size(F.split("body", "\n")) - 2).cast("long").alias("lines")).select(F.lit("api/").alias("dir"), "pages", "lines")


@query("SELECT doc_id, left(sha256(coalesce(text, '') || ':' || source), 16) AS key, (length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM documents")
def cache_key_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cache_key("text", "source").alias("key"), token_estimate("text").alias("tokens"))

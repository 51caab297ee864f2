"""Knowledge tables made from the driver's star-schema tables, so that the operators can be run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.knowledge import Knowledge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_schemas(spark, sf_dir) -> DataFrame:
    """Nations as tables that belong to their region, regions as entities."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # five regions
    fields = "array(struct('n_nationkey' as name, 'int' as type, array('primary_key') as constraints, cast(null as string) as description, cast(null as array<string>) as annotations, cast(null as string) as tags, cast(null as string) as json_name, cast(null as boolean) as optional, cast(null as boolean) as nullable, cast(null as int) as field_number))"
    rel = "array(struct('belongs_to' as type, r_name as target, 'n_regionkey' as field, cast(null as string) as via, cast(null as string) as description))"
    own = joined.selectExpr("r_name as repo", "n_name as name", "'table' as type", "'db/nation.sql' as source_file", f"{fields} as fields", f"{rel} as relationships", "cast(n_nationkey as bigint) as ord")
    return own.unionByName(region.selectExpr("r_name as repo", "r_name as name", "'entity' as type", "'db/region.sql' as source_file", "1000 + r_regionkey as ord"), allowMissingColumns=True)


def supplier_services(spark, sf_dir) -> DataFrame:
    """Suppliers as services that depend on the supplier of a tenth of their key and read their nation."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)  # 25 nations
    return joined.selectExpr("n_name as repo", "s_name as name", "'service' as type", "concat('svc/', s_suppkey, '.py') as source_file", "array(concat('Supplier#', lpad(cast(s_suppkey div 10 as string), 9, '0'))) as dependencies", "array(n_name) as data_accessed", "s_suppkey as ord")


def part_apis(spark, sf_dir) -> DataFrame:
    """Parts as endpoints handled by their brand."""
    p = table(spark, sf_dir, "part")
    return p.selectExpr("p_type as repo", "concat('/api/', lower(p_type), '/', p_size) as path", "element_at(array('GET', 'POST', 'PUT', 'DELETE'), p_size % 4 + 1) as method", "'routes.py' as source_file", "p_brand as handler", "p_name as description", "p_partkey as ord")


def line_dependencies(spark, sf_dir) -> DataFrame:
    """Line items as uses of a package, the part, by a repository, the supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.selectExpr("concat('repo-', l_suppkey) as repo", "concat('pkg-', l_partkey) as name", "concat('1.', l_linenumber) as version", "'runtime' as type", "case l_returnflag when 'A' then 'pip' when 'N' then 'npm' else 'go' end as ecosystem", "l_orderkey * 10 + l_linenumber as ord")


def event_flows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.selectExpr("'events' as repo", "concat('user-', user_id % 50) as source", "event_type as target", "if(value < 5, null, 'stream') as type", "event_id as ord")


def supplier_contexts(spark, sf_dir) -> DataFrame:
    """Suppliers as repositories that own their nation, and depend on the one of a tenth of their key."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)  # 25 nations
    return joined.selectExpr("s_name as repo_name", "concat('keeps ', n_name) as purpose", "n_name as domain", "array(struct(n_name as entity, s_name as description, s_suppkey % 10 = 0 as is_source_of_truth)) as data_ownership", "array(struct(concat('the SUPPLIER#', lpad(cast(s_suppkey div 10 as string), 9, '0'), ' service') as service, '' as reason)) as service_dependencies", "s_suppkey as ord")


def conversation_layers(spark, sf_dir) -> DataFrame:
    """Conversations as semantic layers; a user's turn is a recipe's question."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").selectExpr("conv_id", "turn", "text as question")
    recipe = "struct(question, cast(null as array<struct<action:string,service:string,purpose:string>>) as steps, 'text' as answer_format)"
    rows = asked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.expr(f"struct(turn, {recipe} as r)"))).alias("q"))
    return rows.selectExpr("concat('conv-', conv_id) as repo_name", "transform(q, x -> x.r) as query_recipes", "conv_id as ord")


def knowledge(spark, sf_dir) -> Knowledge:
    make = {"schemas": nation_schemas, "apis": part_apis, "services": supplier_services, "dependencies": line_dependencies, "data_flows": event_flows, "contexts": supplier_contexts, "semantic_layers": conversation_layers}
    return Knowledge.of(spark, **{k: f(spark, sf_dir) for k, f in make.items()})

"""The knowledge graph: nodes, edges and neighbourhoods as two DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import has, text
from codequarry.operators.knowledge import Knowledge, top_dependencies
from codequarry.operators.tables import keep_first, substring_pairs


def _endpoint():
    return F.when(text("method") != "", F.concat("method", F.lit(" "), text("path"))).otherwise(text("path"))


def nodes(kb: Knowledge, top: int = 50) -> DataFrame:
    """id, label, type, repo, metadata (JSON), ord; the first record of each id."""
    name = F.coalesce("name", F.lit("unknown"))

    def part(df: DataFrame, turn: int, prefix: str, kind: str, label, repo, *meta: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix + ":"), label).alias("id"), label.alias("label"), F.lit(kind).alias("type"), repo.alias("repo"), F.to_json(F.struct(*meta)).alias("metadata"), F.struct(F.lit(turn).alias("turn"), F.col("ord").alias("ord")).alias("ord"))

    rows = part(kb.schemas, 1, "schema", "schema", name, text("repo"), "type", "source_file", "fields")
    rows = rows.unionByName(part(kb.services, 2, "service", "service", name, text("repo"), "type", "source_file", "description", "methods"))
    rows = rows.unionByName(part(kb.apis, 3, "api", "api", _endpoint(), text("repo"), "handler", "source_file", "description", "params"))
    deps = top_dependencies(kb.dependencies, top)
    rows = rows.unionByName(part(deps, 4, "dep", "dependency", F.col("name"), F.lit(None).cast("string"), "ecosystem", "version", "usage_count"))
    return keep_first(rows, "id")


def edges(kb: Knowledge) -> DataFrame:
    """source, target, type, label. Both ends are known nodes, but for flows between unknown names.

    Of several services that match an API's handler, the one of smallest name is taken.
    """
    services = kb.services.select(F.coalesce("name", F.lit("unknown")).alias("target")).distinct()
    schemas = kb.schemas.select(F.coalesce("name", F.lit("unknown")).alias("target")).distinct()

    def listed(df: DataFrame, column: str, prefix: str, known: DataFrame, to: str, kind: str, label: str) -> DataFrame:
        pairs = df.select(text("name").alias("name"), F.explode(column).alias("target")).join(known, "target", "left_semi")
        return pairs.select(F.concat(F.lit(prefix + ":"), "name").alias("source"), F.concat(F.lit(to + ":"), "target").alias("target"), F.lit(kind).alias("type"), F.lit(label).alias("label"))

    out = listed(kb.services, "dependencies", "service", services, "service", "depends_on", "depends on")
    out = out.union(listed(kb.services, "data_accessed", "service", schemas, "schema", "data_access", "reads"))
    rel = kb.schemas.select(text("name").alias("name"), F.explode("relationships").alias("r")).select("name", F.col("r.target").alias("target"), F.coalesce("r.type", F.lit("related")).alias("label"))
    rel = rel.join(schemas, "target", "left_semi")
    out = out.union(rel.select(F.concat(F.lit("schema:"), "name"), F.concat(F.lit("schema:"), "target"), F.lit("relationship"), "label"))
    match = handler_matches(kb.apis, kb.services)
    out = out.union(kb.apis.where(text("handler") != "").join(match, "handler").select(F.concat(F.lit("api:"), _endpoint()), F.concat(F.lit("service:"), "service"), F.lit("handler"), F.lit("handled by")))
    return out.union(flow_edges(kb.data_flows, services))


def handler_matches(apis: DataFrame, services: DataFrame) -> DataFrame:
    """handler, service: of the services that contain it or are contained in it, the smallest name."""
    pairs = substring_pairs(apis, "handler", services, "name")
    return pairs.groupBy(F.col("a").alias("handler")).agg(F.min("b").alias("service"))


def flow_edges(flows: DataFrame, services: DataFrame) -> DataFrame:
    known = services.select(F.col("target").alias("__known"))
    named = flows.where((text("source") != "") & (text("target") != ""))

    def resolved(df: DataFrame, column: str) -> DataFrame:
        joined = df.join(known, F.col(column) == F.col("__known"), "left")
        return joined.withColumn(column, F.when(F.col("__known").isNotNull(), F.concat(F.lit("service:"), column)).otherwise(F.col(column))).drop("__known")

    both = resolved(resolved(named, "source"), "target")
    return both.select("source", "target", F.lit("data_flow").alias("type"), F.coalesce("description", F.lit("data flow")).alias("label"))


def stats(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Numbers of nodes by type, and of all nodes and edges, as (name, count)."""
    by_type = node_rows.groupBy(F.concat(F.lit("type:"), "type").alias("name")).agg(F.count("*").alias("count"))
    total = node_rows.agg(F.count("*").alias("count")).select(F.lit("total_nodes").alias("name"), "count")
    return by_type.union(total).union(edge_rows.agg(F.count("*").alias("count")).select(F.lit("total_edges").alias("name"), "count"))


def drop_dangling(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    ids = node_rows.select("id").distinct()
    kept = edge_rows.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edge_rows.columns)


def visible_nodes(node_rows: DataFrame, types: list[str], query: str = "") -> DataFrame:
    shown = node_rows.where(F.col("type").isin(types))
    return shown.where(has("label", query) | has("id", query)) if query else shown


def neighbours(edge_rows: DataFrame, node_rows: DataFrame, node: str) -> DataFrame:
    """direction, id, label, type and edge of the known nodes next to one."""
    n = node_rows.select("id", "label", F.col("type").alias("node_type"))
    into = edge_rows.where(F.col("target") == node).select(F.lit("incoming").alias("direction"), F.col("source").alias("id"), F.col("type").alias("edge"))
    out = edge_rows.where(F.col("source") == node).select(F.lit("outgoing").alias("direction"), F.col("target").alias("id"), F.col("type").alias("edge"))
    return into.union(out).join(n, "id").select("direction", "id", "label", "node_type", "edge")


def connected(edge_rows: DataFrame, node: str) -> DataFrame:
    """Ids one step from a node, itself included."""
    out = edge_rows.where(F.col("source") == node).select(F.col("target").alias("id"))
    into = edge_rows.where(F.col("target") == node).select(F.col("source").alias("id"))
    own = edge_rows.sparkSession.range(1).select(F.lit(node).alias("id"))
    return out.union(into).union(own).distinct()

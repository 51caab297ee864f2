"""Aggregates, filters and orders that a browser of the knowledge tables shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import api_group, api_segment, has, text


def method_mix(apis: DataFrame, column: str = "method") -> DataFrame:
    """Counts and rounded shares, most frequent first."""
    counts = apis.groupBy(F.col(column).alias("method")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # over a row for each method
    return counts.withColumn("percent", F.round(100 * F.col("count") / total).cast("int")).orderBy(F.desc("count"), "method")


def counts(df: DataFrame, column: str, default: str) -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit(default)).alias(column)).agg(F.count("*").alias("count"))


def facet_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of each column, in order: (facet, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").where("value is not null and value <> ''").distinct().orderBy("facet", "value")


def dependency_facets(dependencies: DataFrame) -> DataFrame:
    return dependencies.agg(F.countDistinct("name").alias("unique_dependencies"), F.countDistinct("repo").alias("repos"), F.count("*").alias("records"))


def flow_links(flows: DataFrame) -> DataFrame:
    """One row for each source and target: number of flows and the type of the first."""
    return flows.groupBy("source", "target").agg(F.count("*").alias("count"), F.coalesce(F.min_by("type", "ord"), F.lit("data")).alias("type"))


def flow_nodes(flows: DataFrame) -> DataFrame:
    return flows.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def api_groups(apis: DataFrame, path: str = "path") -> DataFrame:
    return apis.groupBy(api_group(path).alias("group")).agg(F.count("*").alias("count"))


def _verb_rank(c: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for k, v in enumerate(("GET", "POST", "PUT", "PATCH", "DELETE")) for x in (v, k)])
    return F.coalesce(F.try_element_at(ranks, F.upper(c)), F.lit(99))


def api_segments(apis: DataFrame) -> DataFrame:
    """APIs by meaningful segment; inside by verb, then path."""
    rows = apis.withColumn("segment", api_segment("path")).withColumn("rank", F.row_number().over(Window.partitionBy("segment").orderBy(_verb_rank(F.col("method")), "path", "ord")))
    return rows.select("segment", "rank", "method", "path")


def sort_schemas(schemas: DataFrame, by: str = "name") -> DataFrame:
    first = {"name": [], "fields": [F.size("fields").desc()], "relationships": [F.size("relationships").desc()]}[by]
    return schemas.orderBy(*first, F.collate("name", "UNICODE"), "ord")


def browse(df: DataFrame, query: str = "", columns: tuple[str, ...] = ("name",), equals: dict[str, str] | None = None, order: tuple[str, ...] = ("name",)) -> DataFrame:
    """Rows of which one column contains the query and the others equal what is given, in order."""
    if query:
        hit = F.lit(False)
        for c in columns:
            hit = hit | has(c, query)
        df = df.where(hit)
    for c, v in (equals or {}).items():
        df = df.where(text(c) == v) if v else df
    return df.orderBy(*order)

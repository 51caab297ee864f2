"""The knowledge tables and the lookups, lists and roll-ups over them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import has, same, text
from codequarry.model import SCHEMAS
from codequarry.operators.tables import head, keep_first


@dataclass
class Knowledge:
    """One DataFrame for each kind of record."""

    schemas: DataFrame
    apis: DataFrame
    services: DataFrame
    dependencies: DataFrame
    data_flows: DataFrame
    contexts: DataFrame
    semantic_layers: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Knowledge:
        """Missing tables are empty; missing columns of given ones are null, lists are empty."""
        full = {}
        for f in fields(cls):
            want = spark.createDataFrame([], SCHEMAS[f.name]).schema
            df = tables.get(f.name)
            if df is None:
                full[f.name] = spark.createDataFrame([], want)
                continue
            cols = []
            for w in want.fields:
                kind = w.dataType.simpleString()
                c = F.col(w.name).cast(w.dataType) if w.name in df.columns else F.lit(None).cast(w.dataType)
                cols.append((F.coalesce(c, F.array().cast(w.dataType)) if kind.startswith("array") else c).alias(w.name))
            full[f.name] = df.select(*cols)
        return cls(**full)

    def named(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def register(self, prefix: str = "kb_") -> None:
        for name, df in self.named().items():
            df.createOrReplaceTempView(prefix + name)


# lookups ------------------------------------------------------------------------------------


def find_contains(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column contains value, case ignored."""
    return df.where(has(column, value))


def find_exact(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column equals value, case ignored."""
    return df.where(same(column, value))


def find_bidirectional(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column contains value or is contained in it, case heeded."""
    c = text(column)
    return df.where(F.contains(c, F.lit(value)) | F.contains(F.lit(value), c))


def find_api(apis: DataFrame, path: str = "", method: str = "") -> DataFrame:
    found = apis.where(has("path", path)) if path else apis
    return found.where(F.upper(text("method")) == method.upper()) if method else found


def list_records(df: DataFrame, limit: int = 100, order: str = "ord", contains: dict[str, str] | None = None, equals: dict[str, str] | None = None, same_as: dict[str, str] | None = None) -> DataFrame:
    """The first rows that pass: contains and same_as ignore case, equals heeds it; empty values don't filter."""
    for c, v in (contains or {}).items():
        df = df.where(has(c, v)) if v else df
    for c, v in (equals or {}).items():
        df = df.where(F.col(c) == v) if v else df
    for c, v in (same_as or {}).items():
        df = df.where(same(c, v)) if v else df
    return head(df, limit, order)


def list_dependencies(dependencies: DataFrame, name: str = "", ecosystem: str = "", limit: int = 100) -> DataFrame:
    """First record of each name among those that pass, in order."""
    df = dependencies.where(has("name", name)) if name else dependencies
    df = df.where(same("ecosystem", ecosystem)) if ecosystem else df
    return head(keep_first(df, "name"), limit)


def dependency_usage(dependencies: DataFrame, name: str) -> DataFrame:
    """All records whose name contains the given one, each with their number."""
    found = find_contains(dependencies, "name", name)
    return found.crossJoin(F.broadcast(found.agg(F.count("*").alias("count"))))  # one row


def recipes(semantic_layers: DataFrame) -> DataFrame:
    rows = semantic_layers.select("repo_name", "ord", F.posexplode("query_recipes").alias("pos", "r"))
    return rows.select(F.col("repo_name").alias("repo"), "ord", "pos", "r.*")


def list_recipes(semantic_layers: DataFrame, q: str = "", repo: str = "", limit: int = 50) -> DataFrame:
    """The first recipes that pass, each with the number of all that pass."""
    df = recipes(semantic_layers)
    df = df.where(has("repo", repo)) if repo else df
    df = df.where(has("question", q)) if q else df
    return head(df, limit, "ord", "pos").crossJoin(F.broadcast(df.agg(F.count("*").alias("count"))))  # one row


def glossary(semantic_layers: DataFrame) -> DataFrame:
    rows = semantic_layers.select("repo_name", "ord", F.posexplode("business_glossary").alias("pos", "g"))
    return rows.select(F.col("repo_name").alias("repo"), "ord", "pos", "g.*")


def list_contexts(contexts: DataFrame) -> DataFrame:
    return contexts.select("repo_name", "purpose", "domain", "when_to_use", "data_ownership", "service_dependencies")


def repo_record(df: DataFrame, repo: str) -> DataFrame:
    """The first row of a repository, case ignored."""
    return head(df.where(same("repo_name", repo)), 1)


# roll-ups -----------------------------------------------------------------------------------


def summary(kb: Knowledge) -> DataFrame:
    """One row of counts."""
    n = lambda df, *more: df.agg(F.count("*").alias("n"), *more)
    low = F.lower(text("name"))
    parts = [
        n(kb.schemas, F.countDistinct(low).alias("u")).selectExpr("n as total_schemas", "u as unique_schemas"),
        n(kb.apis).selectExpr("n as total_apis"),
        n(kb.dependencies, F.countDistinct(low).alias("u")).selectExpr("n as total_dependencies", "u as unique_dependencies"),
        n(kb.services).selectExpr("n as total_services"),
        kb.contexts.agg(F.countDistinct("repo_name").alias("total_contexts")),
        kb.semantic_layers.agg(F.countDistinct("repo_name").alias("total_semantic_layers"), F.coalesce(F.sum(F.size("query_recipes")), F.lit(0)).alias("total_query_recipes"), F.coalesce(F.sum(F.size("business_glossary")), F.lit(0)).alias("total_glossary_terms")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def repo_rollup(kb: Knowledge) -> DataFrame:
    """Per repository: counts of its records, of its dependencies by ecosystem, and its purpose."""
    name = lambda c: F.when(text(c) == "", "unknown").otherwise(F.col(c)).alias("repo")
    tags = {"schemas": kb.schemas, "apis": kb.apis, "services": kb.services, "dependencies": kb.dependencies}
    union = None
    for tag, df in tags.items():
        eco = F.coalesce("ecosystem", F.lit("unknown")) if tag == "dependencies" else F.lit(None).cast("string")
        part = df.select(name("repo"), F.lit(tag).alias("tag"), eco.alias("ecosystem"))
        union = part if union is None else union.union(part)
    context = kb.contexts.select(name("repo_name"), F.lit("context").alias("tag"), F.lit(None).cast("string").alias("ecosystem"))
    by_eco = union.union(context).groupBy("repo", "tag", "ecosystem").agg(F.count("*").alias("n"))
    count = lambda tag: F.sum(F.when(F.col("tag") == tag, F.col("n")).otherwise(0)).alias(f"{tag}_count")
    pairs = F.collect_list(F.when(F.col("tag") == "dependencies", F.struct("ecosystem", "n")))
    rows = by_eco.groupBy("repo").agg(*map(count, tags), F.max(F.col("tag") == "context").alias("has_context"), F.map_from_entries(F.array_sort(pairs)).alias("ecosystems"))
    purpose = keep_first(kb.contexts.select(name("repo_name"), "purpose", "ord"), "repo").select("repo", "purpose")
    return rows.join(purpose, "repo", "left").withColumn("purpose", text("purpose")).orderBy("repo")


def top_dependencies(dependencies: DataFrame, n: int = 50) -> DataFrame:
    """Most frequent names; ties by first appearance; ecosystem and version of the first record."""
    named = dependencies.where(text("name") != "")
    first = named.groupBy("name").agg(F.count("*").alias("usage_count"), F.min("ord").alias("ord"), F.min_by(F.struct("ecosystem", "version"), "ord").alias("first"))
    top = first.orderBy(F.desc("usage_count"), "ord").limit(n)
    return top.select("name", "usage_count", "ord", "first.ecosystem", "first.version")


def upsert_repo(current: DataFrame, new: DataFrame, key: str = "repo") -> DataFrame:
    """current without the repositories of new, and new."""
    return current.join(new.select(key).distinct(), key, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def merge_results(first: Knowledge, second: Knowledge) -> Knowledge:
    """Rows of both; of contexts and semantic layers the first one of each repository."""
    one, two = first.named(), second.named()
    out = {k: one[k].unionByName(two[k]) for k in one}
    for k in ("contexts", "semantic_layers"):
        ranked = one[k].withColumn("__turn", F.lit(0)).unionByName(two[k].withColumn("__turn", F.lit(1)))
        rest = [c for c in one[k].columns if c != "repo_name"]
        picked = ranked.groupBy("repo_name").agg(F.min_by(F.struct(*rest), F.struct("__turn", "ord")).alias("r"))
        out[k] = picked.select("repo_name", "r.*").select(*one[k].columns)
    return Knowledge(**out)


# merges -------------------------------------------------------------------------------------


def semantic_merge(schemas: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Descriptions (name, description, fields map) replace those of schemas where there are any."""
    d = descriptions.select(F.col("name").alias("__name"), F.col("description").alias("__new"), F.col("field_descriptions").alias("__fields"))
    joined = schemas.join(d, schemas["name"] == F.col("__name"), "left")
    fields_ = F.transform("fields", lambda f: f.withField("description", F.coalesce(F.try_element_at(F.col("__fields"), f["name"]), f["description"])))
    described = F.coalesce("__new", "description")
    return joined.withColumn("description", described).withColumn("fields", F.when(F.col("__fields").isNotNull(), fields_).otherwise(F.col("fields"))).select(*schemas.columns)


def context_merge(current: DataFrame, better: DataFrame) -> DataFrame:
    """The better context of a repository where there is one."""
    return upsert_repo(current, better.join(current.select("repo_name"), "repo_name", "left_semi"), "repo_name")


def recipe_match(recipe_rows: DataFrame, question: str, least: int = 4, limit: int = 3, order: tuple = ("ord",)) -> DataFrame:
    """The first recipes whose question contains a term of the asked one of at least so many characters."""
    terms = [t for t in question.lower().split() if len(t) >= least]
    hit = F.lit(False)
    for t in terms:
        hit = hit | has("question", t)
    return head(recipe_rows.where(hit), limit, *order)


def or_not_found(found: DataFrame, asked: str) -> DataFrame:
    """What a lookup has found, with asked and found; one row of nulls with found = false if it is nothing."""
    one = found.sparkSession.range(1).select(F.lit(asked).alias("asked"))
    marked = found.withColumn("__found", F.lit(True))
    return one.join(marked, F.lit(True), "left").withColumn("found", F.coalesce("__found", F.lit(False))).drop("__found")


def get_record(df: DataFrame, name: str) -> DataFrame:
    """The first record whose name contains the given one, or the row of or_not_found."""
    return or_not_found(head(find_contains(df, "name", name), 1), name)

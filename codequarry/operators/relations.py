"""Relations between schemas, services and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.operators.knowledge import find_contains
from codequarry.operators.extract import none
from codequarry.operators.tables import keep_first, spread, substring_pairs

SALTS = 32  # parts that the sources of one entity are dealt into


def _first_name(found: DataFrame) -> DataFrame:
    """One row: the lower-cased name of the first record, none if there is no record."""
    return found.orderBy("ord").limit(1).select(F.lower(text("name")).alias("__first"))


def schema_relationships(schemas: DataFrame, name: str) -> DataFrame:
    """What the schemas of that name refer to, and what refers to the first of them."""
    found = find_contains(schemas, "name", name)
    each = lambda df: df.select("name", F.explode("relationships").alias("r")).select("name", "r.target", "r.type", F.col("r.field").alias("via"))
    out = each(found).select(F.lit("references_to").alias("direction"), F.col("target").alias("other"), "type", "via")
    into = each(schemas).join(F.broadcast(_first_name(found)), F.lower("target") == F.col("__first"))
    return out.union(into.select(F.lit("referenced_by"), "name", "type", "via"))


def service_dependencies(services: DataFrame, name: str) -> DataFrame:
    """What the last service of that name depends on, and what depends on the first one."""
    found = find_contains(services, "name", name)
    last = found.agg(F.max_by("dependencies", "ord").alias("d"))
    out = last.select(F.lit("depends_on").alias("direction"), F.explode("d").alias("other"))
    lowered = services.select("name", F.transform("dependencies", lambda d: F.lower(d)).alias("d"))
    into = lowered.join(F.broadcast(_first_name(found)), F.array_contains("d", F.col("__first")))
    return out.union(into.select(F.lit("depended_by"), "name"))


def _owned(contexts: DataFrame) -> DataFrame:
    rows = contexts.select("repo_name", "ord", F.posexplode("data_ownership").alias("pos", "e"))
    return rows.select(F.col("repo_name").alias("repo"), "ord", "pos", text("e.entity").alias("entity"), text("e.description").alias("description"), F.coalesce("e.is_source_of_truth", F.lit(False)).alias("is_source"))


def data_routing(contexts: DataFrame) -> DataFrame:
    """For each entity that a repository is the source of truth of, the others that hold copies."""
    owned = _owned(contexts).where("entity <> ''")
    copies = owned.where("not is_source").select("entity", F.col("repo").alias("other"), F.col("description").alias("notes"), F.struct("ord", "pos").alias("o"))
    copy = F.struct("o", F.col("other").alias("service"), F.lit("eventual").alias("freshness"), "notes")
    # a list is sorted once for its entity; sources of one entity lie in many tasks, as each of their rows holds the list
    lists = copies.groupBy("entity").agg(F.array_sort(F.collect_list(copy)).alias("c"))
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    source = owned.where("is_source").select("entity", "repo", "description", "ord", "pos")
    source = spread(source.withColumn("salt", F.pmod(F.xxhash64("repo", "ord", "pos"), F.lit(SALTS)).cast("int")), "entity", "salt")
    rows = source.join(lists, ["entity", "salt"], "left")
    others = F.filter(F.coalesce("c", none(lists.schema["c"].dataType.simpleString())), lambda c: c["service"] != F.col("repo"))
    also = F.transform(others, lambda c: F.struct(c["service"].alias("service"), c["freshness"].alias("freshness"), c["notes"].alias("notes")))
    return rows.select("entity", F.col("repo").alias("source_of_truth"), also.alias("also_available_in"), F.col("description").alias("query_this_when"), "ord", "pos")


def dependency_matches(contexts: DataFrame) -> DataFrame:
    """repo, depends_on: for each named dependency the smallest other repository that contains it or is contained in it.

    A dependency without a name matches any other repository.
    """
    deps = contexts.select(F.col("repo_name").alias("repo"), "ord", F.posexplode("service_dependencies").alias("pos", "d")).select("repo", "ord", "pos", text("d.service").alias("service"))
    repos = contexts.select("repo_name").distinct()
    pairs = substring_pairs(deps, "service", repos, "repo_name").select(F.col("a").alias("service"), F.col("b").alias("other"))
    named = deps.join(pairs, "service").where("other <> repo").groupBy("repo", "ord", "pos").agg(F.min("other").alias("depends_on"))
    two = repos.orderBy("repo_name").limit(2).agg(F.min("repo_name").alias("one"), F.max("repo_name").alias("two"))
    blank = deps.where("service = ''").crossJoin(F.broadcast(two))  # one row
    blank = blank.select("repo", "ord", "pos", F.when(F.col("one") != F.col("repo"), F.col("one")).when(F.col("two") != F.col("repo"), F.col("two")).alias("depends_on"))
    return named.union(blank.where("depends_on is not null"))


def service_chains(contexts: DataFrame) -> DataFrame:
    """Chains of a root repository and its direct dependers; of equal member sets the first root's.

    Roots are depended on and depend on none; if there is none, all that depend on some.
    """
    graph = dependency_matches(contexts).select("repo", "ord", "depends_on")
    on = graph.select(F.col("depends_on").alias("root")).distinct()
    users = graph.select(F.col("repo").alias("root")).distinct()
    roots = on.join(users, "root", "left_anti")
    none = roots.agg(F.count("*").alias("n"))
    roots = roots.union(users.crossJoin(F.broadcast(none)).where("n = 0").select("root"))  # one row
    links = graph.groupBy(F.col("depends_on").alias("root"), "repo").agg(F.min("ord").alias("ord"))
    steps = roots.join(links, "root").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("repo").alias("service")))).alias("s"))
    chains = steps.select("root", F.concat(F.array("root"), F.transform("s", lambda s: s["service"])).alias("members"))
    keyed = chains.withColumn("key", F.array_join(F.array_sort("members"), "|"))
    purposes = contexts.groupBy(F.col("repo_name").alias("m")).agg(F.max_by("purpose", "ord").alias("purpose"))
    first = keep_first(keyed, "key", order="root")
    step = first.select("root", "key", F.posexplode("members").alias("pos", "m")).join(purposes, "m", "left")
    default = F.when(F.col("pos") == 0, "Provides data/services").otherwise("Processes data")
    action = F.substring(F.when(text("purpose") == "", default).otherwise(F.col("purpose")), 1, 120)
    return step.select(F.concat("root", F.lit(" Dependency Chain")).alias("name"), "pos", F.col("m").alias("service"), action.alias("action"), F.when(F.col("pos") == 0, "").otherwise(F.col("root")).alias("data_passed"))


def service_map(contexts: DataFrame) -> DataFrame:
    owned = F.filter(F.transform("data_ownership", lambda e: text(e["entity"])), lambda e: e != "")
    return contexts.select(F.col("repo_name").alias("service"), text("purpose").alias("purpose"), text("domain").alias("domain"), owned.alias("data_owned"), "when_to_use", "ord")


def data_flows(flows: DataFrame, services: DataFrame) -> DataFrame:
    """The stored flows; if there are none, each service's dependencies as flows."""
    stored = flows.select("source", "target", "type", "description", "source_file", "repo")
    n = flows.agg(F.count("*").alias("n"))
    each = services.select("name", "repo", "source_file", F.explode("dependencies").alias("target"))
    other = each.select(F.col("name").alias("source"), "target", F.lit("dependency").alias("type"), F.concat("name", F.lit(" depends on "), "target").alias("description"), "source_file", "repo")
    return stored.union(other.crossJoin(F.broadcast(n)).where("n = 0").drop("n"))  # one row

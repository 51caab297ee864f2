"""A model's answers as records, and relationships that are stored beside the knowledge tables.

An answer is one JSON object with lists of schemas, business logic, APIs and data flows. This is where
data flows come from.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import cache_key, text
from codequarry.model import FIELDS, PARAMS, RELATIONSHIPS
from codequarry.operators.knowledge import Knowledge

_CALLS = "array<struct<name:string,params:string,returns:string,docstring:string,description:string>>"
#: What an answer may hold; anything else is ignored.
ANSWER = (
    f"schemas array<struct<name:string,type:string,fields:{FIELDS},relationships:{RELATIONSHIPS},description:string>>,"
    f"business_logic array<struct<name:string,type:string,description:string,methods:{_CALLS},dependencies:array<string>,data_accessed:array<string>>>,"
    f"apis array<struct<path:string,method:string,handler:string,params:{PARAMS},request_body:string,response:string,description:string>>,"
    "data_flows array<struct<source:string,target:string,type:string,description:string>>"
)
#: What the metadata of a context answer may hold.
METADATA = "purpose_summary string, domain string, when_to_use array<string>, data_ownership array<struct<entity:string,description:string,is_source_of_truth:boolean>>, service_dependencies array<struct<service:string,reason:string>>"

#: What a semantic answer may hold; descriptions of APIs are by METHOD path.
SEMANTIC = (
    "entity_descriptions map<string,string>, field_descriptions map<string,map<string,string>>, api_descriptions map<string,string>, service_descriptions map<string,string>,"
    "business_glossary array<struct<term:string,definition:string,related_schemas:array<string>,related_apis:array<string>>>,"
    "query_recipes array<struct<question:string,steps:array<struct<action:string,service:string,purpose:string>>,answer_format:string>>"
)
RELATIONSHIP_KINDS = ["service_map", "data_routing", "service_chains"]


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.col(f"r.{c}"), F.lit(default)).alias(c)


def records(answers: DataFrame) -> tuple[Knowledge, DataFrame]:
    """Knowledge tables of answers (repo, path, ord, json, error), and errors (repo, source_file, description).

    A missing name or type of a schema or service is "unknown", other missing texts of APIs and flows
    are empty. Rows without JSON give no records; those with an error give an error row.
    """
    read = answers.where("json is not null").select("repo", F.col("path").alias("source_file"), F.col("ord").alias("at"), F.from_json("json", ANSWER).alias("a"))

    def each(kind: str, *columns: Column) -> DataFrame:
        rows = read.select("repo", "source_file", "at", F.posexplode(f"a.{kind}").alias("pos", "r"))
        return rows.select("repo", "source_file", (F.col("at") * (1 << 24) + F.col("pos")).alias("ord"), *columns)

    plain = lambda *names: [F.col(f"r.{n}").alias(n) for n in names]
    calls = F.transform("r.methods", lambda m: F.struct(m["name"].alias("name"), F.lit(None).cast(PARAMS).alias("params"), m["params"].alias("params_raw"), m["returns"].alias("returns"), m["docstring"].alias("docstring"), m["description"].alias("description")))
    tables = {
        "schemas": each("schemas", _or("name", "unknown"), _or("type", "unknown"), *plain("fields", "relationships", "description")),
        "services": each("business_logic", _or("name", "unknown"), _or("type", "unknown"), calls.alias("methods"), *plain("description", "dependencies", "data_accessed")),
        "apis": each("apis", _or("path", ""), _or("method", ""), _or("handler", ""), *plain("params", "request_body", "response", "description")),
        "data_flows": each("data_flows", _or("source", ""), _or("target", ""), _or("type", ""), *plain("description")),
    }
    errors = answers.where("json is null and error is not null").select("repo", F.col("path").alias("source_file"), F.col("error").alias("description"))
    return Knowledge.of(answers.sparkSession, **tables), errors


def repo_prompts(manifest: DataFrame, trees: DataFrame) -> DataFrame:
    """repo, prompt and key of each repository, from its manifest (repo, path, tier, shown) and tree.

    The key is a hash of the tree and of all that is shown, so that an answer can be stored by it.
    """
    block = F.concat(F.lit("\n### "), "path", F.lit("\n```\n"), text("shown"), F.lit("\n```\n"))
    entry = F.struct("tier", "path", F.when(F.col("tier") < 3, block).otherwise(F.concat(F.lit("- "), "path", F.lit("\n"))).alias("part"))
    # what is shown of a repository is bounded by the token budget
    parts = manifest.groupBy("repo").agg(F.array_sort(F.collect_list(entry)).alias("p"), F.count("*").cast("int").alias("file_count"))
    of = lambda k: F.array_join(F.transform(F.filter("p", lambda x: x["tier"] == k), lambda x: x["part"]), "")
    named = lambda title, body, none: F.concat(F.lit(f"\n## {title}\n"), F.when(body == "", none).otherwise(body))
    body = F.concat(F.lit("Repository: "), "repo", F.lit("\n\n"), text("tree"), named("Key files", of(1), "No key files found."), named("Signatures", of(2), "No additional source files."), named("Other files", of(3), "None"))
    out = parts.join(trees, "repo", "left").select("repo", "file_count", body.alias("prompt"))
    return out.withColumn("key", F.substring(F.sha2("prompt", 256), 1, 20))


def contexts(answers: DataFrame, model: str) -> DataFrame:
    """Context rows of split answers (repo, file_count, markdown, json): missing metadata is empty."""
    a = answers.withColumn("m", F.from_json("json", METADATA))
    none = lambda c: F.coalesce(F.col(f"m.{c}"), F.array()).alias(c)
    return a.select(
        F.col("repo").alias("repo_name"), F.col("markdown").alias("context_markdown"), text("m.purpose_summary").alias("purpose"), text("m.domain").alias("domain"),
        none("when_to_use"), none("data_ownership"), none("service_dependencies"), F.current_timestamp().cast("string").alias("generated_at"), F.lit(model).alias("model"), "file_count",
        F.xxhash64("repo").alias("ord"),
    )


def semantic_prompts(kb: Knowledge) -> DataFrame:
    """repo, prompt and key: the context and a compact JSON of the repository's schemas, APIs and services."""
    names = lambda a: F.transform(a, lambda f: f["name"])

    def compact(df: DataFrame, name: str, *columns: Column) -> DataFrame:
        rows = df.select("repo", F.struct("ord", F.to_json(F.struct(*columns)).alias("j")).alias("x"))
        return rows.groupBy("repo").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]), ","), F.lit("]")).alias(name))

    parts = [
        compact(kb.schemas, "schemas", F.col("name"), F.col("type"), names("fields").alias("fields"), F.col("relationships")),
        compact(kb.apis, "apis", F.col("method"), F.col("path"), F.col("handler"), F.col("params")),
        compact(kb.services, "services", F.col("name"), F.col("type"), names("methods").alias("methods"), F.col("data_accessed")),
    ]
    out = kb.contexts.select(F.col("repo_name").alias("repo"), "context_markdown")
    for p in parts:
        out = out.join(p, "repo", "left")
    lists = [F.coalesce(F.col(n), F.lit("[]")) for n in ("schemas", "apis", "services")]
    prompt = F.concat_ws("\n\n", F.concat(F.lit("Repository: "), "repo"), text("context_markdown"), *lists)
    return out.select("repo", prompt.alias("prompt"), F.substring(F.sha2(F.concat(text("context_markdown"), *lists[:2]), 256), 1, 20).alias("key"))


def semantic_layers(answers: DataFrame, model: str) -> DataFrame:
    """Rows of the semantic layers of semantic answers (repo, json): what is missing is empty; without JSON there is no row."""
    a = answers.where("json is not null").withColumn("s", F.from_json("json", SEMANTIC))
    empty = lambda c, none: F.coalesce(F.col(f"s.{c}"), none).alias(c)
    return a.select(
        F.col("repo").alias("repo_name"), empty("business_glossary", F.array()), empty("entity_descriptions", F.create_map().cast("map<string,string>")),
        empty("field_descriptions", F.create_map().cast("map<string,map<string,string>>")), empty("query_recipes", F.array()),
        F.current_timestamp().cast("string").alias("generated_at"), F.lit(model).alias("model"), F.xxhash64("repo").alias("ord"),
    )


def semantic_descriptions(answers: DataFrame) -> DataFrame:
    """kind, repo, name, description, field_descriptions of semantic answers (repo, json).

    kind is schema, api (named METHOD path) or service. Of a name that an answer gives twice, and of several answers on
    a repository, one is taken: that of the last place, then the largest text.
    """
    s = answers.select("repo", F.from_json("json", SEMANTIC).alias("s"))

    def each(kind: str, column: str, *values: Column) -> DataFrame:
        return s.select("repo", F.posexplode(f"s.{column}").alias("pos", "name", "value")).select(F.lit(kind).alias("kind"), "repo", "name", "pos", *values)

    none = lambda t, c: F.lit(None).cast(t).alias(c)
    plain = [F.col("value").alias("description"), none("map<string,string>", "fields")]
    rows = each("schema", "entity_descriptions", *plain).union(each("api", "api_descriptions", *plain)).union(each("service", "service_descriptions", *plain))
    rows = rows.union(each("schema", "field_descriptions", none("string", "description"), F.col("value").alias("fields")))
    last = lambda c, tie: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("pos", tie))).alias(c)
    return rows.groupBy("kind", "repo", "name").agg(last("description", F.col("description")), last("fields", F.to_json("fields"))).withColumnRenamed("fields", "field_descriptions")


def apply_semantic(kb: Knowledge, answers: DataFrame) -> tuple[Knowledge, DataFrame]:
    """Descriptions of semantic answers (repo, json) put into the records of their repositories.

    Returns the tables, in which descriptions of schemas, of their fields and of services are replaced where an answer has
    one, and the APIs with business_description. Records are joined by repository and name, so that a name that stands
    in many repositories gets each one's own; a repository with very many records is split by their names.
    """
    told = semantic_descriptions(answers)
    of = lambda kind: told.where(F.col("kind") == kind).select(F.col("repo").alias("__repo"), F.col("name").alias("__name"), F.col("description").alias("__new"), F.col("field_descriptions").alias("__fields"))
    mine = lambda name: (F.col("repo") == F.col("__repo")) & (name == F.col("__name"))
    new = F.coalesce("__new", "description")
    fields = F.transform("fields", lambda f: f.withField("description", F.coalesce(F.try_element_at(F.col("__fields"), f["name"]), f["description"])))
    described = F.when(F.col("__fields").isNotNull(), fields).otherwise(F.col("fields"))
    schemas = kb.schemas.join(of("schema"), mine(F.col("name")), "left").withColumn("description", new).withColumn("fields", described).select(*kb.schemas.columns)
    services = kb.services.join(of("service"), mine(F.col("name")), "left").withColumn("description", new).select(*kb.services.columns)
    apis = kb.apis.join(of("api"), mine(F.concat(text("method"), F.lit(" "), text("path"))), "left").select(*kb.apis.columns, F.col("__new").alias("business_description"))
    return replace(kb, schemas=schemas, services=services), apis


def context_summaries(contexts: DataFrame) -> DataFrame:
    """repo, ord and a short text of each context: purpose, domain, and lists of uses, entities and dependencies."""
    lines = lambda title, c, line: F.when(F.size(c) > 0, F.concat(F.lit(f"**{title}:**\n"), F.array_join(F.transform(c, line), "\n")))
    or_unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    dash = F.lit("- ")
    head = lambda title, c: F.when(text(c) != "", F.concat(F.lit(f"**{title}:** "), c))
    source = lambda e: F.when(e["is_source_of_truth"], " (source of truth)").otherwise("")
    parts = [
        F.concat(F.lit("### "), text("repo_name")), head("Purpose", "purpose"), head("Domain", "domain"), lines("When to use", "when_to_use", lambda w: F.concat(dash, text(w))),
        lines("Data ownership", "data_ownership", lambda e: F.concat(dash, or_unknown(e["entity"]), F.lit(": "), text(e["description"]), source(e))),
        lines("Dependencies", "service_dependencies", lambda d: F.concat(dash, or_unknown(d["service"]), F.lit(": "), text(d["reason"]))),
    ]
    return contexts.select(F.col("repo_name").alias("repo"), "ord", F.concat_ws("\n", *parts).alias("summary"))


def relationship_prompts(contexts: DataFrame, most: int = 400_000) -> DataFrame:
    """prompt, key and repo_count: the summaries of all contexts, in as many prompts as it takes.

    A prompt's summaries start within `most` characters, so one is longer than that by less than its last summary. Where all
    fit, there is one prompt, in the contexts' order; else they are dealt in the order of a hash. Places are found
    with 1024 sums, and a window within each hash range.
    """
    each = context_summaries(contexts).withColumn("n", F.length("summary") + 2).withColumn("h", F.xxhash64("repo")).withColumn("range", F.shiftright("h", 54))
    sums = each.groupBy("range").agg(F.sum("n").alias("sum"))
    starts = sums.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("start"))  # at most 1024 rows
    before = F.sum("n").over(Window.partitionBy("range").orderBy("h", "repo", "ord", "summary").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = each.withColumn("before", before).join(F.broadcast(starts), "range").withColumn("part", F.floor((F.col("start") + F.col("before")) / most))
    # a prompt's summaries are bounded by `most`
    parts = placed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("ord", "repo", "summary"))).alias("s"))
    prompt = F.array_join(F.transform("s", lambda x: x["summary"]), "\n\n")
    return parts.select(prompt.alias("prompt"), F.substring(F.sha2(prompt, 256), 1, 20).alias("key"), F.size("s").alias("repo_count"))


def answered_relationships(answers: DataFrame) -> DataFrame:
    """Relationships (kind, body) of answers (json): the items of their three lists, each one JSON object.

    A list that is missing or is none gives nothing. The rows are those that stores.set_relationships takes.
    """
    lists = answers.select(F.from_json("json", ", ".join(f"{k} array<string>" for k in RELATIONSHIP_KINDS)).alias("r"))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"r.{k}").alias("items")) for k in RELATIONSHIP_KINDS])
    return lists.select(F.explode(pairs).alias("p")).select("p.kind", F.explode("p.items").alias("body"))


def save_answers(answers: DataFrame, path: str) -> None:
    """Put answers (key, answer) into a stored cache; those without an answer are not kept."""
    answers.where("answer is not null").select("key", "answer").dropDuplicates(["key"]).write.mode("append").parquet(path)


def stored_answers(spark, path: str) -> DataFrame | None:
    """The stored cache, one answer for each key; None if nothing was stored."""
    try:
        found = spark.read.schema("key string, answer string").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return found.groupBy("key").agg(F.min("answer").alias("answer"))


def describe_apis(apis: DataFrame, descriptions: DataFrame) -> DataFrame:
    """APIs with business_description, from rows (key, description) whose key is METHOD path."""
    d = descriptions.groupBy(F.col("key").alias("__key")).agg(F.max("description").alias("business_description"))
    joined = apis.withColumn("__at", F.concat(text("method"), F.lit(" "), text("path"))).join(d, F.col("__at") == F.col("__key"), "left")
    return joined.select(*apis.columns, "business_description")


def recipe_preamble(recipes: DataFrame, order: tuple[str, ...] = ("ord", "pos")) -> DataFrame:
    """One row with the text of matched recipes (question, steps, answer_format), in order; null if there is none."""
    step = lambda s: F.concat(F.lit("  - "), text(s["action"]), F.lit(" ("), text(s["purpose"]), F.lit(")\n"))
    steps = F.array_join(F.transform(F.coalesce("steps", F.array().cast("array<struct<action:string,service:string,purpose:string>>")), step), "")
    one = F.concat(F.lit("\nQ: "), text("question"), F.lit("\n"), steps, F.lit("  Answer format: "), text("answer_format"), F.lit("\n"))
    parts = recipes.select(F.struct(*order, one.alias("part")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("p"))
    title = F.lit("QUERY RECIPES (step-by-step instructions to answer similar questions):\n")
    return parts.select(F.when(F.size("p") > 0, F.concat(title, F.array_join(F.transform("p", lambda x: x["part"]), ""))).alias("preamble"))


def with_recipes(answer: DataFrame, recipes: DataFrame, order: tuple[str, ...] = ("ord", "pos")) -> DataFrame:
    """The one row of an answer's context (context, ...) with the matched recipes before it."""
    both = answer.crossJoin(F.broadcast(recipe_preamble(recipes, order)))  # one row each
    context = F.when(F.col("preamble").isNotNull(), F.concat("preamble", F.lit("\n---\n\n"), text("context"))).otherwise(F.col("context"))
    return both.withColumn("context", context).select(*answer.columns)


def normalized_hits(hits: DataFrame, preview: int = 200) -> DataFrame:
    """Vector hits as rows of a result list: type, name, repo, score and the head of the text."""
    return hits.select(F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("name", "id").alias("name"), text("repo").alias("repo"), F.col("similarity").alias("score"), F.substring(text("text"), 1, preview).alias("preview"))


def built_relationships(routing: DataFrame, chains: DataFrame, services: DataFrame) -> DataFrame:
    """Routing, chains and the service map as rows (kind, body), each body one JSON object."""
    rows = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("body"))
    return rows(routing, "data_routing").unionByName(rows(chains, "service_chains")).unionByName(rows(services, "service_map"))


def listed_repositories(listing: DataFrame) -> DataFrame:
    """A forge's listing (id, name, full_name, description, default_branch, clone_url, ssh_url, languages, topics, updated_at, archived) as repository rows.

    Archived repositories are left out, the latest activity comes first, languages are shares of bytes.
    """
    total = F.aggregate(F.map_values("languages"), F.lit(0.0), lambda s, v: s + v)
    shares = F.transform_values("languages", lambda _, v: v / F.when(total == 0, 1.0).otherwise(total) * 100)
    rows = listing.where(~F.coalesce("archived", F.lit(False))).select(
        "id", "name", F.col("name").alias("path"), F.col("full_name").alias("full_path"), "description", F.coalesce("default_branch", F.lit("main")).alias("default_branch"), F.col("clone_url").alias("http_url"), "ssh_url",
        F.coalesce(shares, F.create_map().cast("map<string,double>")).alias("languages"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), text("updated_at").alias("last_activity"),
    )
    return rows.orderBy(F.desc("last_activity"), "id")

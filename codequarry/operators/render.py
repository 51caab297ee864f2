"""Records as text: chunks for the vector index, and Markdown pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import api_group, safe_filename, text
from codequarry.operators.knowledge import Knowledge, recipes
from codequarry.operators.tables import head, keep_first


def _or(c: Column | str, default: str = "unknown") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default))


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def _optional(label: str, c: str) -> Column:
    return F.when(text(c) != "", _line(label, F.col(c)))


def _lines(*parts: Column) -> Column:
    """Lines that are there, one below the other; arrays give one line for each element."""
    return F.array_join(F.array_compact(F.flatten(F.array(*parts))), "\n")


def schema_text() -> Column:
    def field(f: Column) -> Column:
        about = F.when(text(f["description"]) != "", F.concat(F.lit(" - "), f["description"])).otherwise("")
        rules = F.array_join(F.coalesce(f["constraints"], F.array().cast("array<string>")), ", ")
        return F.concat(F.lit("  - "), _or(f["name"], "?"), F.lit(": "), _or(f["type"], "?"), F.lit(" ("), rules, F.lit(")"), about)

    top = F.array(_line("Schema: ", _or("name")), _optional("Business Meaning: ", "description"), _optional("Context: ", "business_context"), _line("Type: ", _or("type")), _line("Repository: ", _or("repo")), _line("Source: ", _or("source_file")), F.lit("Fields:"))
    links = F.transform("relationships", lambda r: F.concat(F.lit("Relationship: "), _or(r["type"], "?"), F.lit(" to "), _or(r["target"], "?")))
    return _lines(top, F.transform("fields", field), links)


def service_text() -> Column:
    top = F.array(_line("Service: ", _or("name")), _line("Type: ", _or("type")), _line("Repository: ", _or("repo")), _line("Source: ", _or("source_file")), _optional("Description: ", "description"), F.lit("Methods:"))
    doc = lambda m: F.when(text(m["docstring"]) != "", F.concat(F.lit("    "), F.substring(m["docstring"], 1, 200)))
    methods = F.flatten(F.transform("methods", lambda m: F.array(_line("  - ", _or(m["name"], "?")), doc(m))))
    return _lines(top, methods, F.array(F.lit("Dependencies:")), F.transform("dependencies", lambda d: F.concat(F.lit("  - "), d)))


def api_text() -> Column:
    return _lines(F.array(F.concat(F.lit("API Endpoint: "), _or("method", "?"), F.lit(" "), _or("path", "?")), _line("Handler: ", _or("handler")), _line("Repository: ", _or("repo")), _line("Source: ", _or("source_file")), _optional("Description: ", "description")))


def context_text() -> Column:
    bullets = lambda title, arr: F.when(F.size(arr) > 0, F.concat(F.array(F.lit(title)), arr)).otherwise(F.array().cast("array<string>"))
    use = F.transform("when_to_use", lambda w: F.concat(F.lit("  - "), w))
    own = F.transform("data_ownership", lambda e: F.concat(F.lit("  - "), _or(e["entity"], "?"), F.lit(": "), text(e["description"])))
    top = F.array(_line("Repository Context: ", _or("repo_name")), _line("Purpose: ", text("purpose")), _line("Domain: ", text("domain")))
    return F.concat(_lines(top, bullets("When to use:", use), bullets("Data ownership:", own)), F.lit("\n"))


def glossary_text() -> Column:
    def entry(g: Column) -> Column:
        more = lambda label, arr: F.when(F.size(F.coalesce(arr, F.array().cast("array<string>"))) > 0, F.concat(F.lit(label), F.array_join(arr, ", ")))
        head_ = F.concat(_or(g["term"], "?"), F.lit(": "), text(g["definition"]))
        return F.array_join(F.array_compact(F.array(head_, more("  Related schemas: ", g["related_schemas"]), more("  Related APIs: ", g["related_apis"]))), "\n")

    return F.concat(F.lit("Business Glossary for "), _or("repo_name"), F.lit("\n\n"), F.array_join(F.transform("business_glossary", entry), "\n"))


def recipe_text() -> Column:
    step = lambda s: F.concat(F.lit("  Step: "), text(s["action"]), F.lit(" ("), text(s["service"]), F.lit(")\n  Purpose: "), text(s["purpose"]))
    top = F.array(_line("Query Recipe: ", text("question")), _line("Repository: ", F.col("repo")))
    return F.concat(_lines(top, F.transform("steps", step), F.array(_line("Answer format: ", text("answer_format")))), F.lit("\n"))


def chunks(kb: Knowledge) -> DataFrame:
    """id, type, name, repo, text, ord of all records; ids may repeat, the index keeps the last."""

    def part(turn: int, kind: str, df: DataFrame, id_: Column, name: Column, repo: Column, body: Column, pos: Column | None = None) -> DataFrame:
        order = F.struct(F.lit(turn).alias("turn"), F.col("ord"), (F.lit(0) if pos is None else pos).alias("pos"))
        return df.select(F.concat_ws(":", F.lit(kind), id_).alias("id"), F.lit(kind).alias("type"), name.alias("name"), repo.alias("repo"), body.alias("text"), order.alias("ord"))

    own = F.concat_ws(":", _or("name"), text("source_file"))
    out = part(1, "schema", kb.schemas, own, F.col("name"), F.col("repo"), schema_text())
    out = out.unionByName(part(2, "service", kb.services, own, F.col("name"), F.col("repo"), service_text()))
    out = out.unionByName(part(3, "api", kb.apis, F.concat_ws(":", text("method"), text("path"), text("source_file")), F.concat_ws(" ", "method", "path"), F.col("repo"), api_text()))
    out = out.unionByName(part(4, "context", kb.contexts, _or("repo_name"), F.col("repo_name"), F.col("repo_name"), context_text()))
    filled = kb.semantic_layers.where("size(business_glossary) > 0")
    out = out.unionByName(part(5, "glossary", filled, _or("repo_name"), F.col("repo_name"), F.col("repo_name"), glossary_text()))
    r = recipes(kb.semantic_layers).withColumn("repo", _or("repo"))
    return out.unionByName(part(6, "recipe", r, F.concat_ws(":", "repo", "pos"), text("question"), F.col("repo"), recipe_text(), F.col("pos")))


def schema_pages(schemas: DataFrame) -> DataFrame:
    """One Markdown page for each schema name: file, name, body. A page holds all records of its name."""
    described = F.exists("fields", lambda f: text(f["description"]) != "")
    cell = lambda c: text(c)
    rules = lambda f: F.array_join(F.coalesce(f["constraints"], F.array().cast("array<string>")), ", ")
    short = F.transform("fields", lambda f: F.concat(F.lit("| "), cell(f["name"]), F.lit(" | "), cell(f["type"]), F.lit(" | "), rules(f), F.lit(" |")))
    long = F.transform("fields", lambda f: F.concat(F.lit("| "), cell(f["name"]), F.lit(" | "), cell(f["type"]), F.lit(" | "), rules(f), F.lit(" | "), cell(f["description"]), F.lit(" |")))
    table = F.when(described, F.concat(F.array(F.lit("| Field | Type | Constraints | Description |"), F.lit("|---|---|---|---|")), long)).otherwise(F.concat(F.array(F.lit("| Field | Type | Constraints |"), F.lit("|---|---|---|")), short))
    links = F.transform("relationships", lambda r: F.concat(F.lit("- "), text(r["type"]), F.lit(" → "), text(r["target"])))
    raw = F.when(text("raw_definition") != "", F.concat(F.lit("```\n"), F.substring("raw_definition", 1, 2000), F.lit("\n```")))
    body = _lines(F.array(F.concat(F.lit("## "), _or("repo")), _line("Source: ", _or("source_file")), _optional("", "description")), table, links, F.array(raw))
    pages = schemas.select("name", "ord", body.alias("part")).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("p"))
    return pages.select(F.concat(F.lit("schemas/"), safe_filename("name"), F.lit(".md")).alias("file"), "name", F.concat(F.lit("# "), "name", F.lit("\n\n"), F.array_join(F.transform("p", lambda p: p["part"]), "\n\n")).alias("body"))


def api_pages(apis: DataFrame) -> DataFrame:
    """One Markdown page for each group of paths."""
    line = F.concat(F.lit("- `"), text("method"), F.lit(" "), text("path"), F.lit("` "), text("handler"))
    pages = apis.select(api_group("path").alias("group"), "ord", line.alias("line")).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("p"))
    return pages.select(F.concat(F.lit("apis/"), safe_filename("group"), F.lit(".md")).alias("file"), F.col("group").alias("name"), F.concat(F.lit("# /"), "group", F.lit("\n\n"), F.array_join(F.transform("p", lambda p: p["line"]), "\n")).alias("body"))


def service_pages(services: DataFrame) -> DataFrame:
    call = lambda m: F.concat(F.lit("- `"), text(m["name"]), F.lit("("), F.coalesce(m["params_raw"], F.array_join(F.transform(m["params"], lambda p: text(p["name"])), ", "), F.lit("")), F.lit(")` "), text(m["returns"]))
    body = _lines(F.array(F.concat(F.lit("# "), _or("name")), _line("Source: ", _or("source_file")), _optional("", "description")), F.transform("methods", call), F.transform("dependencies", lambda d: F.concat(F.lit("- depends on "), d)))
    return services.select(F.concat(F.lit("services/"), safe_filename("name"), F.lit(".md")).alias("file"), "name", body.alias("body"))


def dependency_pages(dependencies: DataFrame) -> DataFrame:
    """One Markdown page for each ecosystem, each name once."""
    first = keep_first(dependencies.withColumn("ecosystem", _or("ecosystem")).withColumn("name", text("name")), "ecosystem", "name")
    line = F.concat(F.lit("- "), "name", F.coalesce(F.concat(F.lit(" "), "version"), F.lit("")))
    pages = first.select("ecosystem", "ord", line.alias("line")).groupBy("ecosystem").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("p"))
    return pages.select(F.concat(F.lit("dependencies/"), safe_filename("ecosystem"), F.lit(".md")).alias("file"), F.col("ecosystem").alias("name"), F.concat(F.lit("# "), F.initcap("ecosystem"), F.lit("\n\n"), F.array_join(F.transform("p", lambda p: p["line"]), "\n")).alias("body"))


def first_names(df: DataFrame, n: int = 10, key: str = "name") -> DataFrame:
    """The first distinct values, in order."""
    return head(keep_first(df.select(key, "ord"), key), n)

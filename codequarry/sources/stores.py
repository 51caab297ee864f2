"""The stored forms of the knowledge tables: one JSON object, Parquet, chunks, Markdown, and settings."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import safe_filename
from codequarry.model import SCHEMAS
from codequarry.operators import render
from codequarry.operators.knowledge import Knowledge
from codequarry.operators.tables import keep_last
from codequarry.sources.page_files import write_tree
from codequarry.sources.versions import FEW, PART, Change, State, Store, part_of


def _repo(df: DataFrame) -> str:
    return "repo" if "repo" in df.columns else "repo_name"


def save(kb: Knowledge, path: str, parts: int = 16) -> State:
    """All tables as one new version of the store at path, bucketed by repository. Readers see it when it is whole."""
    store = Store(kb.schemas.sparkSession, path)
    return store.commit({n: Change(df.withColumn(PART, part_of(_repo(df), parts=parts)), few=parts <= FEW) for n, df in kb.named().items()}, meta={"parts": parts})


def load(spark: SparkSession, path: str, version: int | None = None, repo: str | None = None) -> Knowledge:
    """The latest version of a store or a given one; of one repository, only its bucket is read."""
    store = Store(spark, path)
    state = store.state(version)
    if not state.version:
        return Knowledge.of(spark)
    parts = None
    if repo is not None:
        parts = [spark.range(1).select(part_of(F.lit(repo), parts=state.meta["parts"])).first()[0]]
    tables = {n: store.read(n, state, parts) for n in SCHEMAS}
    if repo is not None:
        tables = {n: df.where(F.col(_repo(df)) == repo) for n, df in tables.items()}
    return Knowledge.of(spark, **tables)


def upsert(new: Knowledge, path: str, repos: DataFrame | None = None) -> State:
    """Records of repositories in place of the stored ones, in all tables; only the buckets of a table that hold or get some are written anew.

    repos: the repositories, as column repo; those that new has records of, unless given. One that is given
    without records is taken out of the store.
    """
    spark = new.schemas.sparkSession
    store = Store(spark, path)
    state = store.state()
    if not state.version:
        return save(new, path)
    n = state.meta["parts"]
    if repos is None:
        repos = reduce(DataFrame.union, [df.select(F.col(_repo(df)).alias("repo")) for df in new.named().values()])
    repos = repos.select("repo").distinct()
    touched = [r[0] for r in repos.select(part_of("repo", parts=n).alias("p")).distinct().collect()]  # at most n numbers
    held = []  # of each table, the buckets that hold records of these repositories or get some
    for name, df in new.named().items():
        key = _repo(df)
        old = store.read(name, state, touched).join(repos.withColumnRenamed("repo", key), key, "left_semi").select(PART)
        held.append(old.union(df.select(part_of(key, parts=n))).select(F.lit(name).alias("name"), F.col(PART).alias("p")))
    held = {(r.name, r.p) for r in reduce(DataFrame.union, held).distinct().collect()}  # at most n numbers for each table
    if outside := sorted({(name, p) for name, p in held if p not in touched}):
        raise ValueError(f"rows outside of the replaced parts {outside[:10]}")
    changes = {}
    for name, df in new.named().items():
        key, own = _repo(df), [p for p in touched if (name, p) in held]
        kept = store.read(name, state, own).drop(PART).join(repos.withColumnRenamed("repo", key), key, "left_anti")
        changes[name] = Change(kept.select(*df.columns).unionByName(df).withColumn(PART, part_of(key, parts=n)), own, guarded=touched)
    return store.commit(changes, state)


def set_relationships(rows: DataFrame, path: str) -> State:
    """Relationships (kind, body), as answers.built_relationships makes them, in place of the stored ones; a version of the store."""
    return Store(rows.sparkSession, path).commit({"relationships": Change(rows.select("kind", F.col("body").cast("string")).withColumn(PART, F.lit(0)))})


def get_relationships(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored relationships; no rows if there are none."""
    store = Store(spark, path)
    state = store.state(version)
    if "relationships" not in state.tables:
        return spark.createDataFrame([], "kind string, body string")
    return store.read("relationships", state).drop(PART)


def upsert_files(new: Knowledge, files: DataFrame, path: str) -> State:
    """Records of single files (repo, path) in place of the stored ones of these files, in buckets of their repositories.

    new: what was extracted of them; of a file that is gone, nothing. Tables without files stay as they are.
    """
    spark = new.schemas.sparkSession
    store = Store(spark, path)
    state = store.state()
    if not state.version:
        return save(new, path)
    n = state.meta["parts"]
    files = files.select("repo", F.col("path").alias("source_file")).distinct()
    touched = [r[0] for r in files.select(part_of("repo", parts=n).alias("p")).distinct().collect()]  # at most n numbers
    changes = {}
    for name, df in new.named().items():
        if {"repo", "source_file"} <= set(df.columns):
            kept = store.read(name, state, touched).drop(PART).join(files, ["repo", "source_file"], "left_anti")
            changes[name] = Change(kept.select(*df.columns).unionByName(df).withColumn(PART, part_of("repo", parts=n)), touched)
    return store.commit(changes, state)


def save_json(kb: Knowledge, path: str) -> None:
    """JSON lines, a folder for each table; nulls are written, so that all columns stand there."""
    for name, df in kb.named().items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def load_json_tables(spark: SparkSession, path: str) -> Knowledge:
    """What save_json has written."""
    return Knowledge.of(spark, **{n: spark.read.schema(s).json(f"{path}/{n}") for n, s in SCHEMAS.items()})


def save_file(kb: Knowledge, path: str, relationships: dict | None = None) -> None:
    """The knowledge file: one JSON object with the summary, a list for each table, and the relationships.

    The file is for one reader; records are streamed to it one by one, as one object can't be written
    by several tasks. Large tables belong into save or save_json.
    """
    from codequarry.operators.knowledge import summary

    with open(path, "w", encoding="utf-8") as f:
        f.write('{"summary": ' + json.dumps(summary(kb).first().asDict()))
        for name, df in kb.named().items():
            f.write(f', "{name}": [')
            for k, r in enumerate(df.orderBy("ord").select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator()):
                f.write((", " if k else "") + r.j)
            f.write("]")
        f.write(', "relationships": ' + json.dumps(relationships or {}) + "}")


def load_relationships(path: str) -> dict:
    """The relationships of a knowledge file; none if there is no file."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f).get("relationships") or {}
    except FileNotFoundError:
        return {}


def load_json(spark: SparkSession, path: str) -> Knowledge:
    """The knowledge file: one JSON object with a list for each table. A missing file is empty."""
    lists = ", ".join(f"{n} array<struct<{_colons(s)}>>" for n, s in SCHEMAS.items())
    try:
        whole = spark.read.schema(lists).json(path, multiLine=True)
        whole.schema  # noqa: B018  a missing path fails here
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return Knowledge.of(spark)
    tables = {n: whole.select(F.posexplode(n).alias("pos", "r")).select("r.*", "pos").withColumn("ord", F.coalesce("ord", F.col("pos").cast("long"))).drop("pos") for n in SCHEMAS}
    return Knowledge.of(spark, **tables)


def _colons(schema: str) -> str:
    """name type, .. as name: type, .. at the top level."""
    out, depth, part = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return ", ".join(out)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as save_chunks has written them (JSON lines), or from files that are one JSON array each.

    What a file is, its first character says. Rows without an id are left out; of equal ids the last one
    by file, then by place in it, counts.
    """
    kind = "id string, type string, name string, repo string, text string"
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    filled = lines.where(F.trim("value") != "")
    arrays = filled.groupBy("file").agg(F.min_by(F.substring(F.ltrim("value"), 1, 1), F.struct("block", "at")).alias("first")).where("first = '['").select("file")
    names = [r.file for r in arrays.collect()]  # whole arrays are read by one task each: files for one reader
    one = filled.where(~F.col("file").isin(names)) if names else filled
    rows = one.select("file", F.struct("block", "at").alias("place"), F.from_json("value", kind).alias("r"))
    for name in names:
        whole = spark.read.text(name, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{_colons(kind)}>>")).alias("pos", "r"))
        rows = rows.unionByName(whole.select(F.lit(name).alias("file"), F.struct(F.lit(0).cast("long").alias("block"), F.col("pos").cast("long").alias("at")).alias("place"), "r"))
    rows = rows.where("r.id is not null").select("r.*", F.struct("file", "place").alias("ord"))
    return keep_last(rows, "id").drop("ord")


def save_chunks(kb: Knowledge, path: str) -> None:
    """The last chunk of each id, as JSON lines."""
    keep_last(render.chunks(kb), "id").select("id", "type", "name", "repo", "text").write.mode("overwrite").json(path)


def pages(kb: Knowledge) -> DataFrame:
    """All Markdown pages: file, body."""
    parts = [render.schema_pages(kb.schemas), render.api_pages(kb.apis), render.service_pages(kb.services), render.dependency_pages(kb.dependencies)]
    contexts = kb.contexts.select(F.concat(F.lit("contexts/"), F.col("repo_name"), F.lit("/context.md")).alias("file"), F.col("repo_name").alias("name"), F.coalesce("context_markdown", F.lit("")).alias("body"))
    out = contexts
    for p in parts:
        out = out.unionByName(p)
    return out


def index_page(kb: Knowledge, n: int = 10) -> str:
    """The page that leads to the others: counts, and the first names of schemas and dependencies."""
    from codequarry.operators.knowledge import summary

    s = summary(kb).first()
    first = lambda df: "\n".join(f"- {r.name}" for r in render.first_names(df.withColumn("name", F.coalesce("name", F.lit("unknown"))), n).collect()) or "- None found"
    rows = [("Data Schemas", f"{s.total_schemas} ({s.unique_schemas} unique)"), ("API Endpoints", s.total_apis), ("Services", s.total_services), ("Dependencies", f"{s.total_dependencies} ({s.unique_dependencies} unique)")]
    counts = "\n".join(f"| {k} | {v} |" for k, v in rows)
    links = "\n".join(f"- [{k.title()}](./{k}/index.md)" for k in ("schemas", "apis", "services", "dependencies"))
    return f"# Knowledge Base\n\n## Summary\n\n| Metric | Count |\n|--------|-------|\n{counts}\n\n## Navigation\n\n{links}\n\n## Quick Reference\n\n### Most Common Schemas\n{first(kb.schemas)}\n\n### Most Used Dependencies\n{first(kb.dependencies)}\n"


def save_all(kb: Knowledge, folder: str) -> None:
    """JSON, Markdown and chunks below a folder that Spark can write to."""
    save_json(kb, f"{folder}/json")
    save_markdown(kb, f"{folder}/markdown")
    save_chunks(kb, f"{folder}/chunks")


def save_markdown(kb: Knowledge, path: str) -> None:
    """The pages as a table of text files by kind; one row is one page."""
    kind: Column = F.split_part("file", F.lit("/"), F.lit(1))
    pages(kb).withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").json(path)


def relationship_files(rows: DataFrame, part_chars: int = 1 << 26) -> DataFrame:
    """file, body of relationships (kind, body): context/relationships.json, an object with a list for each kind.

    Of more than part_chars characters, parts of about that size, context/relationships-00000.json and so on, each an
    object of the same form. No rows, no file. Lists are in the order of their bodies' texts.
    """
    total = rows.agg(F.sum(F.length("body"))).first()[0]
    if total is None:
        return rows.sparkSession.createDataFrame([], "file string, body string")
    parts = max(1, -(-total // part_chars))
    part = F.pmod(F.xxhash64("kind", "body", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    lists = rows.withColumn("part", part).groupBy("part", "kind").agg(F.concat_ws(",\n", F.sort_array(F.collect_list("body"))).alias("b"))
    listed = F.to_json(F.array("kind"))
    quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)
    entry = F.concat(quoted, F.lit(": [\n"), "b", F.lit("\n]"))
    body = F.concat(F.lit("{\n"), F.concat_ws(",\n", F.sort_array(F.collect_list(entry))), F.lit("\n}"))
    name = F.lit("context/relationships.json") if parts == 1 else F.format_string("context/relationships-%05d.json", "part")
    return lists.groupBy("part").agg(body.alias("body")).select(name.alias("file"), "body")


def tree(kb: Knowledge, relationships: DataFrame | dict | None = None) -> DataFrame:
    """The files of the documentation: markdown/... with its index, context/REPOSITORY/context.md, context/relationships.json.

    relationships: rows (kind, body), or one object.
    """
    spark = kb.schemas.sparkSession
    own = pages(kb).where(~F.startswith("file", F.lit("contexts/"))).select(F.concat(F.lit("markdown/"), "file").alias("file"), "body")
    name = safe_filename(F.coalesce("repo_name", F.lit("unknown")))
    contexts = kb.contexts.select(F.concat(F.lit("context/"), name, F.lit("/context.md")).alias("file"), F.coalesce("context_markdown", F.lit("")).alias("body"), "ord")
    contexts = keep_last(contexts, "file").drop("ord")
    single = [("markdown/index.md", index_page(kb))]
    if isinstance(relationships, DataFrame):
        own = own.unionByName(relationship_files(relationships))
    elif relationships:
        single.append(("context/relationships.json", json.dumps(relationships, indent=2)))
    return own.unionByName(contexts).unionByName(spark.createDataFrame(single, "file string, body string"))


def save_tree(kb: Knowledge, path: str, relationships: DataFrame | dict | None = None) -> None:
    """The documentation as files below path, written by the tasks; the tree is replaced when all of it is written."""
    write_tree(tree(kb, relationships), path)


def load_settings(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def save_settings(settings: dict, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.dump(settings, f, sort_keys=False, allow_unicode=True)


def platform(settings: dict) -> str | None:
    return next((p for p in ("local", "github", "gitlab") if p in settings), None)

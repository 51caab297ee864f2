"""From files to knowledge tables: each file goes to the extractors of its name or extension."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.extract import configs, golang, java, jsts, pyast, sdl
from codequarry.operators.knowledge import Knowledge
from codequarry.operators.manifest import name_of, suffix_of

#: Language, extensions.
LANGUAGES = {"java": [".java"], "python": [".py", ".pyi"], "go": [".go", ".mod"], "javascript": [".js", ".jsx", ".ts", ".tsx"], "schema": [".sql", ".graphql", ".gql", ".proto"], "config": [".yaml", ".yml", ".toml", ".json"]}


RECORDS = 1 << 24  # of a file and an extractor that have numbers of their own


@dataclass
class Extractor:
    """A rule of which files it takes, and functions that give records of a kind.

    prepare, where there is one, is applied to the files once; the functions take what it gives.
    """

    language: str
    extensions: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    tables: dict = field(default_factory=dict)
    prepare: Callable[[DataFrame], DataFrame] | None = None


def default_extractors() -> list[Extractor]:
    both = lambda *fs: lambda files: _union([f(files) for f in fs])
    return [
        Extractor("java", [".java"], tables={"schemas": java.entities, "services": java.services, "apis": java.endpoints}),
        Extractor("java", names=["pom.xml"], tables={"dependencies": java.pom_dependencies}),
        Extractor("python", [".py", ".pyi"], tables={"schemas": pyast.schemas, "services": pyast.services, "apis": pyast.apis, "errors": pyast.errors}, prepare=pyast.parse),
        Extractor("python", names=["requirements.txt"], tables={"dependencies": pyast.requirements}),
        Extractor("python", names=["pyproject.toml"], tables={"dependencies": pyast.pyproject_dependencies}),
        Extractor("go", [".go"], tables={"schemas": golang.structs, "services": both(golang.interfaces, golang.services), "apis": golang.routes}),
        Extractor("go", [".mod"], tables={"dependencies": golang.requirements}),
        Extractor("javascript", [".js", ".jsx", ".ts", ".tsx"], tables={"schemas": jsts.schemas, "services": jsts.services, "apis": jsts.routes}),
        Extractor("javascript", [".prisma"], tables={"schemas": jsts.prisma_models}),
        Extractor("javascript", names=["package.json"], tables={"dependencies": jsts.package_dependencies}),
        Extractor("schema", [".sql"], tables={"schemas": sdl.sql_tables}),
        Extractor("schema", [".graphql", ".gql"], tables={"schemas": sdl.graphql_types}),
        Extractor("schema", [".proto"], tables={"schemas": sdl.proto_messages}),
        Extractor("config", [".yaml", ".yml", ".toml", ".json"], tables={"schemas": configs.openapi_schemas, "apis": configs.openapi_endpoints, "dependencies": both(configs.compose_images, configs.kubernetes_images, configs.database_dependencies), "errors": configs.errors}, prepare=configs.as_json),
    ]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _numbered(files: DataFrame) -> DataFrame:
    """source_file and its number in the order of repository and path.

    Files are sorted over all tasks, and each task's start is the number of files before it.
    """
    ranged = files.distinct().repartitionByRange("source_file").sortWithinPartitions("source_file")
    placed = ranged.withColumn("__at", F.monotonically_increasing_id())
    task, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    placed = placed.select("source_file", task.alias("__task"), row.alias("__row"))
    sizes = placed.groupBy("__task").agg(F.count("*").alias("n"))
    before = sizes.select("__task", (F.sum("n").over(Window.orderBy("__task")) - F.col("n")).alias("__before"))  # one row for each task
    return placed.join(F.broadcast(before), "__task").select("source_file", (F.col("__before") + F.col("__row")).alias("__nth"))


def languages_of(path: str) -> list[str]:
    """Languages whose extractors take a path."""
    suffix = path[path.rfind(".") :].lower() if "." in path else ""
    return [k for k, v in LANGUAGES.items() if suffix in v]


def extract(files: DataFrame, extractors: list[Extractor] | None = None, strict_dispatch: bool = False) -> tuple[Knowledge, DataFrame]:
    """Knowledge tables of files (repo, path, content), and errors (repo, source_file, description).

    Records are in the order of repository, path, extractor and place in the file (ord). The files, and
    what is parsed of them, are kept on the executors' disks, so that each file is read and parsed once
    for all tables; a lost part is made again. Python, YAML, TOML and JSON files that can't be parsed
    give an error row, the other extractors take what matches. strict_dispatch takes files by
    extension only, so that dependency files known by name are left out where their extension is
    another extractor's or no one's. What is kept stays for the session; extracted() frees it.
    """
    return _extract(files, extractors, strict_dispatch, [])


@contextmanager
def extracted(files: DataFrame, extractors: list[Extractor] | None = None, strict_dispatch: bool = False) -> Iterator[tuple[Knowledge, DataFrame]]:
    """extract() for a block that writes what it needs: files and parses that were kept are freed at its end."""
    kept: list[DataFrame] = []
    try:
        yield _extract(files, extractors, strict_dispatch, kept)
    finally:
        for df in kept:
            df.unpersist()


def _extract(files: DataFrame, extractors: list[Extractor] | None, strict_dispatch: bool, kept: list[DataFrame]) -> tuple[Knowledge, DataFrame]:
    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist(StorageLevel.DISK_ONLY))
        return kept[-1]

    files = keep(files.select("repo", "path", "content"))
    parts: dict[str, list[DataFrame]] = {}
    extractors = extractors or default_extractors()
    turns = max(32, len(extractors))
    for turn, x in enumerate(extractors):
        if strict_dispatch and x.names:
            continue
        mine = F.lower(suffix_of(F.col("path"))).isin(x.extensions) | name_of(F.col("path")).isin(x.names)
        # repository and path travel as one, since extractors know a file by its path only
        own = files.where(mine).select(F.concat_ws("\x01", "repo", "path").alias("path"), "content")
        own = keep(x.prepare(own)) if x.prepare else own
        for table, f in x.tables.items():
            parts.setdefault(table, []).append(f(own).withColumn("__turn", F.lit(turn)))
    tables = {}
    nth = _numbered(files.select(F.concat_ws("\x01", "repo", "path").alias("source_file"))) if parts else None
    for table, dfs in parts.items():
        df = _union(dfs).join(nth, "source_file")
        repo, path = F.split_part("source_file", F.lit("\x01"), F.lit(1)), F.split_part("source_file", F.lit("\x01"), F.lit(2))
        pos = F.coalesce("pos", F.lit(0)).cast("long")
        pos = F.when(pos < RECORDS, pos).otherwise(F.raise_error(F.concat(F.lit("too many records in "), "source_file")).cast("long"))
        place = (F.col("__nth") * turns + F.col("__turn")) * RECORDS + pos
        tables[table] = df.withColumn("ord", place).withColumn("repo", repo).withColumn("source_file", path).drop("__turn", "pos", "__nth")
    errors = tables.pop("errors").select("repo", "source_file", "description")
    return Knowledge.of(files.sparkSession, **tables), errors


def language_shares(files: DataFrame) -> DataFrame:
    """Per repository and language: bytes and their percentage."""
    from codequarry.operators.manifest import language

    sums = files.groupBy("repo", language(F.col("path")).alias("language")).agg(F.sum(F.octet_length("content")).alias("bytes"))
    total = files.groupBy("repo").agg(F.sum(F.octet_length("content")).alias("__all"))
    share = F.when(F.col("__all") > 0, F.round(100 * F.col("bytes") / F.col("__all"), 2)).otherwise(0.0)
    return sums.join(total, "repo").select("repo", "language", "bytes", share.alias("percent"))

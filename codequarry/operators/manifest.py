"""What of a repository is shown to a model: tiers of files, outlines, a file tree, a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text, token_estimate
from codequarry.operators.outline import OUTLINED, outline

# Fixed values.
SKIP_DIRS = [
    "node_modules", "vendor", ".venv", "venv", "__pycache__", "target", "build", "dist", ".git", ".idea",
    ".vscode",
]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".tiff", ".woff", ".woff2", ".ttf", ".otf",
    ".eot", ".zip", ".tar", ".gz", ".bz2", ".xz", ".rar", ".7z", ".pyc", ".pyo", ".class", ".o", ".so", ".dylib",
    ".dll", ".exe", ".jar", ".war", ".ear", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".flac", ".pdf", ".doc",
    ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".db", ".sqlite", ".sqlite3",
]
LOCK_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "go.sum", "Gemfile.lock",
    "composer.lock", "Pipfile.lock",
]
ENTRY_POINTS = [
    "main.py", "app.py", "index.ts", "index.js", "application.java", "main.java", "main.go", "server.py",
    "server.js", "server.ts",
]
CONFIG_NAMES = [
    "docker-compose.yml", "docker-compose.yaml", "docker-compose.override.yml", "dockerfile", "pom.xml",
    "build.gradle", "build.gradle.kts", "package.json", "go.mod", "pyproject.toml", "cargo.toml",
    "requirements.txt", "gemfile", "makefile", "cmakelists.txt", "tsconfig.json", "webpack.config.js",
    "vite.config.ts", "vite.config.js",
]
CONFIG_EXTENSIONS = [
    ".yaml", ".yml", ".toml", ".ini",
]
TIER1_WORDS = [
    "route", "controller", "handler", "endpoint", "model", "schema", "entity", "migration",
]
SOURCE_EXTENSIONS = [
    ".py", ".java", ".go", ".js", ".ts", ".jsx", ".tsx", ".rb", ".rs", ".cs", ".php", ".sql", ".graphql",
    ".proto",
]
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".java": "java", ".go": "go", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".rb": "ruby", ".rs": "rust", ".cs": "csharp",
    ".php": "php", ".sql": "sql", ".graphql": "graphql", ".gql": "graphql", ".proto": "protobuf", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json", ".xml": "xml", ".ini": "ini", ".cfg": "ini",
    ".md": "markdown", ".rst": "restructuredtext", ".txt": "text", ".sh": "bash", ".bash": "bash", ".zsh": "zsh", ".dockerfile": "dockerfile",
}
#: Of files that are sent to a model; other names are "unknown".
MODEL_LANGUAGES = {
    ".py": "python", ".pyi": "python", ".java": "java", ".go": "go", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".rb": "ruby", ".rs": "rust", ".cs": "csharp",
    ".php": "php", ".sql": "sql", ".graphql": "graphql", ".gql": "graphql", ".proto": "protobuf", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml",
}
MAX_TOKENS, OVERHEAD, LONG_LINES = 150_000, 2000, 200


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    return F.regexp_extract(name_of(path), r"(?s)(?<=.)(\.[^.]+)$", 1)


def stem_of(path: Column) -> Column:
    return F.substring(name_of(path), F.lit(1), F.length(name_of(path)) - F.length(suffix_of(path)))


def in_skipped_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_DIRS)))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(F.startswith(F.lower(name_of(path)), F.lit("dockerfile")), "dockerfile").otherwise(F.coalesce(F.try_element_at(table, F.lower(suffix_of(path))), F.lit("unknown")))


def model_language(path: Column) -> Column:
    """Language by extension, of files for a model."""
    known = F.create_map(*[F.lit(x) for kv in MODEL_LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(suffix_of(path))), F.lit("unknown"))


def is_binary(path: Column, content: Column) -> Column:
    """By extension, by the name of a lock file (lower-cased before it is looked up), or by a zero byte at the head."""
    head = F.substring(content.cast("binary"), 1, 8192)
    return F.lower(suffix_of(path)).isin(BINARY_EXTENSIONS) | F.lower(name_of(path)).isin(LOCK_FILES) | F.coalesce(F.contains(head, F.lit(b"\x00")), F.lit(True))


def tier(path: Column) -> Column:
    """1: what the service is; 2: source, of which the outline is shown; 3: the rest."""
    name, stem, suffix, parts = F.lower(name_of(path)), F.lower(stem_of(path)), F.lower(suffix_of(path)), F.split(path, "/")
    source, words = suffix.isin(SOURCE_EXTENSIONS), "|".join(TIER1_WORDS)
    at_top = (F.size(parts) == 1) | ((F.size(parts) == 2) & (F.lower(F.element_at(parts, 1)) == "config"))
    first = stem.rlike("^(readme|contributing|changelog)") | name.isin(ENTRY_POINTS + CONFIG_NAMES) | (stem == "dockerfile") | name.rlike(r"^(dockerfile\.|docker-compose)") | (stem.rlike(words) & source) | (suffix.isin(CONFIG_EXTENSIONS) & at_top)
    return F.when(first, 1).when(source, 2).otherwise(3)


def file_tree(files: DataFrame) -> DataFrame:
    """repo, tree: each folder once before its files, in order of paths, indented by depth."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("at"), n.alias("depth"), (n < F.size(parts)).alias("folder"), F.element_at(parts, n).alias("name")))
    first = files.select("repo", "path", F.explode(prefixes).alias("p")).select("repo", "path", "p.*")
    once = first.groupBy("repo", "at", "depth", "folder", "name").agg(F.min("path").alias("path"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), "name", F.when(F.col("folder"), "/").otherwise(""))
    rows = once.select("repo", F.struct("path", "depth", line.alias("line")).alias("l"))
    return rows.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("tree"))


def within_budget(files: DataFrame, spent: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """repo, path, tokens, kept of tier-2 files. spent: repo, tokens of all else.

    The largest come first, among equals the smaller path, and each is kept if it still fits; one that
    doesn't may be followed by smaller ones that do. Files without tokens (null) are not kept, and rows
    of a repo that spent does not name are left out.

    A repo's fold runs over its sizes that can fit, at most max_tokens + 1, each with its count: of
    equal files as many are kept as there is room for, and the path of the last is looked up.
    """
    room = spent.select("repo", (F.lit(max_tokens) - F.col("tokens")).alias("room"))
    sizes = files.groupBy("repo", "tokens").agg(F.count("*").alias("m")).join(room, "repo").where("tokens <= room")
    sizes = sizes.groupBy("repo").agg(F.first("room").alias("room"), F.array_sort(F.collect_list(F.struct((-F.col("tokens")).alias("order"), "tokens", "m"))).alias("s"))
    start = F.struct(F.col("room").cast("long").alias("room"), F.array().cast("array<struct<tokens:bigint,m:bigint,take:bigint>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        take = F.when(x["tokens"] == 0, x["m"]).otherwise(F.least(x["m"], F.floor(acc["room"] / F.greatest(x["tokens"], F.lit(1)))))
        entry = F.struct(x["tokens"].cast("long").alias("tokens"), x["m"].alias("m"), take.alias("take"))
        return F.struct((acc["room"] - take * x["tokens"]).alias("room"), F.when(take > 0, F.concat(acc["kept"], F.array(entry))).otherwise(acc["kept"]).alias("kept"))

    kept = sizes.select("repo", F.explode(F.aggregate("s", start, step, lambda acc: acc["kept"])).alias("k")).select("repo", "k.*")
    # where only some of equal size are kept, the last of them: first in each of many parts, then over the parts' first
    some = files.join(kept.where("take < m"), ["repo", "tokens"]).withColumn("part", F.pmod(F.xxhash64("path"), F.lit(64)))
    rank = lambda *keys: F.row_number().over(Window.partitionBy("repo", "tokens", *keys).orderBy("path"))
    some = some.withColumn("rank", rank("part")).where("rank <= take").withColumn("rank", rank()).where("rank = take")
    last = kept.join(some.select("repo", "tokens", F.col("path").alias("last")), ["repo", "tokens"], "left").drop("m", "take")
    known = files.join(room.select("repo"), "repo").join(last.withColumn("fits", F.lit(True)), ["repo", "tokens"], "left")
    return known.select("repo", "path", "tokens", F.coalesce(F.col("fits") & (F.col("last").isNull() | (F.col("path") <= F.col("last"))), F.lit(False)).alias("kept"))


def truncated(content: Column, most: int = LONG_LINES) -> Column:
    parts = F.split(content, "\n")
    return F.when(F.size(parts) > most, F.concat(F.array_join(F.slice(parts, 1, most), "\n"), F.lit("\n# ... (truncated)\n"))).otherwise(content)


def generic_outline(content: Column) -> Column:
    """Structural, decorator and comment lines."""
    keep = F.filter(F.split(text(content), "\n"), lambda s: s.rlike(r"^\s*(@|#|//|/\*|\*|--|def |class |module |function |fn |pub |type |interface |enum |message |service |rpc |input |create |alter |namespace |use |import |package |require )") | s.rlike(r"(?i)^\s*create\s"))
    return F.array_join(keep, "\n")


def outlines(files: DataFrame) -> DataFrame:
    """files (path, content) with outline, by language."""

    @F.pandas_udf("string")
    def by_parser(lang: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([outline(c, k) if k in OUTLINED else "" for k, c in zip(lang, content, strict=True)], dtype=object)

    known = F.col("__lang").isin(*OUTLINED)
    with_ = files.withColumn("__lang", language(F.col("path")))
    return with_.withColumn("outline", F.when(known, by_parser("__lang", text("content"))).otherwise(generic_outline(F.col("content")))).drop("__lang")


def manifest(files: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """files (repo, path, content) with tier, what is shown of each, its tokens and kept."""
    usable = files.where(~in_skipped_dir(F.col("path")) & ~is_binary(F.col("path"), F.col("content")))
    shown = outlines(usable.withColumn("tier", tier(F.col("path"))))
    shown = shown.withColumn("shown", F.when(F.col("tier") == 1, text("content")).when(F.col("tier") == 2, F.col("outline")).otherwise("")).drop("outline")
    shown = shown.withColumn("tokens", token_estimate("shown"))
    trees = file_tree(usable).select("repo", token_estimate("tree").alias("t"))
    tops = shown.where("tier = 1").groupBy("repo").agg(F.sum("tokens").alias("n"))
    spent = trees.join(tops, "repo", "left").select("repo", (F.lit(OVERHEAD) + F.col("t") + F.coalesce("n", F.lit(0))).alias("tokens"))
    kept = within_budget(shown.where("tier = 2").select("repo", "path", "tokens"), spent, max_tokens).select("repo", "path", "kept")
    total = spent.select("repo", (F.col("tokens") > max_tokens).alias("__over"))
    out = shown.join(kept, ["repo", "path"], "left").join(total, "repo", "left")
    cut = F.when((F.col("tier") == 1) & F.col("__over"), truncated(F.col("shown"))).otherwise(F.col("shown"))
    demoted = (F.col("tier") == 2) & ~F.coalesce("kept", F.lit(False))
    out = out.withColumn("shown", F.when(demoted, "").otherwise(cut)).withColumn("tier", F.when(demoted, 3).otherwise(F.col("tier")))
    return out.select("repo", "path", "tier", "shown", token_estimate("shown").alias("tokens"))

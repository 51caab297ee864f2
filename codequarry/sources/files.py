"""Files of repositories as rows.

A Python data source lists and reads them, as Spark's own file sources leave out names that start
with a dot or an underscore. Each partition reads a run of files of about RUN_BYTES; of many
repositories, each task lists and reads some whole ones. Folders to skip, extensions and sizes are
tested before a file is opened. A file that can't be read is a row without content.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codequarry.operators.manifest import SKIP_DIRS

SCHEMA = "repo string, path string, size bigint, content binary"
MAX_SIZE = 1 << 20
RUN_BYTES, MANY_ROOTS = 64 << 20, 64


class _Run(InputPartition):
    def __init__(self, items: list[tuple[str, str, str, int]]):
        self.items = items


class _Roots(InputPartition):
    def __init__(self, roots: list[Path]):
        self.roots = roots


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [Path(p) for p in options["path"].split(",")]
        self.skip = set(options.get("skipdirs", ",".join(SKIP_DIRS)).split(","))
        self.extensions = {e for e in options.get("extensions", "").lower().split(",") if e}
        self.most = int(options.get("maxsize", MAX_SIZE))
        self.n = int(options.get("numpartitions", 0))

    def walk(self, root: Path) -> Iterator[tuple[str, str, str, int]]:
        for at, folders, names in os.walk(root):
            folders[:] = sorted(d for d in folders if d not in self.skip)
            for name in sorted(names):
                full = Path(at, name)
                if self.extensions and full.suffix.lower() not in self.extensions:
                    continue
                try:
                    size = full.stat().st_size
                except OSError:
                    size = 0
                if size <= self.most:
                    yield root.name, str(full.relative_to(root)), str(full), size

    def partitions(self) -> list[InputPartition]:
        if len(self.roots) > MANY_ROOTS:
            n = self.n or len(self.roots) // 4
            return [_Roots(self.roots[k::n]) for k in range(n)]
        found = [f for root in self.roots for f in self.walk(root)]
        n = self.n or max(8, -(-sum(f[3] for f in found) // RUN_BYTES))
        # largest first into the lightest run
        runs: list[list] = [[] for _ in range(max(1, min(n, len(found))))]
        weight = [0] * len(runs)
        for item in sorted(found, key=lambda f: -f[3]):
            k = weight.index(min(weight))
            runs[k].append(item)
            weight[k] += item[3] + 1000
        return [_Run(r) for r in runs]

    def read(self, partition: _Run | _Roots) -> Iterator[tuple]:
        items = partition.items if isinstance(partition, _Run) else (f for root in partition.roots for f in self.walk(root))
        for repo, path, full, size in items:
            try:
                content = Path(full).read_bytes()
            except OSError:
                content = None
            yield repo, path, size, content


class RepositoryFiles(DataSource):
    """spark.read.format("repository_files").load(path): repo, path, size, content."""

    @classmethod
    def name(cls) -> str:
        return "repository_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_files(spark: SparkSession, *roots: str, **options) -> DataFrame:
    """Files under the given repositories. Options: skipdirs, extensions, maxsize, numpartitions."""
    spark.dataSource.register(RepositoryFiles)
    return spark.read.format("repository_files").options(**options).load(",".join(roots))


def as_text(files: DataFrame) -> DataFrame:
    """files with content as text; bytes that aren't UTF-8 are left out."""
    return files.withColumn("content", F.replace(F.expr("make_valid_utf8(cast(content as string))"), F.lit("�"), F.lit("")))


def discover_local(roots: list[str], exclude: list[str] = ()) -> list[Path]:
    """Repositories: a root with .git, else its children with .git or with anything in them."""
    out = []
    for root in map(Path, roots):
        if (root / ".git").exists():
            out.append(root)
            continue
        for child in sorted(p for p in root.iterdir() if p.is_dir()) if root.is_dir() else ():
            if not any(re.search(p, child.name) for p in exclude) and ((child / ".git").exists() or any(child.iterdir())):
                out.append(child)
    return out


def discover_clones(base: str) -> list[Path]:
    """Folders below base that hold .git."""
    return sorted(p.parent for p in Path(base).rglob(".git"))


def included(repos: DataFrame, column: str = "full_path", namespaces: list[str] = (), owners: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Repositories of a listing that are wanted; null paths count as empty.

    A path must start with one of the namespaces and have one of the owners before its first "/",
    where these are given, and hold none of the patterns.
    """
    path = F.coalesce(F.col(column), F.lit(""))
    if namespaces:
        repos = repos.where(reduce(or_, [F.startswith(path, F.lit(n)) for n in namespaces]))
    if owners:
        repos = repos.where(F.split_part(path, F.lit("/"), F.lit(1)).isin(list(owners)))
    for pattern in exclude:
        repos = repos.where(~path.rlike(pattern))
    return repos

"""A store of tables with versions: data files are never changed, a small log file makes a version of them.

    folder/_log/00000000000000000007.json    what version 7 consists of: for each table its schema and,
                                             for each part, the run whose files hold it
    folder/TABLE/run=RUN/_part=K/*.parquet   the rows of a part, written by one run

A part is a bucket of rows, a number that the caller computes (a hash of the repository, a cell of an
index). A commit writes the parts that it changes as a new run and then renames its log file into
place, which fails if another writer was faster. So readers see either the old version or the new one,
a job that dies half-way leaves files that no version names, and a version that a reader has pinned
stays as it is until vacuum() drops it. What a version reads of an unchanged part are the files of
the run that wrote it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"
AT_ONCE = 4  # tables that are written at the same time
FEW = 64  # parts that a task may have open files of at a time, so that it needn't sort its rows by them
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


class WriteConflict(RuntimeError):
    """Another writer has committed a version that changes the same parts."""


def part_of(*columns: str, parts: int) -> F.Column:
    """A bucket by the hash of columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


@dataclass
class Change:
    """New rows of a table. rows has a column _part.

    replaced: the parts that these rows stand for; None: all. A replaced part without rows becomes empty.
    sort: columns that rows are sorted by within a file, so that filters on them skip most of it.
    guarded: parts that stay as they are, but conflict with a writer who has changed them.
    few: there are FEW parts at most, so each task may write a file for each, and rows are neither shuffled nor sorted by them.
    """

    rows: DataFrame
    replaced: Iterable[int] | None = None
    sort: tuple[str, ...] = ()
    guarded: Iterable[int] = ()
    few: bool = False


@dataclass
class State:
    """What a version consists of."""

    version: int = 0
    tables: dict = field(default_factory=dict)  # name: {"schema": JSON, "parts": {part: run}}
    meta: dict = field(default_factory=dict)


@contextmanager
def _open_files(spark: SparkSession, few: bool) -> Iterator[None]:
    """A session that says how many files a task may have open keeps its number."""
    if not few or spark.conf.get(WRITERS, "0") != "0":
        yield
        return
    spark.conf.set(WRITERS, str(FEW))
    try:
        yield
    finally:
        spark.conf.unset(WRITERS)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = self._fs.makeQualified(self._path("")).toString()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    # versions ----------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_log") if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> State:
        """The latest version, or a given one; version 0 is the empty store."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return State()
        if version not in known:
            raise LookupError(f"version {version} is not in {self.folder}")
        stream = self._fs.open(self._path(f"_log/{version:020d}.json"))
        try:
            body = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return State(version, body["tables"], body["meta"])

    def _publish(self, state: State) -> bool:
        """Write the log file of a version; False if there is one already."""
        self._fs.mkdirs(self._path("_log"))
        temporary, final = self._path(f"_log/.{uuid.uuid4().hex}.tmp"), self._path(f"_log/{state.version:020d}.json")
        out = self._fs.create(temporary, False)
        out.write(json.dumps({"tables": state.tables, "meta": state.meta}).encode())
        out.close()
        files = self._hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            files.rename(temporary, final, none)
            return True
        except Exception as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    # reading -----------------------------------------------------------------------------

    def read(self, name: str, state: State | int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        """A table of a version with the column _part. With parts, only their files are listed and read."""
        state = state if isinstance(state, State) else self.state(state)
        if name not in state.tables:
            raise LookupError(f"no table {name} in version {state.version} of {self.folder}")
        table = state.tables[name]
        schema = T.StructType.fromJson(table["schema"])
        wanted = sorted(map(int, table["parts"])) if parts is None else sorted(set(parts) & set(map(int, table["parts"])))
        if not wanted:
            return self.spark.createDataFrame([], schema.add(PART, "integer"))
        base = f"{self.folder}/{name}"
        paths = [f"{base}/run={table['parts'][str(p)]}/{PART}={p}" for p in wanted]
        whole = T.StructType([*schema.fields]).add("run", "string").add(PART, "integer")
        rows = self.spark.read.schema(whole).option("basePath", base).parquet(*paths).drop("run")
        return rows if parts is None else rows.where(F.col(PART).isin(wanted))

    # writing -----------------------------------------------------------------------------

    def commit(self, changes: dict[str, Change], base: State | None = None, meta: dict | None = None, then: Iterable[Callable[[State], tuple[dict[str, Change], dict]]] = ()) -> State:
        """Write changes as a version that follows base (the latest, unless given).

        then: each gets the state to come when its files are written, and gives further changes and meta that
        are made of it, for the same version. If other versions have come since base that change none of
        the same parts, the changes go on top of them; else WriteConflict is raised and the store stays as it is.
        """
        base = self.state() if base is None else base
        run, written, meta = uuid.uuid4().hex, {}, dict(meta or {})
        self._write(changes, run, written)
        for step in then:
            more, more_meta = step(self._after(base, written, run, meta))
            self._write(more, run, written)
            meta |= more_meta
        while True:
            now = self.state()
            if now.version != base.version:
                self._check(base, now, written)
            new = self._after(now, written, run, meta)
            if self._publish(new):
                return new

    def advance(self, now: State, meta: dict) -> State | None:
        """The version after now with other meta and the same tables; None if another writer has made that version first."""
        new = State(now.version + 1, now.tables, now.meta | meta)
        return new if self._publish(new) else None

    def _write(self, changes: dict[str, Change], run: str, written: dict) -> None:
        """Write the new rows of several tables, some at a time."""

        def one(name: str) -> tuple:
            change = changes[name]
            # rebalance gathers a part's rows into files of a good size, and splits a part that is large
            rows = change.rows if change.few else change.rows.hint("rebalance", PART)
            rows = rows.sortWithinPartitions(PART, *change.sort) if change.sort else rows
            if change.replaced is None or change.replaced:
                rows.write.partitionBy(PART).parquet(f"{self.folder}/{name}/run={run}")
            found = [n.partition("=")[2] for n in self._names(f"{name}/run={run}") if n.startswith(f"{PART}=")]
            schema = T.StructType([f for f in change.rows.schema.fields if f.name != PART])
            gone = None if change.replaced is None else {str(p) for p in change.replaced}
            if gone is not None and not gone >= set(found):
                raise ValueError(f"{name}: rows outside of the replaced parts {sorted(set(found) - gone)}")
            return json.loads(schema.json()), found, gone, {str(p) for p in change.guarded}

        with _open_files(self.spark, all(c.few for c in changes.values())), ThreadPoolExecutor(AT_ONCE) as pool:
            written.update(zip(changes, pool.map(inheritable_thread_target(self.spark)(one), changes), strict=True))

    @staticmethod
    def _after(now: State, written: dict, run: str, meta: dict) -> State:
        tables = {k: {"schema": v["schema"], "parts": dict(v["parts"])} for k, v in now.tables.items()}
        for name, (schema, found, gone, _) in written.items():
            old = {} if gone is None else {p: r for p, r in tables.get(name, {"parts": {}})["parts"].items() if p not in gone}
            tables[name] = {"schema": schema, "parts": old | dict.fromkeys(found, run)}
        return State(now.version + 1, tables, now.meta | meta)

    def _check(self, base: State, now: State, written: dict) -> None:
        for name, (_, _, gone, guarded) in written.items():
            then, since = (s.tables.get(name, {"parts": {}})["parts"] for s in (base, now))
            changed = {p for p in {*then, *since} if then.get(p) != since.get(p)}
            if changed and (gone is None or changed & (gone | guarded)):
                raise WriteConflict(f"{name}: version {now.version} has changed parts {sorted(changed)[:10]}")

    def vacuum(self, keep: int = 2) -> int:
        """Drop all but the last versions, and the runs that none of these names; not while others write. Returns the number of runs."""
        known = self.versions()
        kept = [self.state(v) for v in known[-keep:]]
        used = {(n, r) for s in kept for n, t in s.tables.items() for r in t["parts"].values()}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"_log/{v:020d}.json"), False)
        dropped = 0
        for name in self._names(""):
            for entry in self._names(name):
                if entry.startswith("run=") and (name, entry[4:]) not in used:
                    dropped += self._fs.delete(self._path(f"{name}/{entry}"), True)
        return dropped

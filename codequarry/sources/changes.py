"""Repositories as a stream of changes: each added, changed or deleted file arrives once.

The stream's offset is the number of a listing. A listing holds repository, path, size and time of
change of all files; it is written, compressed, to a state folder when it differs from the one before,
and stays until the batch that ends with it is committed. A batch is the difference of two listings: a
restarted query finds the same ones and so reads the same changes. Contents are read by the tasks.
A file that changes again between listing and reading comes again with the next listing.

The process that plans the stream lists the files, some 100 bytes each in memory.
"""

from __future__ import annotations

import gzip
import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codequarry.operators.manifest import SKIP_DIRS
from codequarry.sources.files import MAX_SIZE, RUN_BYTES

SCHEMA = "repo string, path string, change string, size bigint, content binary"
ADDED, CHANGED, DELETED = "added", "changed", "deleted"


class _Run(InputPartition):
    def __init__(self, items: list[tuple]):
        self.items = items


class _Changes(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [Path(p) for p in options["path"].split(",")]
        self.state = Path(options["state"])
        self.skip = set(options.get("skipdirs", ",".join(SKIP_DIRS)).split(","))
        self.most = int(options.get("maxsize", MAX_SIZE))

    def listing(self) -> dict[str, list]:
        """All files now: full path to repository, path, size, time of change."""
        out = {}
        for root in self.roots:
            for at, folders, names in os.walk(root):
                folders[:] = [d for d in folders if d not in self.skip]
                for name in names:
                    full = Path(at, name)
                    try:
                        s = full.stat()
                    except OSError:
                        continue  # gone since
                    out[str(full)] = [root.name, str(full.relative_to(root)), s.st_size, s.st_mtime_ns]
        return out

    def _file(self, at: int) -> Path:
        return self.state / f"{at:012d}.json.gz"

    def _load(self, at: int) -> dict[str, list]:
        return json.loads(gzip.decompress(self._file(at).read_bytes())) if at else {}

    def _last(self) -> int:
        return max((int(p.name[:12]) for p in self.state.glob("*.json.gz")), default=0) if self.state.is_dir() else 0

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last, now = self._last(), self.listing()
        if now == self._load(last):
            return {"listing": last}
        self.state.mkdir(parents=True, exist_ok=True)
        temporary = self.state / f".{uuid.uuid4().hex}"
        temporary.write_bytes(gzip.compress(json.dumps(now).encode()))
        temporary.rename(self._file(last + 1))
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._load(start["listing"]), self._load(end["listing"])
        found = [(*old[f][:3], f, DELETED) for f in old.keys() - new.keys()]
        found += [(*new[f][:3], f, CHANGED if f in old else ADDED) for f in new if old.get(f) != new[f]]
        runs, room = [[]], RUN_BYTES
        for item in sorted(found, key=lambda x: x[3]):
            if room < 0:
                runs.append([])
                room = RUN_BYTES
            runs[-1].append(item)
            room -= min(item[2], self.most) + 1000
        return [_Run(r) for r in runs if r]

    def read(self, partition: _Run) -> Iterator[tuple]:
        for repo, path, size, full, change in partition.items:
            content = None
            if change != DELETED and size <= self.most:
                try:
                    content = Path(full).read_bytes()
                except OSError:
                    content = None
            yield repo, path, change, size, content

    def commit(self, end: dict) -> None:
        for p in self.state.glob("*.json.gz"):
            if int(p.name[:12]) < end["listing"]:
                p.unlink(missing_ok=True)


class RepositoryChanges(DataSource):
    """spark.readStream.format("repository_changes").option("state", folder).load(path): repo, path, change, size, content.

    A file above maxsize, or one that can't be read, comes without content.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(dict(self.options))


def stream_changes(spark: SparkSession, state: str, *roots: str, **options) -> DataFrame:
    """Changes of the files under the given repositories as a stream; state: a folder of this stream alone."""
    spark.dataSource.register(RepositoryChanges)
    return spark.readStream.format("repository_changes").options(**options).option("state", state).load(",".join(roots))


def real_changes(changes: DataFrame, expire: int | None = None) -> DataFrame:
    """The changes of a stream that change anything: repo, path, change, sha (of the content), content.

    Keeps the hash of each file's content as state. What has the content that it had (a replayed batch, a touched
    file) goes, a deletion of what isn't known goes, and kinds follow what is known: a file comes as added
    once. Files that weren't heard of for `expire` milliseconds leave the state;
    that is not tested, and is for triggers by time: a query that ends when all is read (availableNow) did not end with it.
    """
    out = T.StructType().add("repo", "string").add("path", "string").add("change", "string").add("sha", "string").add("content", "binary")
    kept = T.StructType().add("sha", "string")

    def follow(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0] if state.exists else None
        before, rows = known, []
        for frame in frames:
            for change, sha, content in zip(frame["change"], frame["sha"], frame["content"], strict=True):
                known, last = (None, None) if change == DELETED else (sha, content)
                rows = [last]
        if known is None:
            if state.exists:
                state.remove()
        else:
            state.update((known,))
            if expire:
                state.setTimeoutDuration(expire)
        if known != before and rows:
            kind = DELETED if known is None else CHANGED if before is not None else ADDED
            yield pd.DataFrame({"repo": [key[0]], "path": [key[1]], "change": [kind], "sha": [known], "content": [rows[0]]})

    hashed = changes.withColumn("sha", F.sha2(F.coalesce("content", F.lit(b"")), 256))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return hashed.select("repo", "path", "change", "sha", "content").groupBy("repo", "path").applyInPandasWithState(follow, out, kept, "append", timeout)

"""Incremental ingest: changed files arrive as a stream and replace their repository's records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codequarry.operators.knowledge import Knowledge
from codequarry.plans.pipeline import extracted
from codequarry.sources import stores
from codequarry.sources.files import as_text

FILES = "repo string, path string, content string"


def changed_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Files that are dropped as Parquet into a folder, as a stream."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def ingest(files: DataFrame, read: Callable[[], Knowledge], write: Callable[[Knowledge], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """For each batch, records of its repositories replace the stored ones.

    read gives the stored tables and write puts new ones in their place. A batch may come twice
    after a failure; as it replaces whole repositories, the result is the same.
    """

    def put(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        repos = batch.select("repo").distinct()
        with extracted(batch) as (found, _errors):
            old, new = read().named(), found.named()
            merged = {}
            for name, df in old.items():
                if "repo" not in df.columns:
                    merged[name] = df
                else:
                    kept = df.join(repos, "repo", "left_anti").select(*df.columns)
                    merged[name] = kept.unionByName(new[name].select(*df.columns))
            write(Knowledge(**merged))

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_changes(changes: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A stream of changed files (repo, path, change, content as bytes) into the store at path.

    Each batch is extracted and becomes one version of the store, in which the records of its files replace the old
    ones; those of deleted files go. A batch that comes twice gives the same state.
    """

    def put(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        with extracted(as_text(batch.where("change <> 'deleted'"))) as (new, _errors):
            stores.upsert_files(new, batch, path)

    writer = changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

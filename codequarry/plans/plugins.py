"""Extractors of a user's own: a Python function of one file, run as a table function.

The function gets a file's path and content and gives records as dicts. What it raises becomes an
error row of that file, with the records that it gave before; other files are not touched.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from codequarry.model import SCHEMAS
from codequarry.plans.pipeline import Extractor

Function = Callable[[str, str], Iterable[dict]]
RECORD = T.StructType().add("source_file", "string").add("pos", "integer").add("record", "string").add("description", "string")


def table_function(function: Function):
    """The function as a table function of (path, content): source_file, pos, record (JSON), description (of an error)."""

    class Records:
        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
            for name, a in (("path", path), ("content", content)):
                if not isinstance(a.dataType, (T.StringType, T.NullType)):
                    raise ValueError(f"{name} must be a string, not {a.dataType.simpleString()}")
            return AnalyzeResult(RECORD)

        def eval(self, path: str, content: str) -> Iterator[tuple]:
            pos = 0
            try:
                for record in function(path, content):
                    yield path, pos, json.dumps(record), None
                    pos += 1
            except Exception as e:  # a plug-in may raise anything; the row says what
                yield path, pos, None, f"{type(e).__name__}: {e}"

    return F.udtf(Records)


def run(files: DataFrame, function: Function) -> DataFrame:
    """All records and errors of files (path, content)."""
    made = table_function(function)(F.col("path").outer(), F.col("content").outer())
    return files.select("path", "content").lateralJoin(made).select(*RECORD.names)


def plugin(language: str, table: str, function: Function, extensions: Iterable[str] = (), names: Iterable[str] = ()) -> Extractor:
    """An extractor of a kind of record; the function's dicts have the columns of that table, missing ones are null."""
    columns = ", ".join(c for c in _fields(table))
    parsed = lambda rows: rows.where("record is not null").select("source_file", "pos", F.from_json("record", columns).alias("r")).select("source_file", "pos", "r.*")
    failed = lambda rows: rows.where("description is not null").select("source_file", "pos", "description")
    return Extractor(language, list(extensions), list(names), {table: parsed, "errors": failed}, lambda files: run(files, function))


def _fields(table: str) -> list[str]:
    """Columns of a table that an extractor fills."""
    kinds = T._parse_datatype_string(SCHEMAS[table])
    return [f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields if f.name not in ("repo", "source_file", "ord")]

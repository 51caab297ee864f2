"""Enrichment by a language model: provider interface, cache, rate limit, and JSON out of answers.

No provider is reachable here; the offline one answers from the prompt alone, so that all else can
run. Each failure is a row with its error, never an exception.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.functions import cache_key, text

MAX_FILE_SIZE = 100_000


class Provider(Protocol):
    def complete(self, prompt: str) -> str: ...


class OfflineProvider:
    """A JSON object with the length and the first words of the prompt."""

    def complete(self, prompt: str) -> str:
        return json.dumps({"length": len(prompt), "description": " ".join(prompt.split()[:5])})


def _objects(s: str) -> Iterator[str]:
    """The candidates in turn: what stands in fences, the first balanced object, first to last brace."""
    for part in s.split("```")[1::2]:
        yield part.removeprefix("json").strip()
    at = s.find("{")
    if at >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(at, len(s)):
            c = s[i]
            if quoted:
                quoted = escaped or c != '"'
                escaped = c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    yield s[at : i + 1]
                    break
        yield s[at : s.rfind("}") + 1]


def first_json(s: str | None) -> str | None:
    """The first JSON object in an answer."""
    for part in _objects(s or ""):
        try:
            if isinstance(json.loads(part), dict):
                return part
        except ValueError:
            pass
    return None


def salvage_json(df: DataFrame, column: str) -> DataFrame:
    """df with json, the first object in the column's text, or null."""

    @F.pandas_udf("string")
    def pick(s: pd.Series) -> pd.Series:
        return s.map(first_json)

    return df.withColumn("json", pick(column))


def _answered(keyed: DataFrame, cache: DataFrame | None, provider: Provider, rate_per_minute: float, inputs: list[str], make: Callable[..., str | None]) -> DataFrame:
    """keyed (key, ...) with answer, cached and error. make gives a row's prompt of its inputs; none if it is too large."""
    if cache is None:
        keyed = keyed.withColumn("answer", F.lit(None).cast("string"))
    else:
        keyed = keyed.join(cache.groupBy("key").agg(F.first("answer").alias("answer")), "key", "left")
    keyed = keyed.withColumn("cached", F.col("answer").isNotNull())
    schema = T.StructType([*keyed.schema.fields, T.StructField("error", T.StringType())])
    pause = 60 / rate_per_minute if rate_per_minute else 0

    def ask(answer: str | None, *values) -> tuple[str | None, str | None]:
        if answer is not None:
            return answer, None
        prompt = make(*values)
        if prompt is None:
            return None, "too large"
        try:
            time.sleep(pause)
            return provider.complete(prompt), None
        except Exception as e:  # a provider may raise anything; the row says what
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            done = [ask(*x) for x in zip(*[cols[c].to_pylist() for c in ("answer", *inputs)], strict=True)]
            cols |= {"answer": pa.array([a for a, _ in done], pa.string()), "error": pa.array([e for _, e in done], pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return keyed.mapInArrow(run, schema)


def extract(files: DataFrame, cache: DataFrame | None, provider: Provider, rate_per_minute: float = 0, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """files (path, content) with key, answer, json, cached and error.

    Answers of the cache (key, answer) are not asked for again. The rate holds for each task.
    """

    def make(path: str, content: str) -> str | None:
        return None if len(content or "") > max_size else f"File: {path}\n\n{content}"

    keyed = files.withColumn("key", cache_key("content", "path"))
    return salvage_json(_answered(keyed, cache, provider, rate_per_minute, ["path", "content"], make), "answer")


def complete(prompts: DataFrame, cache: DataFrame | None, provider: Provider, rate_per_minute: float = 0) -> DataFrame:
    """prompts (key, prompt) with answer, cached and error; cache and rate as in extract. A null prompt is an empty one."""
    return _answered(prompts, cache, provider, rate_per_minute, ["prompt"], lambda prompt: prompt or "")


def split_context(df: DataFrame, column: str = "answer", marker: str = "---METADATA---") -> DataFrame:
    """Markdown before the marker and the JSON after it.

    Without the marker, an object with a purpose_summary is looked for in the whole answer; the Markdown
    then ends before its fence, or before the last open brace if there is none. Else all is Markdown.
    """
    has = F.contains(text(column), F.lit(marker))
    with_ = df.withColumn("markdown", F.when(has, F.split_part(column, F.lit(marker), F.lit(1))).otherwise(text(column))).withColumn("__meta", F.when(has, F.split_part(column, F.lit(marker), F.lit(2))).otherwise(F.col(column)))
    made = salvage_json(with_, "__meta").drop("__meta")
    trailing = ~has & F.get_json_object("json", "$.purpose_summary").isNotNull()
    brace = F.length(column) - F.locate("{", F.reverse(F.col(column)))  # characters before the last one
    before = F.when(F.contains(text(column), F.lit("{")), F.left(F.col(column), brace)).otherwise(text(column))
    fence = F.when(F.contains(before, F.lit("```")), F.substring_index(before, "```", -1))
    cut = F.when(fence.isNotNull(), F.left(before, F.length(before) - F.length(fence) - 3)).otherwise(before)
    return made.withColumn("markdown", F.regexp_replace(F.when(trailing & (cut != ""), cut).otherwise(F.col("markdown")), r"^\s+|\s+$", ""))

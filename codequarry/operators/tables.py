"""Relational steps that recur: first or last row of a key, ordered limits, substring joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASKS_PER_CORE = 4


def keep_first(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """The row of smallest order for each key; aggregated on the map side, so a hot key is no burden."""
    rest = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    picked = df.groupBy(*keys).agg(F.min_by(rest, F.col(order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def keep_last(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """The row of largest order for each key."""
    rest = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    picked = df.groupBy(*keys).agg(F.max_by(rest, F.col(order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*(order or ("ord",))).limit(n)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt evenly over tasks, or by the hash of keys, before work that is dear for each of them.

    A table of short rows is a file or two of few row groups, so one or two tasks would do all of it.
    """
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, *keys)


def substring_pairs(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Distinct (a, b) of which one contains the other, case ignored; empty values are left out.

    Instead of a nested loop, the substrings of each value are joined by equality with the values of
    the other side, and only those of lengths that stand there: the work is a value's length for each
    such length, of which there are at most as many as the longest name has characters.
    """
    one = left.select(F.col(a).alias("a")).where("a <> ''").distinct().withColumn("la", F.lower("a"))
    two = right.select(F.col(b).alias("b")).where("b <> ''").distinct().withColumn("lb", F.lower("b"))

    def parts(df: DataFrame, low: str, other: DataFrame, key: str) -> DataFrame:
        sizes = other.agg(F.array_sort(F.collect_set(F.length(key))).alias("sizes"))  # one row
        each = df.crossJoin(F.broadcast(sizes)).withColumn("k", F.explode(F.filter("sizes", lambda k: k <= F.length(low)))).drop("sizes")
        starts = F.sequence(F.lit(1), F.length(low) - F.col("k") + 1)
        return each.withColumn("part", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(low), i, F.col("k")))))).drop("k")

    inside = two.join(parts(one, "la", two, "lb"), F.col("part") == F.col("lb")).select("a", "b")
    around = one.join(parts(two, "lb", one, "la"), F.col("part") == F.col("la")).select("a", "b")
    return inside.union(around).distinct()

"""Vectors as whole numbers floor(scale * c), which sums and distances of are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(rows: DataFrame, vec_col: str, keep: dict[str, str], scale: int, bits: int) -> tuple[DataFrame, int]:
    """(rows with a column x array<bigint> and the columns of `keep`, new name to old, the length of x).

    Rows go whose vector is null, or holds null or non-finite components or one whose whole number
    is 2**bits or more in size. All x have one length: the commonest one above 0 among these rows, of
    equally common ones the largest; rows of another length go too. Without rows the length is 0.
    """
    v = F.col(vec_col)
    some = rows.select(*(F.col(old).alias(new) for new, old in keep.items()), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    unfit = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= 2.0**bits / scale)
    some = some.where(~F.exists("v", unfit))
    lengths = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = lengths.n if lengths else 0
    some = some.where(F.size("v") == length)
    return some.select(*keep, F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x")), length

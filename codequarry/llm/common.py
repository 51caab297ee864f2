"""Helpers that the operators of this subpackage share: tables, materialised steps, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what the session names in spark.checkpoint.dir. Only where that is unset and driver and
    executors are one process, as in tests, a temporary folder is set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("codequarry.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        folder = "file://" + tempfile.mkdtemp(prefix="codequarry-")
        spark.conf.set("codequarry.shared.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors; rows, columns and
    types stay as they are.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codequarry/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialised step that no later step reads."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _settled(edges: DataFrame) -> bool:
    """Whether edges(a, b) with a > b are stars: every a has one b, which is the a of no edge."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b), as (node, component): the smallest reachable node.

    Alternates the large-star and small-star steps, which halve the depth of the trees, until the
    edges are stars around their smallest nodes. Each step aggregates minima (combined on the map
    side) and joins them back, one row for a node, so that Spark's skew join can split the edges of a
    node that has very many. Edges with a null end and loops are ignored; nodes without edges don't
    appear.
    """
    down = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialize(down(edges.where("a <> b")).distinct())
    while not _settled(e):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = down(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low2.select("a", F.col("m").alias("b")))
        new = materialize(down(small.where("a <> b")).distinct())
        forget(e)
        e = new
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def fold(id_col: Column, n: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, id_col: str, text_col: str, sample_docs: int, sample_chars: int) -> Iterator[tuple[str, int]]:
    """Labelled texts, first by a hash of the id: at most sample_docs, and sample_chars characters in all.

    Texts of more than an eighth of sample_chars are passed over, so that no single one uses up the
    bound: wherever it cuts, seven eighths of sample_chars have been taken.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").where(may_learn)
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= sample_chars // 8)
    texts = texts.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    so_far = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("id"), "id"))  # over sample_docs rows at most
    for r in texts.withColumn("n", so_far).where(F.col("n") <= sample_chars).select("text", "y").toLocalIterator():
        yield r.text, r.y


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(items: Column, state: Column, made: str, step, part: int = 256) -> Column:
    """What step makes of an array's items in turn, as one array.

    step(state, item) returns the next state and an array of type `made`. Results are gathered part
    by part, so that very many items don't copy one growing array again and again.
    """
    none = lambda kind: F.array().cast(kind)

    def inner(acc, x):
        new, out = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], out).alias("out"))

    def outer(acc, k):
        done = F.aggregate(F.slice(items, k * part + 1, F.lit(part)), F.struct(acc["state"].alias("state"), none(made).alias("out")), inner)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    parts = F.when(F.size(items) > 0, F.sequence(F.lit(0), ((F.size(items) - 1) / part).cast("int"))).otherwise(none("array<int>"))
    return F.aggregate(parts, F.struct(state.alias("state"), none(f"array<{made}>").alias("out")), outer, lambda acc: F.flatten(acc["out"]))

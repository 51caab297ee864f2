"""Sharding with near-equal bytes by Karmarkar-Karp differencing.

Equal texts form a group that stays together. A partial partition holds one sum of bytes for each
shard. At first each group is one, with all its bytes in one place; then the two partial partitions
of largest spread are combined, the largest place of one with the smallest of the other, until one
is left.

The groups of more than 1/LARGE of a shard's fair share, of which there are at most n_shards * LARGE,
are combined first, by the driver. The other groups are combined in tasks, one for each bucket (a
hash of the text, `bucket_groups` groups on average); what a bucket leaves is one partial partition.
Those are combined in turn, up to `bucket_groups` in a task, until one is left. Each task starts with
one more partial partition, its share of the sums of the large groups, so that the others even out
what the large ones left uneven; in the last task the places of that share name the shards.

A group of more bytes than a shard's fair share can't be balanced whole. Only such groups (fewer
than the shards) are cut, into pieces by a hash of the id and the number of the copy within the id, which
are then groups of their own; so rows of one id, or of none, are spread as well.

Slots number a shard's rows without gaps: rows are numbered in chunks of about `chunk_rows`, and
each chunk starts where those before it end, so no task holds a whole shard. Copies of a text of more
than a chunk and 1/MANY of all rows (fewer than MANY texts) are dealt to the chunks by their number too. Copies are numbered
from their count, as rows of equal id and text are the same.

Defined cases: a null text has size 1 and the crc32 of no bytes, and shares its group with empty
texts; very long texts count with all their bytes; repeated rows get a slot each; rows with a null
id are placed like others, however many have the same text; ties in size go by the text's hash; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import materialize

PIECES = 1024
LARGE = 512
MANY = 512


def difference(sizes: list[list[int]], n_shards: int) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions, given as lists of n_shards sums.

    Returns the sums of the last one, and for each given one the shard of each of its places.
    """
    n = len(sizes)
    if not n:
        return [0] * n_shards, []
    # nodes: the given ones, then the combined ones; a node's places stand in descending order
    sums, parts = [], []
    heap = []
    for k, s in enumerate(sizes):
        order = sorted(range(n_shards), key=lambda i: -s[i])
        sums.append([s[i] for i in order])
        parts.append((order, None, None))
        heap.append((sums[k][-1] - sums[k][0], k))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        joint = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        order = sorted(range(n_shards), key=lambda i: -joint[i])
        sums.append([joint[i] for i in order])
        parts.append((order, a, b))
        sums[a] = sums[b] = None
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    top = heap[0][1]
    place: list = [None] * len(parts)
    place[top] = list(range(n_shards))
    for k in range(top, -1, -1):
        order, a, b = parts[k]
        mine = place[k]
        if a is None:
            own = [0] * n_shards
            for rank, i in enumerate(order):
                own[i] = mine[rank]
            place[k] = own
        else:
            left, right = [0] * n_shards, [0] * n_shards
            for rank, i in enumerate(order):
                left[i], right[n_shards - 1 - i] = mine[rank], mine[rank]
            place[a], place[b] = left, right
            place[k] = None
    return sums[top], place[:n]


def _combine(nodes: DataFrame, n_nodes: int, keys: list[str], n_shards: int, large_sums: list[int], fan: int) -> tuple[DataFrame, DataFrame, int]:
    """Combine the partial partitions of nodes(*keys, sums) in tasks of about fan each.

    Returns, written down, (*keys, parent, places), where a node's sums stand in its parent, the
    parents as nodes(node, sums), and their number. The places of an only parent are the shards.
    """
    n = max(1, -(-n_nodes // fan))
    share = [s // n for s in large_sums]
    fields = [f"{k} {nodes.schema[k].dataType.simpleString()}" for k in keys]
    dealt = nodes.withColumn("parent", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("long"))

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(most=[max(s) for s in pdf["sums"]]).sort_values(["most", *keys], ascending=[False, *[True] * len(keys)], ignore_index=True)
        sums = [[int(x) for x in s] for s in pdf["sums"]]
        _, places = difference([*sums, share], n_shards)
        named = {place: k for k, place in enumerate(places[-1])} if n == 1 else {k: k for k in range(n_shards)}
        total = [0] * n_shards
        places = [[named[x] for x in p] for p in places[:-1]]
        for s, p in zip(sums, places, strict=True):
            for x, k in zip(s, p, strict=True):
                total[k] += x
        out = pdf[[*keys, "parent"]].assign(places=places, sums=None)
        last = pd.DataFrame([{**dict.fromkeys(keys), "parent": pdf["parent"].iloc[0], "places": None, "sums": total}])
        return pd.concat([out.astype(object), last.astype(object)], ignore_index=True)

    made = materialize(dealt.groupBy("parent").applyInPandas(task, ", ".join([*fields, "parent long", "places array<int>", "sums array<long>"])))
    return made.where("places is not null").drop("sums"), made.where("sums is not null").select(F.col("parent").alias("node"), "sums"), n


def _copies(rows: DataFrame, block: int) -> DataFrame:
    """rows with copy, the number of a row among those of equal id and text, made from counts in blocks."""
    same = ["id", "size", "crc", "text_key"]
    counts = rows.groupBy(*same).agg(F.count("*").alias("m"))
    blocks = counts.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(block).cast("long"))))
    blocks = blocks.repartition("text_key", "id", "from")
    return blocks.select(*same, F.explode(F.sequence("from", F.least("m", F.col("from") + block) - 1)).alias("copy"))


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", bucket_groups: int = 100_000, chunk_rows: int = 50_000) -> DataFrame:
    """Per row: id, size, text_crc32, shard and slot."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("crc"), F.unhex(F.sha2("text", 256)).alias("text_key"))
    rows = materialize(rows)
    texts = rows.groupBy("text_key").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    total, n, n_rows = texts.agg(F.sum("size"), F.count("*"), F.sum("n")).first()
    fair = (total or 0) / n_shards
    hot = texts.where((F.col("size") > fair) | (F.col("n") > max(chunk_rows, (n_rows or 0) / MANY))).collect()  # fewer than n_shards and MANY
    many, cut = [bytes(r.text_key) for r in hot], [bytes(r.text_key) for r in hot if r.size > fair]
    if many:
        spread = F.col("text_key").isin(many)
        rows = rows.where(~spread).withColumn("copy", F.lit(0).cast("long")).unionByName(_copies(rows.where(spread), chunk_rows))
    else:
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    piece = F.when(F.col("text_key").isin(cut), F.pmod(F.pmod(F.xxhash64("id"), F.lit(PIECES)) + F.col("copy"), F.lit(PIECES))).otherwise(0) if cut else F.lit(0)
    rows = rows.withColumn("piece", piece.cast("int"))
    groups = rows.groupBy("text_key", "piece").agg(F.sum("size").alias("size"))
    is_large = F.col("size") > fair / LARGE
    large = groups.where(is_large).orderBy(F.desc("size"), "text_key", "piece").collect()  # n_shards * LARGE at most
    large_sums, large_places = difference([[r.size] + [0] * (n_shards - 1) for r in large], n_shards)
    large_to = docs.sparkSession.createDataFrame([(r.text_key, r.piece, p[0]) for r, p in zip(large, large_places)], "text_key binary, piece int, shard int")

    sums = F.concat(F.array("size"), F.array_repeat(F.lit(0).cast("long"), n_shards - 1))
    small, nodes, count = _combine(groups.where(~is_large).select("text_key", "piece", sums.alias("sums")), n or 0, ["text_key", "piece"], n_shards, large_sums, bucket_groups)
    where = small.select("text_key", "piece", F.col("parent").alias("node"), F.col("places")[0].alias("place"))
    while count > 1:
        placed, nodes, count = _combine(nodes, count, ["node"], n_shards, large_sums, bucket_groups)
        where = where.join(placed, "node").select("text_key", "piece", F.col("parent").alias("node"), F.element_at("places", F.col("place") + 1).alias("place"))
    where = where.select("text_key", "piece", F.col("place").alias("shard")).unionByName(large_to)

    chunks = max(1, -(-(n_rows or 0) // (n_shards * chunk_rows)))
    out = rows.join(where, ["text_key", "piece"]).select("id", "size", "crc", "shard", F.pmod(F.pmod(F.xxhash64("id", "crc"), F.lit(chunks)) + F.col("copy"), F.lit(chunks)).alias("chunk"))
    out = materialize(out)
    ahead = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row for chunk_rows rows
    starts = out.groupBy("shard", "chunk").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("id", "size", "crc")) - 1
    numbered = out.withColumn("rank", rank).join(starts, ["shard", "chunk"])
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))


def shard_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op7."""
    placed = shard_by_bytes(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

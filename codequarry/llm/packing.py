"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are numbers of words plus one for the end mark, or any column the caller names. A document
longer than the largest permitted sequence is cut into pieces of that length and a rest. A sequence
of capacity c costs c tokens, a fixed amount, and an amount that grows with its square, as attention
does; so neither the largest nor the smallest size is always the cheapest.

In each bucket of pieces (a hash of id and piece, of about `bucket_pieces`) pieces are taken in
descending order. Each goes to the open bin that it leaves least room in. If none has room, a bin is
opened: of the permitted sizes, the one that costs least for each token it can still be filled with
from the pieces to come, which are known. At the end each bin shrinks to the least permitted size
that holds its contents. The bucket is also packed with bins opened at one size only, where pieces
allow it, and the cheapest of these packings is kept; so no single size does better.

Defined cases: null and empty texts have length 1; very long texts are cut into pieces; repeated
rows are packed one by one; rows with a null id are packed like others; ties in length go by id and
piece; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import materialize

CAPACITIES = (512, 1024, 2048, 4096)
SEQUENCE_COST, SQUARE_COST = 32, 1 / 16384


def word_length(text: Column) -> Column:
    """Words between ASCII white space, plus one for the end mark."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def costs(capacities: tuple[int, ...], sequence_cost: float = SEQUENCE_COST, square_cost: float = SQUARE_COST) -> dict[int, float]:
    return {c: c + sequence_cost + square_cost * c * c for c in sorted(capacities)}


def fillable(room: int, counts: list[int], lengths: int) -> int:
    """Tokens that pieces to come put into so much room, the longest that fits taken again and again.

    counts: number of pieces of each length; lengths: bit n is set where there are any.
    """
    left = room
    fitting = lengths & ((2 << left) - 1)
    while fitting:
        n = fitting.bit_length() - 1
        left -= n * min(counts[n], left // n)
        fitting &= (1 << min(n, left + 1)) - 1
    return room - left


def best_fit(lengths: list[int], cost: dict[int, float], least: int = 0) -> tuple[list[int], list[int], list[int]]:
    """Pack lengths that descend. Returns each one's bin and offset, and the capacity of each bin.

    cost: of a bin, by permitted capacity. With least, bins are opened at the smallest size that is
    no less and holds the piece.
    """
    top = max(cost)
    by_room: list[list[int]] = [[] for _ in range(top + 1)]
    rooms = 0  # bit r: a bin with r places left
    counts, to_come = [0] * (top + 1), 0
    for n in lengths:
        counts[n] += 1
        to_come |= 1 << n
    filled: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        counts[n] -= 1
        if not counts[n]:
            to_come &= ~(1 << n)
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            if least:
                room = min(c for c in cost if c >= max(n, least))
            else:
                room = min((c for c in cost if c >= n), key=lambda c: (cost[c] / (n + fillable(c - n, counts, to_come)), c))
            b = len(filled)
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        left = room - n
        by_room[left].append(b)
        rooms |= 1 << left
    return bins, offsets, [min(c for c in cost if c >= f) for f in filled]


def cheapest(lengths: list[int], cost: dict[int, float]) -> tuple[list[int], list[int], list[int]]:
    """The packing of least cost: with sizes chosen bin by bin, or with one size for all."""
    made = [best_fit(lengths, cost, least) for least in (0, *cost)]
    return min(made, key=lambda p: sum(cost[c] for c in p[2]))


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", sequence_cost: float = SEQUENCE_COST, square_cost: float = SQUARE_COST, bucket_pieces: int = 50_000, least_buckets: int = 12) -> DataFrame:
    """Per piece: id, piece, start and n_tokens in the document, bin_id, bin_offset, bin_capacity."""
    top, cost = max(capacities), costs(capacities, sequence_cost, square_cost)
    n = (word_length(F.col(text_col)) if length is None else F.greatest(F.coalesce(length, F.lit(1)), F.lit(1))).cast("long")
    # each row once: a bucket's rows must be the same however often a task runs
    sized = materialize(docs.select(F.col(id_col).alias("id"), n.alias("n")))
    n_pieces = sized.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    n_buckets = max(least_buckets, math.ceil(n_pieces / bucket_pieces))
    cut = sized.select("id", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / top).cast("int") - 1)).alias("piece"))
    start = F.col("piece").cast("long") * top
    pieces = cut.select("id", "piece", start.alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - start).cast("int").alias("n_tokens"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "n_tokens"), F.lit(n_buckets)).cast("int"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, offsets, sizes = cheapest(pdf["n_tokens"].tolist(), cost)
        pdf["bin_id"] = [(int(pdf["bucket"].iloc[0]) << 32) + b for b in bins]
        pdf["bin_offset"] = offsets
        pdf["bin_capacity"] = [sizes[b] for b in bins]
        return pdf[["id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_capacity"]]

    packed = pieces.groupBy("bucket").applyInPandas(fill, f"id {id_type}, piece int, start long, n_tokens int, bin_id long, bin_offset int, bin_capacity int")
    return packed.withColumnRenamed("id", id_col)

"""MinHash near-duplicates with sequential Bayesian verification.

Texts are lower-cased (A-Z) and cut at ASCII white space; a document's set holds its distinct
shingles of `k` words. Documents of equal sets are one class, a node of the links, whatever their
ids. Minima of many hashes are taken of each set. Bands of ROWS minima give bucket keys; one bit of each
further minimum is kept for verification, LANE bits in a batch.

Two classes of a bucket are candidates. Batches of signature bits are compared one after another,
and a pair is dropped as soon as the posterior probability that its similarity reaches the threshold
falls below `miss` (uniform prior on the share of equal bits). Survivors are compared on full sets.

Not all pairs of a bucket are compared. First every bucket names HUBS hubs, every member picks of the
hubs of its buckets the TRIES with most equal bits, and these pairs are verified; the links found
make components.
Then pairs are compared in full only in buckets that still hold several components, across
components, and only in the first bucket that a pair shares. A bucket of many members meets its hubs
in parts of SPREAD members, and itself in pairs of blocks of BLOCK members, so no task holds it. So
no link that changes a component is skipped, apart from the chance that no band agrees (6.8e-4 at
similarity 0.8, 1.2e-5 at 0.85) and `miss`.

Steps that are read twice are written down. So none is computed twice, and no plan is long: the driver plans
a query anew after each of its stages, and a long one takes most of its memory.

Defined cases: null and empty texts, and texts of white space, have the empty set and are linked
with nothing; a text of fewer than k words has its whole sequence as one shingle; repeated rows are
answered one by one; each row of an id that repeats with other texts has the component of its own
text; a component is named by the smallest id of its rows, and null if none has an id; other columns
are not read; very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import components, forget, materialize

BANDS, ROWS = 24, 6
LANE, LANES = 64, 24
BATCHES = (1, 4, 12, 24)  # lanes that have been compared after each batch
HUBS = 8  # of a bucket
TRIES = 8  # hubs that a class is verified against, those with most equal bits
SPREAD, BLOCK = 2000, 1000  # members of a bucket that meet its hub, or each other, in one task

_rng = np.random.default_rng(20260101)
_HASHES = [[_rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(odd) for odd in (1, 0)] for n in (BANDS * ROWS, LANE * LANES)]
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


class Words:
    """Hashes of words, each computed once while the table of known words is small."""

    def __init__(self, most: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, text: bytes) -> np.ndarray:
        known = self.known
        out = text.lower().split()
        new = set(out).difference(known)
        if new:
            if len(known) > self.most:
                known.clear()
                new = set(out)
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, out), np.uint64, len(out))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = _mixed(h + words[j : n - k + 1 + j])
    return np.unique(h)


def minima(s: np.ndarray, which: int) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    a, b = _HASHES[which]
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        h = np.multiply.outer(x[i : i + 256], a)
        h += b
        np.minimum(low, h.min(axis=0), out=low)
    return low


def band_keys(s: np.ndarray) -> np.ndarray:
    rows = minima(s, 0).reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = _mixed(key + rows[:, j])
    return key.view(np.int64)


def signature(s: np.ndarray) -> np.ndarray:
    bits = ((minima(s, 1) * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def most_unequal(threshold: float, miss: float) -> list[int]:
    """After each batch, the largest number of unequal bits at which a pair may still be linked."""
    least = (1 + threshold) / 2  # share of equal bits at the threshold

    def posterior(n: int) -> list[float]:
        """For each number of equal bits, P(share >= least) under Beta(equal + 1, n - equal + 1): a binomial tail."""
        log = [math.lgamma(n + 2) - math.lgamma(i + 1) - math.lgamma(n + 2 - i) + i * math.log(least) + (n + 1 - i) * math.log1p(-least) for i in range(n + 1)]
        return list(accumulate(map(math.exp, log)))

    out = []
    for n in (LANE * b for b in BATCHES):
        p = posterior(n)
        out.append(max(d for d in range(n + 1) if p[n - d] >= miss))
    return out


def _banded(batches, k: int):
    words = Words()
    for b in batches:
        sets = [shingles(words(t), k) if t else () for t in b.column("text").to_pylist()]
        cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        bands = [band_keys(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_pydict({"id": b.column("id"), "h": b.column("h"), "n": pa.array(map(len, sets), pa.int32()), "cls": pa.array(cls, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})


def _sets(batches, k: int):
    """Sets of the texts of wanted classes; other texts of the same id are passed over."""
    words = Words()
    for b in batches:
        sets = [shingles(words(t), k) for t in b.column("text").to_pylist()]
        ok = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() == c for s, c in zip(sets, b.column("cls").to_pylist(), strict=True)], pa.bool_())
        sets = [s for s, o in zip(sets, ok.to_pylist(), strict=True) if o]
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_pydict({"node": b.column("node").filter(ok), "n": pa.array(map(len, sets), pa.int32()), "bits": pa.array(map(signature, sets), longs), "shingles": pa.array([s.view(np.int64) for s in sets], longs)})


def _linked(pairs: DataFrame, sets: DataFrame, partners: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, salt), those that reach the threshold on full sets, written down.

    partners(b, salt) says how often a b stands in the join, so that one with very many pairs is spread.
    """
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")).join(partners, "b")
    both = pairs.join(x, "a").join(y, ["b", "salt"])
    common = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("c"), (F.size("sa") + F.size("sb")).alias("t"))
    return materialize(common.where(100 * F.col("c") >= percent * (F.col("t") - F.col("c"))).select("a", "b"))


def _possible(percent: int, most: list[int]):
    """Whether lengths allow the threshold and no batch of bits has ruled the pair out; and unequal bits."""
    ok = 100 * F.least("n", "b_n") >= percent * F.greatest("n", "b_n")
    lane = lambda j: F.bit_count(F.get("bits", j).bitwiseXOR(F.get("b_bits", j)))
    unequal, done = F.lit(0), 0
    for upto, limit in zip(BATCHES, most, strict=True):
        for j in range(done, upto):
            unequal = unequal + lane(j)
        done = upto
        ok = ok & (unequal <= limit)
    return ok, unequal


def _shares(members, of: int) -> Column:
    """Into how many parts a bucket of so many members is split."""
    return F.ceil(members / of).cast("int")


def _classified(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, miss: float) -> DataFrame:
    """Per row: id, h (hash of the text), n, cls, component_id, and first: the row's class names its component."""
    id_type = docs.schema[id_col].dataType.simpleString()
    most = most_unequal(percent / 100, miss)
    text = F.col(text_col).cast("binary")
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = materialize(src.mapInArrow(lambda it: _banded(it, k), f"id {id_type}, h bigint, n int, cls binary, bands array<bigint>"))
    classes = rows.where("n > 0").groupBy("cls", "n", "bands").agg(F.min("id").alias("id"), F.min("h").alias("h"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))  # written, hence numbered once

    buckets = classes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = materialize(buckets.join(shared, "key"))
    # a class's text is found again by its id, or by the text's hash if no row of the class has an id
    at = lambda df: df.withColumn("at", F.when(F.col("id").isNull(), F.col("h")))
    wanted = at(classes.select("node", "cls", "id", "h").join(members.select("node").distinct(), "node"))
    wanted = wanted.select("node", "cls", F.col("id").alias("of"), F.col("at").alias("of_at"))
    texts = at(src).join(wanted, F.col("id").eqNullSafe(F.col("of")) & F.col("at").eqNullSafe(F.col("of_at"))).select("node", "cls", "text")
    sets = texts.mapInArrow(lambda it: _sets(it, k), "node bigint, n int, bits array<bigint>, shingles array<bigint>")
    sets = materialize(sets.dropDuplicates(["node"]))
    info = sets.select("node", "n", "bits")

    # hubs: every bucket names some, and its members are compared with them
    named_hubs = [F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(HUBS)]
    hubs = materialize(members.groupBy("key", "m").agg(F.explode(F.array_distinct(F.array(*named_hubs))).alias("hub")))
    partners = hubs.groupBy("hub").agg(F.max(_shares(F.col("m"), SPREAD)).alias("salts"))
    hub_info = info.join(partners, F.col("node") == F.col("hub")).select("hub", "salts", F.col("n").alias("b_n"), F.col("bits").alias("b_bits"))
    salted = hubs.join(hub_info, "hub").select("key", "hub", "salts", "b_n", "b_bits", F.explode(F.sequence(F.lit(0), _shares(F.col("m"), SPREAD) - 1)).alias("salt"))
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    known = members.join(info, "node").withColumn("salt", spread(_shares(F.col("m"), SPREAD)))
    ok, unequal = _possible(percent, most)
    pairs = known.join(salted, ["key", "salt"]).where((F.col("node") != F.col("hub")) & ok)
    best = F.slice(F.array_sort(F.collect_set(F.struct(unequal.alias("unequal"), "hub", "salts"))), 1, TRIES)
    pairs = pairs.groupBy("node").agg(best.alias("best")).select("node", F.explode("best").alias("p"))
    pairs = materialize(pairs.select(F.col("node").alias("a"), F.col("p.hub").alias("b"), spread(F.col("p.salts")).alias("salt")))
    spots = partners.select(F.col("hub").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    label = components(_linked(pairs, sets, spots, percent))
    forget(pairs)

    # what is left: pairs of a bucket that stand in different components, block by block
    named = materialize(info.join(label, "node", "left").select("node", "n", "bits", F.coalesce("component", "node").alias("component")))
    known = members.join(named.join(classes.select("node", "bands"), "node"), "node")
    mixed = members.join(named.select("node", "component"), "node").groupBy("key", "m").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    mixed = mixed.select("key", F.explode(F.sequence(F.lit(0), _shares(F.col("m"), SPREAD) - 1)).alias("salt"))
    open_ = known.withColumn("salt", spread(_shares(F.col("m"), SPREAD))).join(mixed, ["key", "salt"]).drop("salt")
    open_ = materialize(open_.withColumn("blocks", _shares(F.col("m"), BLOCK)).withColumn("block", spread(F.col("blocks"))))
    left = open_.select("key", "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"), "node", "n", "bits", "bands", "component")
    right = open_.select("key", F.col("block").alias("other"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("block"), F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"), F.col("bands").alias("b_bands"), F.col("component").alias("b_component"))
    first = F.expr("try_element_at(bands, cast(array_position(zip_with(bands, b_bands, (x, y) -> x = y), true) as int))") == F.col("key")
    once = (F.col("block") < F.col("other")) | (F.col("node") < F.col("b"))
    rest = left.join(right, ["key", "block", "other"]).where(once & (F.col("component") != F.col("b_component")) & ok & first)
    rest = materialize(rest.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"), F.lit(0).alias("salt")))
    more = _linked(rest, sets, rest.select("b", "salt").distinct(), percent)
    forget(rest)
    one, two = (named.select(F.col("node").alias(e), F.col("component").alias(f"c{e}")) for e in "ab")
    merged = components(more.join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    label = named.select("node", "component").join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))

    of = materialize(classes.select("cls", "node", "id").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")))
    names = of.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best"))
    of = materialize(of.join(names, "component").select("cls", F.col("best.id").alias("component_id"), (F.col("node") == F.col("best.node")).alias("first")))
    out = rows.select("id", "h", "n", "cls").join(of, "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "h", "n", "cls", component.alias("component_id"), "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """Per row: id, n_shingles, component_id and kept (id = component_id).

    Links have 100 * intersection >= percent * union. The bands are made for thresholds of 80 and
    more.
    """
    found = _classified(docs, id_col, text_col, k, percent, miss)
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def near_dup_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return near_duplicates(docs, k=3, percent=85)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """docs with one document of each component, all columns unchanged.

    The row that stays has the component's smallest id and a text of the class that the id names; of
    repeated rows one stays. Texts without words all stay, but repeated rows of them, too. Rows with a
    null id all stay, as no id tells them apart.
    """
    found = _classified(docs, id_col, text_col, k, percent, miss).where("id is not null")
    one = found.where("first and id = component_id").groupBy("id", "cls").agg(F.min("h").alias("h")).select("id", "h")
    stay = one.unionAll(found.where("n = 0").select("id", "h")).distinct().select(F.col("id").alias("__cq_id"), F.col("h").alias("__cq_h"))
    rows = docs.withColumn("__cq_at", F.xxhash64(F.col(text_col).cast("binary")))
    kept = rows.join(stay, (F.col(id_col) == F.col("__cq_id")) & (F.col("__cq_at") == F.col("__cq_h")), "left_semi").dropDuplicates([id_col, "__cq_at"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))

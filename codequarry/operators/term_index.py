"""A stored index of the knowledge tables by trigrams, so that searches and lookups read candidates only.

`postings` has a row (gram, kind, rec) for each distinct trigram of a record's texts, lower-cased and
ended by two marks, so that a trigram begins at every character. A text that contains a term contains
all of the term's trigrams; a term of one or two characters is the beginning of a trigram. rec is a hash
of the texts: records of equal texts share one, so a package that very many repositories use has one
record's postings. Postings are bucketed by kind and the gram's hash and sorted within files; the records' own
tables are bucketed by rec and sorted by it. Tables can be indexed one by one, when they are first searched.

A lookup takes the rarest trigrams of its term, intersects their postings, and reads these records
from their buckets; the operators then work on those rows as on the whole tables and decide
exactly, so their results are the same. If a term's rarest trigram stands in more than `most` recs, or
the term is empty, the table is read as it is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.model import SCHEMAS
from codequarry.operators import knowledge, search
from codequarry.operators.knowledge import Knowledge
from codequarry.sources.versions import PART, Change, State, Store

GRAM, END = 3, "\x00\x00"
CHUNK = 512  # characters that trigrams are taken of at a time, so that long texts take linear time
RAREST = 3  # trigrams of a term whose postings are read
REC = "_rec"
SEARCHED = ("schemas", "apis", "services", "dependencies", "semantic_layers")


def searched_texts(kind: str) -> Column:
    """The texts of a record that searches and lookups look into, lower-cased."""
    names = lambda c, part: F.transform(F.coalesce(c, F.array().cast(_kind_of(kind, c))), lambda x: F.lower(text(x[part])))
    plain = {
        "schemas": ("name", "description"), "apis": ("path", "method", "handler", "description"), "services": ("name", "description"),
        "dependencies": ("name", "ecosystem"), "data_flows": ("source", "target"), "contexts": ("repo_name",), "semantic_layers": ("repo_name",),
    }[kind]
    texts = F.array(*[F.lower(text(c)) for c in plain])  # no lambda where there are no nested texts: Spark compiles none
    if kind == "schemas":
        texts = F.concat(texts, names("fields", "name"), names("fields", "type"), names("fields", "description"))
    elif kind == "services":
        texts = F.concat(texts, names("methods", "name"))
    elif kind == "semantic_layers":
        texts = F.concat(texts, names("query_recipes", "question"), names("query_recipes", "answer_format"))
    return texts


def _kind_of(kind: str, column: str) -> str:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(SCHEMAS[kind])[column].dataType.simpleString()


def grams_of(texts: Column) -> Column:
    """Distinct trigrams of an array of texts, case ignored."""

    def of_text(t: Column) -> Column:
        ended = F.concat(F.lower(t), F.lit(END))
        starts = F.sequence(F.lit(1), F.greatest(F.length(ended) - (GRAM - 1), F.lit(1)), F.lit(CHUNK))
        chunks = F.transform(starts, lambda i: F.substring(ended, i, CHUNK + GRAM - 1))
        within = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (GRAM - 1), F.lit(1))), lambda i: F.substring(c, i, GRAM))
        return F.array_distinct(F.flatten(F.transform(chunks, within)))

    return F.array_distinct(F.flatten(F.transform(F.filter(texts, lambda t: t != ""), of_text)))


def term_grams(term: str) -> list[str]:
    low = term.lower()
    return list(dict.fromkeys(low[k : k + GRAM] for k in range(len(low) - GRAM + 1))) or [low]


@dataclass
class Looked:
    """What a lookup has read: the records, and of how many buckets of how many."""

    rows: DataFrame
    buckets: int
    of: int


class TermIndex:
    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.store = spark, Store(spark, folder)
        self.state = self.store.state(version)

    @classmethod
    def build(cls, kb: Knowledge, folder: str, parts: int = 64, gram_parts: int = 16, most: int = 100_000, kinds: tuple[str, ...] = tuple(SCHEMAS)) -> TermIndex:
        """Store the tables of kinds and their postings as one version. most: recs of a term beyond which a table is read whole."""
        spark = kb.schemas.sparkSession
        _store(Store(spark, folder), kb, kinds, {"parts": parts, "gram_parts": gram_parts, "most": most, "kinds": list(kinds)}, None)
        return cls(spark, folder)

    def having(self, kb: Knowledge, *kinds: str) -> TermIndex:
        """This index with the tables of these kinds: those that it lacks are stored, nothing else is written or read."""
        lacking = tuple(k for k in kinds if k not in self.state.meta["kinds"])
        if not lacking:
            return self
        _store(self.store, kb, lacking, self.state.meta | {"kinds": [*self.state.meta["kinds"], *lacking]}, self.state)
        return TermIndex(self.spark, self.store.folder)

    def table(self, kind: str) -> DataFrame:
        """A whole table."""
        return self.store.read(kind, self.state).select(*_columns(kind))

    def _at(self, name: str, kinds: list[str], grams: list[str]) -> DataFrame:
        """Rows of postings or grams with one of these trigrams, from the buckets of their hashes."""
        n = self.state.meta["gram_parts"]
        hashes = {xxhash.xxh64_intdigest(g.encode(), 42) for g in grams}
        parts = {_first(k, n) + (h - (1 << 64 if h >> 63 else 0)) % n for h in hashes for k in kinds}
        return self.store.read(name, self.state, parts).where(F.col("kind").isin(kinds) & F.col("gram").isin(grams))

    def _from(self, name: str, kinds: list[str], start: str) -> DataFrame:
        """Rows of postings or grams with a trigram that begins so, from all buckets of these kinds."""
        parts = _gram_parts(kinds, self.state.meta["gram_parts"])
        return self.store.read(name, self.state, parts).where(F.col("kind").isin(kinds) & F.col("gram").startswith(start))

    def candidates(self, terms: list[str], kinds: list[str]) -> tuple[DataFrame | None, set[str]]:
        """((kind, rec, bucket) of records that may contain any of the terms, the kinds that a scan is no dearer for)."""
        if "" in terms:
            return None, set(kinds)
        most = self.state.meta["most"]
        grams = {t: term_grams(t) for t in terms}
        long = [t for t in terms if len(t.lower()) >= GRAM]
        short = [t for t in terms if t not in long]
        every = sorted({g for t in long for g in grams[t]})
        sums = [self._at("grams", kinds, every).select("kind", "gram", "n")] if every else []
        sums += [self._from("grams", kinds, t.lower()).select("kind", F.lit(t.lower()).alias("gram"), "n") for t in short]
        if not sums:
            return None, set()
        n = {(r.kind, r.gram): r.n for r in reduce(DataFrame.union, sums).groupBy("kind", "gram").agg(F.sum("n").alias("n")).collect()}
        rarest = {(k, t): sorted(grams[t], key=lambda g: n.get((k, g), 0))[:RAREST] for k in kinds for t in terms}
        scanned = {k for k in kinds for t in terms if n.get((k, rarest[k, t][0]), 0) > most}
        kinds = [k for k in kinds if k not in scanned]
        sought = {(k, t): rarest[k, t] for k in kinds for t in long if n.get((k, rarest[k, t][0]), 0)}
        found = []
        if sought:
            read = self._at("postings", kinds, sorted({g for rare in sought.values() for g in rare}))
            each = read.groupBy("kind", REC, "bucket").agg(F.collect_set("gram").alias("have"))  # of RAREST for each term at most
            holds = [(F.col("kind") == k) & reduce(Column.__and__, [F.array_contains("have", g) for g in rare]) for (k, _), rare in sought.items()]
            found.append(each.where(reduce(Column.__or__, holds)).select("kind", REC, "bucket"))
        found += [self._from("postings", kinds, t.lower()).select("kind", REC, "bucket") for t in short if kinds]
        return (reduce(DataFrame.union, found).distinct() if found else None), scanned

    def look_up(self, terms: list[str], *kinds: str) -> dict[str, Looked]:
        """The records of each table that may contain any of the terms."""
        if lacking := set(kinds) - set(self.state.meta["kinds"]):
            raise LookupError(f"not indexed: {', '.join(sorted(lacking))}")
        found, scanned = self.candidates(list(dict.fromkeys(terms)), list(kinds))
        buckets: dict[str, set[int]] = {k: set() for k in kinds}
        if found is not None:
            for r in found.select("kind", "bucket").distinct().collect():  # numbers of buckets
                buckets[r.kind].add(r.bucket)
        out = {}
        for k in kinds:
            of = len(self.state.tables[k]["parts"])
            if k in scanned:
                out[k] = Looked(self.table(k), of, of)
            elif not buckets[k]:
                out[k] = Looked(self.spark.createDataFrame([], SCHEMAS[k]), 0, of)
            else:
                rows = self.store.read(k, self.state, buckets[k]).join(found.where(F.col("kind") == k).select(REC), REC, "left_semi")
                out[k] = Looked(rows.select(*_columns(k)), len(buckets[k]), of)
        return out

    # the operators over candidates ----------------------------------------------------------

    def search(self, query: str, limit: int = 20, kind: str = "", repo: str = "") -> DataFrame:
        """As search.search over the whole tables."""
        return search.search(self._matching(query), query, limit, kind, repo)

    def hits(self, query: str) -> DataFrame:
        """As search.hits over the whole tables."""
        return search.hits(self._matching(query), query)

    def _matching(self, query: str) -> Knowledge:
        found = self.look_up(query.split() or [""], *SEARCHED)  # a text with no term of the query scores nothing
        return Knowledge.of(self.spark, **{k: x.rows for k, x in found.items()})

    def _rows(self, kind: str, term: str) -> DataFrame:
        return self.look_up([term], kind)[kind].rows

    def find_contains(self, kind: str, column: str, value: str) -> DataFrame:
        return knowledge.find_contains(self._rows(kind, value), column, value)

    def find_exact(self, kind: str, column: str, value: str) -> DataFrame:
        return knowledge.find_exact(self._rows(kind, value), column, value)

    def find_api(self, path: str = "", method: str = "") -> DataFrame:
        return knowledge.find_api(self._rows("apis", path or method), path, method)

    def find_bidirectional(self, kind: str, column: str, value: str) -> DataFrame:
        """Names that contain value come by its trigrams; those within it by their equality with one of its substrings."""
        around = knowledge.find_contains(self._rows(kind, value), column, value).where(F.contains(text(column), F.lit(value)))
        inside = sorted({value[i:j] for i in range(len(value)) for j in range(i + 1, len(value) + 1)} - {value})
        within = self.table(kind).where(text(column).isin([*inside, ""]) & ~F.contains(text(column), F.lit(value)))
        return around.unionByName(within)

    def list_recipes(self, q: str = "", repo: str = "", limit: int = 50) -> DataFrame:
        return knowledge.list_recipes(self._rows("semantic_layers", q or repo), q, repo, limit)

    def dependency_usage(self, name: str) -> DataFrame:
        return knowledge.dependency_usage(self._rows("dependencies", name), name)


def _first(kind: str, n: int) -> int:
    """The first of the n buckets of a kind's postings."""
    return n * list(SCHEMAS).index(kind)


def _gram_parts(kinds: list[str] | tuple[str, ...], n: int) -> list[int]:
    return [_first(k, n) + i for k in kinds for i in range(n)]


def _store(store: Store, kb: Knowledge, kinds: tuple[str, ...], meta: dict, base: State | None) -> None:
    """Tables, then their postings, then the numbers of recs, which are counted from the stored postings; on top of base, or in place of all."""
    parts, n = meta["parts"], meta["gram_parts"]
    replaced = None if base is None else _gram_parts(kinds, n)
    tables = {}
    for name in kinds:
        numbered = kb.named()[name].withColumn(REC, F.xxhash64(searched_texts(name)))
        tables[name] = Change(numbered.withColumn(PART, F.pmod(F.col(REC), F.lit(parts)).cast("int")), sort=(REC,))

    def postings(state: State) -> tuple[dict[str, Change], dict]:
        every = []
        for name in kinds:
            one = store.read(name, state).select(REC, F.col(PART).alias("bucket"), searched_texts(name).alias("texts")).distinct()  # copies lie side by side in a bucket
            grams = one.select(F.lit(name).alias("kind"), REC, "bucket", F.explode(grams_of(F.col("texts"))).alias("gram"))
            every.append(grams.withColumn(PART, F.lit(_first(name, n)) + F.pmod(F.xxhash64("gram"), F.lit(n)).cast("int")))
        return {"postings": Change(reduce(DataFrame.unionByName, every), replaced, sort=("gram", "kind"))}, {}

    def numbers(state: State) -> tuple[dict[str, Change], dict]:
        frequent = store.read("postings", state, replaced).groupBy("kind", "gram", PART).agg(F.count("*").alias("n"))
        return {"grams": Change(frequent.select("kind", "gram", "n", PART), replaced, sort=("gram", "kind"))}, {}

    store.commit(tables, base, meta=meta, then=(postings, numbers))


def _columns(kind: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(SCHEMAS[kind]).names

"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Each kind of secret is a regex; its matches are placed by the lengths of the texts between them.
The hashes of all candidate values are then counted over the whole corpus by distinct repositories
and owners. A value that many of them hold is a copied example; a value of few owners that doesn't
look like a placeholder counts as a live credential.

Counting first combines per (hash, repository, owner) and then per hash, so that a value which a
third of the rows hold is summed before it is shuffled. The counts are joined to the candidates
by hash, which Spark's skew join can split.

Defined cases: null counts as empty; empty texts hold no secrets; a null repository or owner is
not counted as one; repeated rows are answered one by one; other columns are not read; a private
key's header with no key behind it is no secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import materialize

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A private key: header and, as the value, all up to the END line; or, where no END line follows, the
# header fields and up to 420 lines of base64 that follow, more than a private key has (in sevenths,
# since RE2 bounds repetitions). Line breaks may be written as \n, whose n then counts with the line.
_PEM_CUT = r"(?:[ \t\r\n\\]*n?(?:Proc-Type|DEK-Info):[^\r\n\\]*){0,4}" + r"(?:[ \t\r\n\\]*[A-Za-z0-9+/=]{16,}){0,60}" * 7 + r"(?:[ \t\r\n\\]*[A-Za-z0-9+/=]{1,15}[ \t\r\n\\]*\z)?"
_PEM = rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----([^-]*(?:-{{1,4}}[^-]+){{0,40}}-----END [A-Z ]{{0,40}}PRIVATE KEY-----|{_PEM_CUT})"
#: Kind, regex, group of the value, least length of the value, texts of which one must be there ("" means: look with the regex).
KINDS = [
    ("assign", _ASSIGN, 2, 6, ""),
    ("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    ("hex", "[0-9a-f]{24,}", 0, 24, ""),
    ("github", "gh[opusr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    ("google", "AIza[0-9A-Za-z_-]{35}", 0, 39, "AIza"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, "eyJ"),
    ("pem", _PEM, 1, 1, "PRIVATE KEY-----"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox"),
    ("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 1, "k_"),
    ("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,80}:[^\s:/@]{1,80}@", 0, 1, "://"),
]
N_BASE = 3
#: Parts of values that are placeholders.
PLACEHOLDERS = ["example", "changeme", "placeholder", "your_", "yourpassword", "xxxxxx", "dummy", "sample", "123456"]
_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,hash:string,looks_live:boolean>>"


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _looks_live(value: Column) -> Column:
    low = F.lower(value)
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 6
    named = F.lit(False)
    for word in PLACEHOLDERS:
        named = named | F.contains(low, F.lit(word))
    return varied & ~named


def _spans(text: Column, rank: int) -> Column:
    kind, regex, group, least, gate = KINDS[rank]
    found = F.struct(
        F.split(text, regex, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("values"),
    )

    def placed(x):
        steps = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), F.arrays_zip(x["hits"], x["values"]), lambda g, h: F.struct(F.char_length(g).alias("gap"), F.char_length(h["hits"]).alias("len"), h["values"].alias("value")))

        def step(acc, s):
            a = acc["at"] + s["gap"]
            b = a + s["len"]
            span = F.struct(a.alias("start"), F.lit(rank).alias("rank"), b.alias("stop"), F.lit(kind).alias("kind"), F.sha2(s["value"], 256).alias("hash"), _looks_live(s["value"]).alias("looks_live"))
            out = F.when(F.char_length(s["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            return F.struct(b.alias("at"), out.alias("out"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])

    present = F.contains(text, F.lit(gate)) if gate else text.rlike(regex)
    return F.when(present, _let(found, placed)).otherwise(F.array().cast(_SPAN))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | str = "source", owner: Column | str = "source") -> DataFrame:
    """Per row: row (a number), id, text_hash, repo, owner, and spans in order of start and kind."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [_spans(F.col("text"), k) for k in range(len(KINDS))]
    out = docs.select(F.col(id_col).alias("id"), text.alias("text"), as_col(repo).alias("repo"), as_col(owner).alias("owner"))
    return out.select("id", F.xxhash64("text").alias("text_hash"), "repo", "owner", F.array_sort(F.concat(*kinds)).alias("spans"), F.monotonically_increasing_id().alias("row"))


def ownership(found: DataFrame, most_owners: int = 2, most_repos: int = 4) -> DataFrame:
    """Per candidate hash: n_repos, n_owners, and copied: held by more owners or repositories than stated."""
    each = found.select("repo", "owner", F.explode("spans.hash").alias("hash"))
    once = each.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    seen = once.groupBy("hash").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))
    return seen.withColumn("copied", (F.col("n_owners") > most_owners) | (F.col("n_repos") > most_repos))


def judged(found: DataFrame, most_owners: int = 2, most_repos: int = 4) -> DataFrame:
    """Per row of found that has spans: row, and judged: the spans with copied and live."""
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    known = each.join(ownership(found, most_owners, most_repos).select("hash", "copied"), "hash")
    live = F.col("looks_live") & ~F.col("copied")
    spans = known.select("row", F.struct("start", "rank", "stop", "kind", "copied", live.alias("live")).alias("s"))
    return spans.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("judged"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op6. A source is an owner, its part in one language a repository."""
    found = materialize(find_secrets(docs, repo=F.concat_ws("/", "source", "lang")))
    kinds = found.join(judged(found), "row", "left")
    base = F.filter("spans", lambda s: s["rank"] < N_BASE)
    text = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))
    n = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    of = lambda f: F.coalesce(F.size(F.filter("judged", f)), F.lit(0)).cast("long")
    return kinds.select(
        F.col("id").alias("doc_id"),
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        of(lambda s: s["copied"]).alias("n_copied"),
        of(lambda s: s["live"]).alias("n_live"),
    )


def redact_live(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", repo: Column | str = "source", owner: Column | str = "source", most_owners: int = 2, most_repos: int = 4) -> DataFrame:
    """docs with every live span of the text replaced by mark; all columns and rows stay."""
    found = materialize(find_secrets(docs, id_col, text_col, repo, owner))
    live = judged(found, most_owners, most_repos).select("row", F.filter("judged", lambda s: s["live"]).alias("live")).where("size(live) > 0")
    marks = found.join(live, "row").select(F.col("id").alias("__cq_id"), F.col("text_hash").alias("__cq_hash"), F.col("live").alias("__cq_live")).dropDuplicates(["__cq_id", "__cq_hash"])
    joined = docs.join(marks, F.col(id_col).eqNullSafe(F.col("__cq_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__cq_hash")), "left")
    text = F.col(text_col)

    def step(acc, s):
        part = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], part).alias("out"))

    done = F.aggregate("__cq_live", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    new = F.when(F.col("__cq_live").isNotNull(), done).otherwise(text)
    return joined.withColumn(text_col, new).select(*docs.columns)

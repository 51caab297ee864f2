"""License scan by ordered signature rules, in DataFrame functions only.

Texts are lower-cased (A-Z) and reduced to words, runs of ASCII letters and digits and of
characters beyond ASCII, with one blank between. Rules are regexes over that form, in three tables:
SPDX tags, sentences of licence texts and notices, and licence names, which may stand in a frame
such as "released under the terms of". A rule runs on a text only if its keyword stands in it, and
no rule runs on a text without any of the gate words; each match of a rule holds its keyword and a
gate word, so neither loses a match. Only the further identifiers of an SPDX expression, which are
also plain words, are looked for by design in texts with an SPDX tag alone. A detection is suppressed if another one covers its interval
and is longer, or has the same interval and stands earlier in the rule order.

The base phrases are counted apart from the rules and always keep their labels.

Defined cases: null counts as empty; empty texts have no words, no labels and score 0; null for
first and last place where there is none; very long texts and very many matches are handled in time
that grows with them; repeated rows are answered one by one; other columns are not read. Nothing is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm import license_rules as R
from codequarry.llm.common import let, running

#: Base phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOUND = "struct<start:int,back:int,priority:int,label:string,weight:double>"


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, regex, weight): SPDX tags, texts, names, further SPDX identifiers."""
    out = [(label, "spdx licen", R.SPDX_TAG + x, R.TAG) for label, x in R.SPDX]
    out += [(label, keyword, x, R.TEXT) for label, keyword, x in R.TEXTS]
    out += [(label, keyword, R.FRAME + x, R.BARE) for label, keyword, x in R.NAMES]
    out += [(label, "spdx licen", R.SPDX_NEXT + x, R.NEXT) for label, x in R.SPDX if x not in R.ALSO_WORDS]
    return [(k, *rule) for k, rule in enumerate(out)]


def lowered(text: Column) -> Column:
    """A-Z as a-z. lower() changes letters beyond ASCII too, but only two of them into ASCII letters."""
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(odd, F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def normalized(text: Column) -> Column:
    """Words between single blanks, with a blank at either end; letters beyond ASCII in any case."""
    return F.regexp_replace(F.concat(F.lit(" "), lowered(F.coalesce(text, F.lit(""))), F.lit(" ")), _SEPARATORS, " ")


def _blanks(s: Column) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))


def _places(size: int):
    """Of a text cut at a phrase of so many words: number of places, first and last start."""
    last = lambda p: F.col("n_words") - (_blanks(F.element_at(p, -1)) - 1) - size
    return lambda p: F.struct((F.size(p) - 1).alias("n"), (_blanks(F.element_at(p, 1)) - 1).alias("first"), last(p).alias("last"))


def _weight(hit: Column, least: Column) -> Column:
    stated = hit.rlike("^(?:licen[cs]ed|released|distributed|published|available|provided|redistributable) under ")
    return F.greatest(least, F.when(stated, F.lit(R.STATED)).when(F.startswith(hit, F.lit("under ")), F.lit(R.FRAMED)).otherwise(F.lit(0.0)))


def _detections(norm: Column) -> Column:
    """All matches of all rules whose keyword stands in a text, with their character intervals."""
    by_keyword: dict[str, list[Column]] = {}
    for p, _, keyword, regex, _ in rules():
        words = F.lit(f"(?<= ){regex}(?= )")
        found = F.struct(F.lit(p).alias("priority"), F.split(norm, words, -1).alias("gaps"), F.regexp_extract_all(norm, words, F.lit(0)).alias("hits"))
        by_keyword.setdefault(keyword, []).append(found)
    # a keyword is looked for once, however many rules it has
    tried = [F.when(F.contains(norm, F.lit(k)), F.array(*found)) for k, found in by_keyword.items()]
    matched = F.filter(F.flatten(F.array_compact(F.array(*tried))), lambda r: F.size(r["hits"]) > 0)
    known = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(w).alias("weight")) for _, label, _, _, w in rules()])

    def placed(r):
        """Gaps between matches add up to their places."""
        steps = F.arrays_zip(F.slice(r["gaps"], F.lit(1), F.size(r["hits"])).alias("gap"), r["hits"].alias("hit"))

        def step(at, s):
            start = at + F.char_length(s["gap"])
            stop = start + F.char_length(s["hit"])
            rule = F.element_at(known, r["priority"] + 1)
            d = F.struct(start.alias("start"), (-stop).alias("back"), r["priority"].alias("priority"), rule["label"].alias("label"), _weight(s["hit"], rule["weight"]).alias("weight"))
            return stop, F.array(d)

        return running(steps, F.lit(0), f"array<{_FOUND}>", step)

    return F.flatten(F.transform(matched, placed))


def _survivors(found: Column) -> Column:
    """A sweep from left to right, the longest first where several start: what ends no further than one before is covered."""
    ordered = F.array_sort(found)
    return let(ordered, lambda ds: running(ds, F.lit(-1), f"array<{_FOUND}>", lambda end, d: (F.greatest(end, -d["back"]), F.when(-d["back"] > end, F.array(d)).otherwise(F.array().cast(f"array<{_FOUND}>")))))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, places (phrase count, first, last start), and surviving detections."""
    out = docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("norm"))
    out = out.withColumn("n_words", _blanks(F.col("norm")) - 1)
    for k, (phrase, _) in enumerate(PHRASES):
        present = F.contains("norm", F.lit(f" {phrase} "))
        out = out.withColumn(f"p{k}", F.when(present, let(F.split("norm", f"(?<= ){phrase}(?= )", -1), _places(len(phrase.split())))))
    gated = F.lit(False)
    for word in R.GATE:
        gated = gated | F.contains("norm", F.lit(word))
    out = out.withColumn("detections", F.when(gated, _survivors(_detections(F.col("norm")))))
    ps = [F.col(f"p{k}") for k in range(len(PHRASES))]
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        sum((F.coalesce(p["n"], F.lit(0)) for p in ps[1:]), F.coalesce(ps[0]["n"], F.lit(0))).alias("n_base"),
        F.least(*[p["first"] for p in ps]).alias("first_word"),
        F.greatest(*[p["last"] for p in ps]).alias("last_word"),
        F.array_compact(F.array(*[F.when(p.isNotNull(), F.lit(label)) for p, (_, label) in zip(ps, PHRASES, strict=True)])).alias("base_labels"),
        F.coalesce(F.transform("detections", lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("stop"), d["priority"].alias("priority"), d["label"].alias("label"), d["weight"].alias("weight"))), F.array().cast("array<struct<start:int,stop:int,priority:int,label:string,weight:double>>")).alias("detections"),
    )


def license_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op8. score is the greatest weight among the surviving detections."""
    found = scan_licenses(docs)
    every = F.array_union("base_labels", F.transform("detections", lambda d: d["label"]))
    text = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(a)))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_base").cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        text(F.col("base_labels")).alias("base_labels"),
        text(every).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )

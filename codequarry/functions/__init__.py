"""Column functions that the operators are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def has(c: Column | str, part: str | Column) -> Column:
    """c contains part, case ignored; null counts as empty."""
    part = F.lit(part.lower()) if isinstance(part, str) else F.lower(part)
    return F.contains(F.lower(text(c)), part)


def same(c: Column | str, other: str) -> Column:
    return F.lower(text(c)) == other.lower()


def _one_text_score(low: Column, query: str) -> Column:
    """10 if equal, 5 if it contains the whole query, else 1 for each term that it contains."""
    terms = [F.contains(low, F.lit(t)).cast("double") for t in query.split()]
    each = reduce(lambda a, b: a + b, terms, F.lit(0.0))
    return F.when(low == query, 10.0).when(F.contains(low, F.lit(query)), 5.0).otherwise(each)


def match_score(query: str, *texts: Column | str) -> Column:
    """How well texts match a query; null texts count as empty."""
    return reduce(lambda a, b: a + b, [_one_text_score(F.lower(text(t)), query.lower()) for t in texts], F.lit(0.0))


def match_score_all(query: str, texts: Column) -> Column:
    """The same over an array of texts."""
    return F.aggregate(F.coalesce(texts, F.array()), F.lit(0.0), lambda s, t: s + _one_text_score(F.lower(text(t)), query.lower()))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def safe_filename(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(text(c), r"(?U)[^\p{Alnum}_-]", "_"))


def token_estimate(c: Column | str) -> Column:
    return F.floor(F.char_length(text(c)) / 4).cast("long")


def cache_key(*parts: Column | str, length: int = 16) -> Column:
    """The head of the SHA-256 of the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[text(p) for p in parts]), 256), 1, length)


def api_group(path: Column | str) -> Column:
    """What follows the first slash up to the next one; root if there is no slash."""
    p = text(path)
    return F.when(F.contains(p, F.lit("/")), F.split_part(p, F.lit("/"), F.lit(2))).otherwise("root")


def api_segment(path: Column | str) -> Column:
    """First segment that is neither a version, api, rest nor a parameter; else the first one; else root."""
    parts = F.filter(F.split(text(path), "/"), lambda s: s != "")
    meant = F.filter(parts, lambda s: ~s.rlike(r"(?i)^(v\d+|api|rest)$") & ~s.rlike(r"^[:{]"))
    return F.coalesce(F.try_element_at(meant, F.lit(1)), F.try_element_at(parts, F.lit(1)), F.lit("root"))


def highlight(c: Column | str, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    import re

    if not query:
        return text(c)
    quoted = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(text(c), f"(?i)({quoted})", f"{re.sub(r'([\\$])', r'\\\1', before)}$1{after}")

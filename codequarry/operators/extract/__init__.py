"""Extractors: table functions from files (path, content) to records.

Each takes a DataFrame of files and gives one row for each record, with source_file and pos, its
place among the records of its file. They are column expressions but for Python source and YAML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.model import RELATIONSHIPS


def found(text: Column, pattern: str, groups: int) -> Column:
    """All matches as structs: m, the whole, and g1.. the groups ("" if a group took no part)."""
    p = F.lit("(?U)" + pattern)
    one = lambda m: F.struct(m.alias("m"), *[F.regexp_extract(m, "(?U)" + pattern, k).alias(f"g{k}") for k in range(1, groups + 1)])
    return F.transform(F.regexp_extract_all(text, p, F.lit(0)), one)


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def some(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def field(name: Column, kind: Column, constraints: Column, **more: Column) -> Column:
    null = F.lit(None)
    get = lambda k, t: more.get(k, null).cast(t).alias(k)
    return F.struct(
        name.alias("name"), kind.alias("type"), constraints.cast("array<string>").alias("constraints"), get("description", "string"), get("annotations", "array<string>"),
        get("tags", "string"), get("json_name", "string"), get("optional", "boolean"), get("nullable", "boolean"), get("field_number", "int"),
    )


def relation(kind: Column, target: Column, via: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(kind.alias("type"), target.alias("target"), via.alias("field"), null.alias("via"), null.alias("description"))


def method(name: Column, raw: Column, returns: Column) -> Column:
    null = F.lit(None).cast("string")
    params = F.lit(None).cast("array<struct<name:string,type:string,in:string,required:boolean>>")
    return F.struct(name.alias("name"), params.alias("params"), raw.alias("params_raw"), returns.alias("returns"), null.alias("docstring"), null.alias("description"))


def lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def none(kind: str) -> Column:
    return F.array().cast(kind)


def no_relations() -> Column:
    return none(RELATIONSHIPS)


def rows(files: DataFrame, records: Column, **columns) -> DataFrame:
    """One row for each record of a file; columns are functions of the record."""
    each = files.select(F.col("path").alias("source_file"), "content", F.posexplode(records).alias("pos", "r"))
    return each.select("source_file", "pos", *[f(F.col("r")).alias(n) for n, f in columns.items()])


# matches and bodies by position -------------------------------------------------------------

CHUNK = 4096  # characters of a piece of a file; a cut joins only the pieces that it lies in
RUN = r"\G[^{}]*+[{}]"  # up to the next brace, from the last one on; a long end without braces is read once
FEW = 4  # hits of a file whose bodies are found one by one, each by a pass over the braces behind it


def running(items: Column, state: Column, made: str, step, part: int = 256) -> Column:
    """What step makes of an array's items in turn: step(state, item) gives the next state and one value of type `made`.

    Values are gathered part by part, so that very many items don't copy one growing array again and again.
    """

    def inner(acc: Column, x: Column) -> Column:
        new, out = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def outer(acc: Column, k: Column) -> Column:
        done = F.aggregate(F.slice(items, k * part + 1, F.lit(part)), F.struct(acc["state"].alias("state"), none(f"array<{made}>").alias("out")), inner)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    parts = F.when(F.size(items) > 0, F.sequence(F.lit(0), ((F.size(items) - 1) / part).cast("int"))).otherwise(none("array<int>"))
    return F.aggregate(parts, F.struct(state.alias("state"), none(f"array<array<{made}>>").alias("out")), outer, lambda acc: F.flatten(acc["out"]))


def places(text: Column, pattern: str) -> Column:
    """Each match of a pattern as struct<at, m>: its offset in characters, from 0, and its text."""
    parts = F.struct(F.split(text, "(?U)" + pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)).alias("hits"))

    def of(p: Column) -> Column:
        items = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["hits"])), p["hits"], lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("m")))
        step = lambda at, x: (at + x["gap"] + F.length(x["m"]), F.struct((at + x["gap"]).alias("at"), x["m"].alias("m")))
        return let(items, lambda i: running(i, F.lit(0), "struct<at:int,m:string>", step))

    return let(parts, of)


def braces(text: Column) -> Column:
    """All braces as struct<level, at, up>: the depth outside of the brace, its offset, and whether it opens."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda p: F.struct(F.length(p).alias("n"), F.endswith(p, F.lit("{")).alias("up")))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        depth = s["depth"] + F.when(x["up"], 1).otherwise(-1)
        at = s["at"] + x["n"]
        level = F.when(x["up"], s["depth"]).otherwise(depth)
        return F.struct(depth.alias("depth"), at.alias("at")), F.struct(level.alias("level"), (at - 1).alias("at"), x["up"].alias("up"))

    return let(runs, lambda r: running(r, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at")), "struct<level:int,at:int,up:boolean>", step))


def closed(text: Column, hits: Column) -> Column:
    """Hits (at, m) with end: the offset of the brace that closes the first one opened after the hit; -1 if none does.

    Sorted by level and offset, a brace that opens stands before the one that closes it. Hits and opening
    braces are then walked from the end of the file, so each hit meets the brace that follows it.
    """

    def ends(by_level: Column) -> Column:
        pairs = F.zip_with(by_level, F.slice(by_level, F.lit(2), F.size(by_level)), lambda a, b: F.struct(a["at"].alias("at"), a["up"].alias("up"), F.when((a["level"] == b["level"]) & ~b["up"], b["at"]).otherwise(F.lit(-1)).alias("end")))
        opening = F.filter(pairs, lambda x: F.coalesce(x["up"], F.lit(False)))
        event = lambda at, end, m: F.struct(at.alias("at"), end.alias("end"), m.alias("m"))
        every = F.concat(F.transform(opening, lambda x: event(x["at"], x["end"], F.lit(None).cast("string"))), F.transform(hits, lambda h: event(h["at"], F.lit(None).cast("int"), h["m"])))
        back = F.reverse(F.array_sort(every))
        step = lambda last, e: (F.coalesce(e["end"], last), F.struct(e["at"].alias("at"), e["m"].alias("m"), F.coalesce(e["end"], last).alias("end")))
        return let(back, lambda b: running(b, F.lit(-1), "struct<at:int,m:string,end:int>", step))

    return F.reverse(F.filter(let(F.array_sort(braces(text)), ends), lambda h: h["m"].isNotNull()))


def closed_each(text: Column, hits: Column) -> Column:
    """As closed, for a few hits: braces are counted from each hit on, without lists of their places and sorts."""

    def end(h: Column) -> Column:
        runs = F.regexp_extract_all(F.substring(text, h["at"] + 1, F.length(text)), F.lit(RUN), F.lit(0))
        start = F.struct(F.lit(0).alias("depth"), h["at"].alias("at"), F.lit(-1).alias("end"))

        def step(s: Column, p: Column) -> Column:
            up, at = F.endswith(p, F.lit("{")), s["at"] + F.length(p)
            depth = F.when(up, s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0)))
            last = (s["end"] < 0) & (s["depth"] == 1) & ~up
            return F.struct(depth.alias("depth"), at.alias("at"), F.when(last, at - 1).otherwise(s["end"]).alias("end"))

        return F.aggregate(runs, start, step, lambda s: s["end"])

    return F.transform(hits, lambda h: F.struct(h["at"].alias("at"), h["m"].alias("m"), end(h).alias("end")))


def chunks(text: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(CHUNK))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(CHUNK)))


def cut(pieces: Column, at: Column, n: Column) -> Column:
    """n characters of a text in chunks, from an offset on."""
    first = F.floor(at / CHUNK).cast("int")
    last = F.floor((at + F.greatest(n, F.lit(1)) - 1) / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), (at - first * CHUNK + 1).cast("int"), n)


def sections(text: Column, pattern: str, before: int = 0, ahead: int = 0, bodies: bool = True, rest: bool = False) -> Column:
    """Each match of a pattern as struct<m, body, before, ahead>, in the order of the file.

    m: the match; body: from the match to the brace that closes the first one opened behind it, "" if
    none does; before and ahead: so many characters before and behind the match; rest, if asked for: from the
    body's end to the next match.
    """

    def of(w: Column) -> Column:
        def one(h: Column) -> Column:
            body = F.when(h["end"] >= 0, cut(w["c"], h["at"], h["end"] - h["at"] + 1)).otherwise("") if bodies else F.lit("")
            start = F.greatest(h["at"] - before, F.lit(0))
            head = cut(w["c"], start, h["at"] - start) if before else F.lit("")
            tail = cut(w["c"], h["at"] + F.length(h["m"]), F.lit(ahead)) if ahead else F.lit("")
            more = [F.when((h["end"] >= 0) & (h["end"] < h["next"]), cut(w["c"], h["end"] + 1, h["next"] - h["end"] - 1)).otherwise("").alias("rest")] if rest else []
            return F.struct(h["m"].alias("m"), body.alias("body"), head.alias("before"), tail.alias("ahead"), *more)

        return F.transform(w["h"], one)

    found_ = let(places(text, pattern), lambda h: F.when(F.size(h) > FEW, closed(text, h)).otherwise(closed_each(text, h))) if bodies else places(text, pattern)
    if rest:
        next_ = lambda a, b: F.struct(a["at"].alias("at"), a["m"].alias("m"), a["end"].alias("end"), F.coalesce(b["at"], F.length(text)).alias("next"))
        found_ = let(found_, lambda h: F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), next_))
    return let(F.struct(chunks(text).alias("c"), found_.alias("h")), of)

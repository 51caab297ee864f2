"""Go source: structs, interfaces, routes, services; go.mod requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.extract import field, found, let, lines, method, relation, rows, some, strip

# Fixed values.
STRUCT = r"type\s+(\w+)\s+struct\s*\{([^}]+)\}"
STRUCT_FIELD = r"^(\w+)\s+(\S+)\s*(?:`([^`]+)`)?"
INTERFACE = r"type\s+(\w+)\s+interface\s*\{([^}]+)\}"
SIGNATURE = r"^(\w+)\s*\(([^)]*)\)\s*(.*)"
HANDLE = r"""(?:HandleFunc|Handle)\s*\(\s*["']([^"']+)["']"""
ROUTE = r"""\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*["']([^"']+)["']"""
SERVICE = r"type\s+(\w+(?:Service|Handler|Controller|Manager|Repository))\s+struct"
RECEIVER = r"func\s+\(\w+\s+\*?(\w+)\)\s+(\w+)\s*\(([^)]*)\)\s*([^{]*)"
FIELD_TYPE = r"^\w+\s+(\*?\w+)"
REQUIRE = r"^(?:require\s+)?(\S+)\s+(v\S+)"

U = "(?U)"


def struct_fields(body: Column) -> Column:
    kept = F.filter(lines(strip(body)), lambda s: (s != "") & ~F.startswith(s, F.lit("//")) & s.rlike(U + STRUCT_FIELD))

    def one(s: Column) -> Column:
        tags = F.regexp_extract(s, U + STRUCT_FIELD, 3)
        low = F.lower(tags)
        marks = some((F.contains(tags, F.lit("primaryKey")) | F.contains(tags, F.lit("primary_key")), "primary_key"), (F.contains(low, F.lit("not null")), "not_null"), (F.contains(low, F.lit("unique")), "unique"))
        named = F.when(tags.rlike('json:"[^"]+"'), F.split_part(F.regexp_extract(tags, 'json:"([^"]+)"', 1), F.lit(","), F.lit(1)))
        return field(F.regexp_extract(s, U + STRUCT_FIELD, 1), F.regexp_extract(s, U + STRUCT_FIELD, 2), marks, tags=tags, json_name=named)

    return F.transform(kept, one)


def struct_relations(fields: Column) -> Column:
    """Pointers to and slices of exported types; a type of only such marks refers to nothing."""
    bare = lambda f: F.regexp_replace(f["type"], r"^[*\[\]]+", "")
    refs = F.filter(fields, lambda f: f["type"].rlike(r"^(\*|\[\])") & bare(f).rlike(r"^\p{Lu}"))
    return F.transform(refs, lambda f: relation(F.when(F.contains(f["type"], F.lit("[]")), "has_many").otherwise("belongs_to"), bare(f), f["name"]))


def structs(files: DataFrame) -> DataFrame:
    """Every struct; a model if a field has database tags."""
    model = lambda fs: F.exists(fs, lambda f: F.contains(f["tags"], F.lit("gorm:")) | F.contains(f["tags"], F.lit("db:")))
    return rows(
        files, found(F.col("content"), STRUCT, 2), name=lambda r: r["g1"], type=lambda r: F.when(let(struct_fields(r["g2"]), model), "model").otherwise("type"),
        fields=lambda r: struct_fields(r["g2"]), relationships=lambda r: let(struct_fields(r["g2"]), struct_relations), raw_definition=lambda r: r["m"],
    )


def interface_methods(body: Column) -> Column:
    kept = F.filter(lines(strip(body)), lambda s: (s != "") & ~F.startswith(s, F.lit("//")) & s.rlike(U + SIGNATURE))
    part = lambda s, k: F.regexp_extract(s, U + SIGNATURE, k)
    return F.transform(kept, lambda s: method(part(s, 1), part(s, 2), strip(part(s, 3))))


def interfaces(files: DataFrame) -> DataFrame:
    return rows(files, found(F.col("content"), INTERFACE, 2), name=lambda r: r["g1"], type=lambda r: F.lit("interface"), methods=lambda r: interface_methods(r["g2"]))


def routes(files: DataFrame) -> DataFrame:
    """Handlers of the standard library, of any method, then routes of frameworks."""
    std = F.transform(found(F.col("content"), HANDLE, 1), lambda m: F.struct(F.lit("ANY").alias("method"), m["g1"].alias("path")))
    own = F.transform(found(F.col("content"), ROUTE, 2), lambda m: F.struct(m["g1"].alias("method"), m["g2"].alias("path")))
    return rows(files, F.concat(std, own), path=lambda r: r["path"], method=lambda r: r["method"], handler=lambda r: F.lit(""))


def services(files: DataFrame) -> DataFrame:
    """Structs named like services that have methods, with the exported types of their fields."""
    text = F.col("content")
    own = lambda name: F.filter(found(text, RECEIVER, 4), lambda m: (m["g1"] == name) & ~F.startswith(m["g2"], F.lit("_")))
    body = lambda name: F.element_at(F.filter(found(text, STRUCT, 2), lambda m: m["g1"] == name), 1)["g2"]
    types = lambda b: F.transform(F.filter(lines(b), lambda s: s.rlike(U + FIELD_TYPE)), lambda s: F.regexp_replace(F.regexp_extract(s, U + FIELD_TYPE, 1), r"^\*+", ""))
    named = rows(files, found(text, SERVICE, 1), name=lambda r: r["g1"], content=lambda r: text)
    full = named.select(
        "source_file", "pos", "name", F.lit("service").alias("type"),
        F.transform(own(F.col("name")), lambda m: method(m["g2"], m["g3"], strip(m["g4"]))).alias("methods"),
        F.when(F.exists(found(text, STRUCT, 2), lambda m: m["g1"] == F.col("name")), F.filter(types(body(F.col("name"))), lambda t: t.rlike(r"^\p{Lu}"))).otherwise(F.array().cast("array<string>")).alias("dependencies"),
    )
    return full.where("size(methods) > 0")


def requirements(files: DataFrame) -> DataFrame:
    """Modules of require blocks and lines of a go.mod."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<name:string,version:string>>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        opens, closes = F.startswith(line, F.lit("require (")), line == ")"
        counts = (s["inside"] | F.startswith(line, F.lit("require "))) & line.rlike(U + REQUIRE) & ~opens & ~closes
        item = F.struct(F.regexp_extract(line, U + REQUIRE, 1).alias("name"), F.regexp_extract(line, U + REQUIRE, 2).alias("version"))
        return F.struct((opens | (s["inside"] & ~closes)).alias("inside"), F.when(counts, F.concat(s["out"], F.array(item))).otherwise(s["out"]).alias("out"))

    found_ = F.aggregate(lines(F.col("content")), start, step, lambda s: s["out"])
    return rows(files, found_, name=lambda r: r["name"], version=lambda r: r["version"], type=lambda r: F.lit("runtime"), ecosystem=lambda r: F.lit("go"))

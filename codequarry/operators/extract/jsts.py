"""JavaScript and TypeScript source, Prisma schemas and package.json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.extract import field, found, lines, method, no_relations, relation, rows, sections, some, strip

# Fixed values.
INTERFACE = r"(?:export\s+)?interface\s+(\w+)(?:<[^>]+>)?\s*(?:extends\s+[^{]+)?\s*\{([^}]+)\}"
OBJECT_TYPE = r"(?:export\s+)?type\s+(\w+)(?:<[^>]+>)?\s*=\s*\{([^}]+)\}"
TS_FIELD = r"(\w+)(\?)?:\s*([^;,\n]+)"
CLASS = r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?\s*\{"
ROUTES = [r"""app\.(get|post|put|delete|patch)\s*\(\s*['"`]([^'"]+)['"`]""", r"""router\.(get|post|put|delete|patch)\s*\(\s*['"`]([^'"]+)['"`]"""]
MONGOOSE = r"(?:const|let|var)\s+(\w+)Schema\s*=\s*new\s+(?:mongoose\.)?Schema\s*\(\s*\{([^}]+)\}"
MONGOOSE_FIELD = r"(\w+)\s*:\s*(?:\{\s*type\s*:\s*(\w+)|(\w+))"
PRISMA = r"model\s+(\w+)\s*\{([^}]+)\}"
PRISMA_FIELD = r"^(\w+)\s+(\w+)(\[\])?\??(\s+.+)?"
SERVICE_NAMES = r"Service|Handler|Controller|Manager|Repository"
METHOD = r"(?:async\s+)?(?<!\w)(\w+)\s*\(([^)]*)\)(?:\s*:\s*([^{]+))?\s*\{"
NOT_METHODS = ["constructor", "if", "for", "while", "switch"]
CONSTRUCTOR = r"constructor\s*\((?:([^)]++)\)|[^)]++\z)"  # without a ) up to the end there is none, and the text isn't read again for each word
NO_CLASS = r"(?s)^.*?(?=(?<!\w)class(?!\w)|\z)"
INJECTED = r"(?:private|public)\s+\w+\s*:\s*(\w+)"
SECTIONS = [("runtime", "dependencies"), ("dev", "devDependencies"), ("peer", "peerDependencies"), ("optional", "optionalDependencies")]

U = "(?U)"


def ts_fields(body: Column) -> Column:
    return F.transform(found(body, TS_FIELD, 3), lambda m: field(m["g1"], strip(m["g3"]), some((m["g2"] == "", "required")), optional=m["g2"] != ""))


def mongoose_fields(body: Column) -> Column:
    def one(m: Column) -> Column:
        says = lambda word: F.regexp_like(body, F.concat(F.lit(U), m["g1"], F.lit(rf"\s*:\s*\{{[^}}]*{word}\s*:\s*true")))
        return field(m["g1"], F.when(m["g2"] != "", m["g2"]).otherwise(m["g3"]), some((says("required"), "required"), (says("unique"), "unique")))

    return F.transform(found(body, MONGOOSE_FIELD, 3), one)


def schemas(files: DataFrame) -> DataFrame:
    """Interfaces, then object types, then Mongoose models."""
    text = F.col("content")
    kinds = [("interface", INTERFACE), ("type", OBJECT_TYPE), ("model", MONGOOSE)]
    all_ = F.concat(*[_kind(text, p, kind) for kind, p in kinds])
    fields = lambda r: F.when(r["kind"] == "model", mongoose_fields(r["g2"])).otherwise(ts_fields(r["g2"]))
    return rows(files, all_, name=lambda r: r["g1"], type=lambda r: r["kind"], fields=fields, relationships=lambda r: no_relations(), raw_definition=lambda r: r["m"])


def _kind(text: Column, pattern: str, kind: str) -> Column:
    return F.transform(found(text, pattern, 2), lambda m: F.struct(m["m"].alias("m"), m["g1"].alias("g1"), m["g2"].alias("g2"), F.lit(kind).alias("kind")))


def routes(files: DataFrame) -> DataFrame:
    all_ = F.concat(*[found(F.col("content"), p, 2) for p in ROUTES])
    return rows(files, all_, path=lambda r: r["g2"], method=lambda r: F.upper(r["g1"]), handler=lambda r: F.lit(""))


def prisma_models(files: DataFrame) -> DataFrame:
    """Models; a capitalised type or an @relation makes a relationship, else it is a field."""
    part = lambda s, k: F.regexp_extract(s, U + PRISMA_FIELD, k)
    kept = lambda body: F.filter(lines(strip(body)), lambda s: (s != "") & ~F.startswith(s, F.lit("//")) & ~F.startswith(s, F.lit("@@")) & s.rlike(U + PRISMA_FIELD))
    linked = lambda s: F.contains(part(s, 4), F.lit("@relation")) | part(s, 2).rlike(r"^\p{Lu}")
    marks = lambda s: some((F.contains(part(s, 4), F.lit("@id")), "primary_key"), (F.contains(part(s, 4), F.lit("@unique")), "unique"), (~F.contains(s, F.lit("?")), "required"))
    fields = lambda r: F.transform(F.filter(kept(r["g2"]), lambda s: ~linked(s)), lambda s: field(part(s, 1), part(s, 2), marks(s)))
    links = lambda r: F.transform(F.filter(kept(r["g2"]), linked), lambda s: relation(F.when(part(s, 3) != "", "has_many").otherwise("belongs_to"), part(s, 2), part(s, 1)))
    return rows(files, found(F.col("content"), PRISMA, 2), name=lambda r: r["g1"], type=lambda r: F.lit("model"), fields=fields, relationships=links, raw_definition=lambda r: r["m"])


def services(files: DataFrame) -> DataFrame:
    """Classes named like services that have methods, with the types that their own constructors are given.

    Constructors are sought in the whole body and, as braces in strings may end it too early, on to the next class.
    """
    methods = lambda body: F.transform(F.filter(found(body, METHOD, 3), lambda m: ~m["g1"].isin(NOT_METHODS)), lambda m: method(m["g1"], m["g2"], F.when(m["g3"] != "", strip(m["g3"]))))
    own = lambda r: F.concat(r["body"], F.regexp_extract(r["rest"], U + NO_CLASS, 0))
    given = lambda r: F.regexp_extract(own(r), U + CONSTRUCTOR, 1)
    named = lambda r: F.regexp_extract(r["m"], U + CLASS, 1)
    classes = F.filter(sections(F.col("content"), CLASS, rest=True), lambda r: named(r).rlike(SERVICE_NAMES))
    # methods are made with the class: a filter on a column that is made after it would make them twice
    with_ = F.transform(classes, lambda r: F.struct(r["m"].alias("m"), given(r).alias("given"), methods(r["body"]).alias("methods")))
    found_ = rows(files, with_, name=named, type=lambda r: F.lit("service"), methods=lambda r: r["methods"], dependencies=lambda r: F.transform(found(r["given"], INJECTED, 1), lambda m: m["g1"]))
    return found_.where("size(methods) > 0")


def package_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of a package.json by section; none if it isn't JSON."""
    parsed = F.from_json("content", "struct<" + ",".join(f"{s}:map<string,string>" for _, s in SECTIONS) + ">")
    with_ = files.withColumn("__p", parsed)
    entries = lambda kind, s: F.transform(F.map_entries(F.coalesce(F.col("__p")[s], F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(kind).alias("type")))
    return rows(with_, F.concat(*[entries(k, s) for k, s in SECTIONS]), name=lambda r: r["name"], version=lambda r: r["version"], type=lambda r: r["type"], ecosystem=lambda r: F.lit("npm"))

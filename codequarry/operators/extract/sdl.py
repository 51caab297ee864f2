"""Schema languages: SQL tables, GraphQL types, Protocol Buffers messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.extract import field, found, let, no_relations, relation, rows, some, strip

# Fixed values.
TABLE = r"""(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`"']?(\w+)[`"']?\s*\(([^;]+)\)"""
COLUMN = r"""(?i)^[`"']?(\w+)[`"']?\s+(\w+(?:\([^)]+\))?)"""
FOREIGN_KEY = r"""(?i)FOREIGN\s+KEY\s*\([`"']?(\w+)[`"']?\)\s*REFERENCES\s*[`"']?(\w+)[`"']?"""
NOT_COLUMNS = r"^(?:PRIMARY|FOREIGN|UNIQUE|CHECK|INDEX|CONSTRAINT|KEY)"
TYPE = r"type\s+(\w+)(?:\s+implements\s+[^{]+)?\s*\{([^}]+)\}"
INPUT = r"input\s+(\w+)\s*\{([^}]+)\}"
TYPE_FIELD = r"(\w+)(?:\([^)]*\))?\s*:\s*(\[?\w+\]?!?)"
OPERATIONS = ["Query", "Mutation", "Subscription"]
GRAPHQL_SCALARS = ["String", "Int", "Float", "Boolean", "ID", "DateTime"]
MESSAGE = r"message\s+(\w+)\s*\{([^}]+)\}"
MESSAGE_FIELD = r"(repeated\s+)?(\w+)\s+(\w+)\s*=\s*(\d+)"
PROTO_SCALARS = "double float int32 int64 uint32 uint64 sint32 sint64 fixed32 fixed64 sfixed32 sfixed64 bool string bytes".split()


def _definitions(body: Column) -> Column:
    """Parts of a table's body between commas outside of parentheses."""
    parts = F.regexp_extract_all(F.concat(body, F.lit(",")), F.lit(r"[^(),]*[(),]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        last = F.right(p, F.lit(1))
        cut = (last == ",") & (s["depth"] == 0)
        depth = s["depth"] + F.when(last == "(", 1).when(last == ")", -1).otherwise(0)
        now = F.concat(s["now"], F.when(cut, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p))
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(now).alias("now"), F.when(cut, F.concat(s["out"], F.array(strip(now)))).otherwise(s["out"]).alias("out"))

    # what an unclosed parenthesis leaves open is a definition too
    rest = lambda s: F.concat(s["out"], F.array(strip(F.regexp_replace(s["now"], ",$", ""))))
    return F.filter(F.aggregate(parts, start, step, rest), lambda d: d != "")


def _column(d: Column) -> Column:
    up = F.upper(d)
    default = F.regexp_extract(d, r"(?iU)DEFAULT\s+([^\s,]+)", 1)
    marks = some((F.contains(up, F.lit("PRIMARY KEY")), "primary_key"), (F.contains(up, F.lit("NOT NULL")), "not_null"), (F.contains(up, F.lit("UNIQUE")), "unique"), (F.contains(up, F.lit("AUTO_INCREMENT")) | F.contains(up, F.lit("SERIAL")), "auto_increment"))
    marks = F.concat(marks, F.when(default != "", F.array(F.concat(F.lit("default="), default))).otherwise(F.array().cast("array<string>")))
    return field(F.regexp_extract(d, "(?U)" + COLUMN, 1), F.regexp_extract(d, "(?U)" + COLUMN, 2), marks)


def sql_columns(body: Column) -> Column:
    columns = F.filter(_definitions(body), lambda d: ~F.upper(d).rlike(NOT_COLUMNS) & d.rlike("(?U)" + COLUMN))
    return F.transform(columns, _column)


def sql_foreign_keys(body: Column) -> Column:
    return F.transform(found(body, FOREIGN_KEY, 2), lambda m: relation(F.lit("foreign_key"), m["g2"], m["g1"]))


def sql_tables(files: DataFrame) -> DataFrame:
    return rows(files, found(F.col("content"), TABLE, 2), name=lambda r: r["g1"], type=lambda r: F.lit("table"), fields=lambda r: sql_columns(r["g2"]), relationships=lambda r: sql_foreign_keys(r["g2"]), raw_definition=lambda r: r["m"])


def graphql_fields(body: Column) -> Column:
    def one(m: Column) -> Column:
        must, many = F.endswith(m["g2"], F.lit("!")), F.startswith(m["g2"], F.lit("["))
        return field(m["g1"], F.btrim(m["g2"], F.lit("[]!")), some((must, "required"), (many, "array")), nullable=~must)

    return F.transform(found(body, TYPE_FIELD, 2), one)


def graphql_relations(fields: Column) -> Column:
    objects = F.filter(fields, lambda f: f["type"].rlike(r"^\p{Lu}") & ~f["type"].isin(GRAPHQL_SCALARS))
    return F.transform(objects, lambda f: relation(F.when(F.array_contains(f["constraints"], "array"), "has_many").otherwise("has_one"), f["type"], f["name"]))


def graphql_types(files: DataFrame) -> DataFrame:
    """Types but for the operations, then inputs."""
    kind = lambda pattern, name: F.transform(found(F.col("content"), pattern, 2), lambda m: F.struct(m["m"].alias("m"), m["g1"].alias("g1"), m["g2"].alias("g2"), F.lit(name).alias("kind")))
    records = F.concat(F.filter(kind(TYPE, "type"), lambda m: ~m["g1"].isin(OPERATIONS)), kind(INPUT, "input"))
    links = lambda r: F.when(r["kind"] == "type", let(graphql_fields(r["g2"]), graphql_relations)).otherwise(no_relations())
    return rows(files, records, name=lambda r: r["g1"], type=lambda r: r["kind"], fields=lambda r: graphql_fields(r["g2"]), relationships=links, raw_definition=lambda r: r["m"])


def proto_fields(body: Column) -> Column:
    return F.transform(found(body, MESSAGE_FIELD, 4), lambda m: field(m["g3"], m["g2"], some((m["g1"] != "", "repeated")), field_number=m["g4"]))


def proto_relations(fields: Column) -> Column:
    objects = F.filter(fields, lambda f: ~F.lower(f["type"]).isin(PROTO_SCALARS))
    return F.transform(objects, lambda f: relation(F.when(F.array_contains(f["constraints"], "repeated"), "has_many").otherwise("has_one"), f["type"], f["name"]))


def proto_messages(files: DataFrame) -> DataFrame:
    return rows(files, found(F.col("content"), MESSAGE, 2), name=lambda r: r["g1"], type=lambda r: F.lit("message"), fields=lambda r: proto_fields(r["g2"]), relationships=lambda r: let(proto_fields(r["g2"]), proto_relations), raw_definition=lambda r: r["m"])

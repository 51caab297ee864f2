"""Java source: entities, services, endpoints; Maven dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.extract import field, found, relation, rows, sections, some, strip

# Fixed values.
ENTITY = r"@(?:Entity|Table|Document|Embeddable)\s*(?:\([^)]*\))?\s*(?:public\s+)?class\s+(\w+)"
FIELD = r"(?:@(\w+)(?:\([^)]*\))?\s*)*(?:private|protected|public)\s+(\w+(?:<[^>]+>)?)\s+(\w+)\s*(?:=|;)"
SERVICE = r"@(?:Service|Component|Repository|Controller|RestController)\s*(?:\([^)]*\))?\s*(?:public\s+)?class\s+(\w+)"
METHOD = r"(?:@\w+(?:\([^)]*\))?\s*)*(?:public|protected|private)\s+(\w+(?:<[^>]+>)?)\s+(\w+)\s*\(([^)]*)\)"
RELATIONS = [(r"(?s)@OneToMany.*?(\w+)\s+(\w+)", "one_to_many"), (r"(?s)@ManyToOne.*?(\w+)\s+(\w+)", "many_to_one"), (r"(?s)@OneToOne.*?(\w+)\s+(\w+)", "one_to_one"), (r"(?s)@ManyToMany.*?(\w+)\s+(\w+)", "many_to_many")]
INJECTED = [r"@Autowired\s+(?:private\s+)?(\w+)", r"private\s+final\s+(\w+)\s+\w+;"]
REPOSITORY_CALL = r"(?<!\w)(\w+)Repository\."
CLASS_PATH = r"""@RequestMapping\s*\(["']([^"']+)["']"""
MAPPINGS = [("GetMapping", "GET"), ("PostMapping", "POST"), ("PutMapping", "PUT"), ("DeleteMapping", "DELETE"), ("PatchMapping", "PATCH")]
MAPPING = r"""\s*\(\s*(?:value\s*=\s*)?["']([^"']*)["']"""
HANDLER = r"public\s+\w+\s+(\w+)\s*\("
DEPENDENCY = r"(?s)<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*(?:<version>([^<]+)</version>)?"

U = "(?U)"


def fields(body: Column) -> Column:
    """Fields with the constraints that their own annotations state."""
    return F.transform(found(body, FIELD, 3), lambda m: field(m["g3"], m["g2"], some((F.contains(m["m"], F.lit("@NotNull")), "not_null"), (m["m"].rlike(r"@Id\b"), "primary_key")), annotations=F.regexp_extract_all(m["m"], F.lit(r"@(\w+)"), F.lit(1))))


def relations(body: Column) -> Column:
    return F.concat(*[_links(body, pattern, kind) for pattern, kind in RELATIONS])


def _links(body: Column, pattern: str, kind: str) -> Column:
    return F.transform(found(body, pattern, 2), lambda m: relation(F.lit(kind), m["g1"], m["g2"]))


def entities(files: DataFrame) -> DataFrame:
    """Annotated classes with the fields and relations of their bodies; an unclosed body is empty."""
    return rows(files, sections(F.col("content"), ENTITY), name=lambda r: F.regexp_extract(r["m"], U + ENTITY, 1), type=lambda r: F.lit("entity"), fields=lambda r: fields(r["body"]), relationships=lambda r: relations(r["body"]), raw_definition=lambda r: r["body"])


def _params(text: Column) -> Column:
    words = lambda p: F.split(strip(p), r"\s+")
    null = F.lit(None)
    each = F.filter(F.split(text, ","), lambda p: F.size(words(p)) >= 2)
    return F.transform(each, lambda p: F.struct(F.element_at(words(p), -1).alias("name"), F.element_at(words(p), -2).alias("type"), null.cast("string").alias("in"), null.cast("boolean").alias("required")))


def methods(body: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.transform(found(body, METHOD, 3), lambda m: F.struct(m["g2"].alias("name"), _params(m["g3"]).alias("params"), m["g3"].alias("params_raw"), m["g1"].alias("returns"), null.alias("docstring"), null.alias("description")))


def services(files: DataFrame) -> DataFrame:
    """Annotated classes: methods, the file's injected types and repositories, the comment before the class."""
    text = F.col("content")
    names = lambda pattern: F.transform(found(text, pattern, 1), lambda m: m["g1"])

    def comment(r: Column) -> Column:
        doc = F.regexp_extract(r["before"], r"(?s)/\*\*(.*?)\*/", 1)
        return F.when(doc != "", strip(F.regexp_replace(doc, r"(?m)^\s*\*\s?", "")))

    return rows(
        files, sections(text, SERVICE, before=500), name=lambda r: F.regexp_extract(r["m"], U + SERVICE, 1), type=lambda r: F.lit("service"), description=comment, methods=lambda r: methods(r["body"]),
        dependencies=lambda t: F.array_sort(F.array_distinct(F.concat(*[names(p) for p in INJECTED]))), data_accessed=lambda t: F.array_sort(F.array_distinct(names(REPOSITORY_CALL))),
    )


def endpoints(files: DataFrame) -> DataFrame:
    """Mappings by verb, with the class's path before their own and the next public method as handler."""
    text = F.col("content")
    base = F.regexp_extract(text, U + CLASS_PATH, 1)

    def of(name: str, verb: str) -> Column:
        pattern = f"@{name}{MAPPING}"

        def one(r: Column) -> Column:
            handler = F.regexp_extract(r["ahead"], U + HANDLER, 1)
            return F.struct(F.lit(verb).alias("method"), F.concat(base, F.regexp_extract(r["m"], U + pattern, 1)).alias("path"), F.when(handler != "", handler).otherwise("unknown").alias("handler"))

        return F.transform(sections(text, pattern, ahead=200, bodies=False), one)

    return rows(files, F.concat(*[of(n, v) for n, v in MAPPINGS]), path=lambda r: r["path"], method=lambda r: r["method"], handler=lambda r: r["handler"])


def pom_dependencies(files: DataFrame) -> DataFrame:
    return rows(files, found(F.col("content"), DEPENDENCY, 3), name=lambda r: F.concat_ws(":", r["g1"], r["g2"]), version=lambda r: F.when(r["g3"] != "", r["g3"]), type=lambda r: F.lit("runtime"), ecosystem=lambda r: F.lit("maven"))

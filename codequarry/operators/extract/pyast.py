"""Python source through its syntax tree, and pip dependency files.

The tree needs Python; a task parses a batch of files and returns records as JSON, which Spark
turns into typed rows. A file that doesn't parse gives one record of kind error.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.model import FIELDS, METHODS, PARAMS, RELATIONSHIPS
from codequarry.operators.extract import lines, rows

# Fixed values.
MODEL_BASES = {"Base", "Model", "db.Model", "models.Model", "DeclarativeBase", "SQLModel", "BaseModel"}
SERVICE_NAME = re.compile(r"\w+(?:Service|Handler|Manager|Controller)")
ROUTERS = {"app.get", "app.post", "app.put", "app.delete", "router.get", "router.post"}
LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
NESTED = {k: [f for f in k._fields if f in ("body", "handlers", "orelse", "finalbody", "cases")] for k in (*ast.stmt.__subclasses__(), ast.Module, ast.ExceptHandler, ast.match_case)}
LIMITS = ("min_length", "max_length", "ge", "le")
REQUIREMENT = r"^([a-zA-Z0-9_-]+)(?:[<>=!]+(.+))?"
QUOTED_REQUIREMENT = r'"([a-zA-Z0-9_-]+)(?:[<>=!]+([^"]+))?"'


def dotted(e: ast.expr) -> str:
    parts = []
    while isinstance(e, ast.Attribute):
        parts.append(e.attr)
        e = e.value
    return ".".join([*([e.id] if isinstance(e, ast.Name) else []), *reversed(parts)])


def annotation(e: ast.expr | None, default: str = "unknown") -> str | None:
    match e:
        case None:
            return default
        case ast.Name(id=name):
            return name
        case ast.Subscript(value=base):
            return f"{dotted(base)}[...]"
        case ast.Constant(value=v):
            return str(v)
    return "unknown"


def const(e: ast.expr | None):
    return e.value if isinstance(e, ast.Constant) else None


def column(call: ast.Call) -> dict:
    """Type and constraints of a column call: the last positional argument names the type."""
    kind = "unknown"
    for a in call.args:
        kind = dotted(a.func) if isinstance(a, ast.Call) else a.id if isinstance(a, ast.Name) else kind
    given = {k.arg: const(k.value) is True for k in call.keywords}
    rules = {"primary_key": given.get("primary_key"), "not_null": "nullable" in given and not given["nullable"], "unique": given.get("unique")}
    order = [k.arg for k in call.keywords]
    named = {"primary_key": "primary_key", "nullable": "not_null", "unique": "unique"}
    return {"type": kind, "constraints": [named[k] for k in order if k in named and rules[named[k]]]}


def annotated(c: ast.ClassDef) -> Iterator[ast.AnnAssign]:
    return (s for s in c.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name))


def segment(c: ast.ClassDef, source: list[str]) -> str:
    """As ast.get_source_segment, of a file that is cut into lines once; columns count bytes."""
    part = source[c.lineno - 1 : c.end_lineno]
    part[-1] = part[-1].encode()[: c.end_col_offset].decode()
    part[0] = part[0].encode()[c.col_offset :].decode()
    return "".join(part)


def statements(tree: ast.Module) -> Iterator[ast.AST]:
    """As ast.walk without expressions: no class or function stands within one, so those found come in the same order."""
    level = [tree]
    while level:
        yield from level
        level = [n for s in level for f in NESTED.get(type(s), ()) for n in getattr(s, f)]


def model_schema(c: ast.ClassDef, source: list[str]) -> dict | None:
    fields, links = [], []
    for s in c.body:
        if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
            fields.append({"name": s.target.id, "type": annotation(s.annotation), "constraints": []})
        if not (isinstance(s, ast.Assign) and isinstance(s.value, ast.Call)):
            continue
        called = dotted(s.value.func)
        names = [t.id for t in s.targets if isinstance(t, ast.Name)]
        if called in ("Column", "db.Column"):
            fields += [{"name": n, **column(s.value)} for n in names]
        elif called == "relationship" and isinstance(s.targets[0], ast.Name):
            targets = [const(a) for a in s.value.args if const(a)]
            if targets:
                links.append({"type": "relationship", "target": str(targets[-1]), "field": names[0]})
    if fields:
        return {"kind": "schema", "name": c.name, "type": "model", "fields": fields, "relationships": links, "raw_definition": segment(c, source)}
    return None


def interface_schema(c: ast.ClassDef) -> dict | None:
    fields = []
    for s in annotated(c):
        limits = [f"{k.arg}={const(k.value) if isinstance(k.value, ast.Constant) else '?'}" for k in s.value.keywords if k.arg in LIMITS] if isinstance(s.value, ast.Call) else []
        fields.append({"name": s.target.id, "type": annotation(s.annotation), "constraints": limits})
    return {"kind": "schema", "name": c.name, "type": "interface", "fields": fields, "relationships": []} if fields else None


def arguments(f: ast.FunctionDef, skip: int) -> list[dict]:
    return [{"name": a.arg, "type": annotation(a.annotation, "Any")} for a in f.args.args[skip:]]


def service(c: ast.ClassDef, kinds: tuple) -> dict:
    functions = [s for s in c.body if isinstance(s, kinds)]
    given = [annotation(a.annotation) for f in functions if f.name == "__init__" for a in f.args.args[1:] if a.annotation]
    public = [{"name": f.name, "params": arguments(f, 1), "returns": annotation(f.returns, None), "docstring": ast.get_docstring(f)} for f in functions if not f.name.startswith("_")]
    return {"kind": "service", "name": c.name, "type": "service", "description": ast.get_docstring(c), "methods": public, "dependencies": given, "data_accessed": []}


def routes(f: ast.FunctionDef) -> Iterator[dict]:
    for d in f.decorator_list:
        if not isinstance(d, ast.Call):
            continue
        called, path = dotted(d.func), const(d.args[0]) if d.args else None
        if called in ROUTERS:
            yield {"kind": "api", "path": str(path or ""), "method": called.rpartition(".")[2].upper(), "handler": f.name, "params": arguments(f, 0), "description": ast.get_docstring(f)}
        elif called == "app.route" and path is not None:
            listed = next((k.value.elts for k in d.keywords if k.arg == "methods" and isinstance(k.value, ast.List)), None)
            for verb in ["GET"] if listed is None else [const(e) for e in listed if isinstance(e, ast.Constant)]:
                yield {"kind": "api", "path": str(path), "method": str(verb), "handler": f.name, "params": [], "description": ast.get_docstring(f)}


def records(source: str | None, include_async: bool = False) -> list[dict]:
    """All records of a source file, in breadth-first order of the tree."""
    source = source or ""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"kind": "error", "description": f"{type(e).__name__}: {e}"}]
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef) if include_async else (ast.FunctionDef,)
    out, cut = [], LINE.findall(source)
    for node in statements(tree):
        if isinstance(node, ast.ClassDef):
            bases = {dotted(b) for b in node.bases}
            found_ = [model_schema(node, cut) if bases & MODEL_BASES else None, interface_schema(node) if "BaseModel" in bases else None, service(node, kinds) if SERVICE_NAME.match(node.name) else None]
            out += [r for r in found_ if r]
        elif isinstance(node, kinds):
            out += routes(node)
    return out


def parse(files: DataFrame, include_async: bool = False, kinds: Collection[str] | None = None) -> DataFrame:
    """source_file, pos, kind and record (JSON) of each record, of all kinds or of the given ones."""
    schema = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("record", T.StringType())])

    def run(batches):
        for b in batches:
            rows_ = [(p, k, r["kind"], json.dumps(r, default=str)) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for k, r in enumerate(records(c, include_async)) if kinds is None or r["kind"] in kinds]
            cols = list(zip(*rows_, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["source_file", "pos", "kind", "record"])

    return files.select("path", "content").mapInArrow(run, schema)


def _typed(parsed: DataFrame, kind: str, schema: str) -> DataFrame:
    return parsed.where(F.col("kind") == kind).select("source_file", "pos", F.from_json("record", schema).alias("r")).select("source_file", "pos", "r.*")


def schemas(parsed: DataFrame) -> DataFrame:
    return _typed(parsed, "schema", f"name string, type string, fields {FIELDS}, relationships {RELATIONSHIPS}, raw_definition string")


def services(parsed: DataFrame) -> DataFrame:
    return _typed(parsed, "service", f"name string, type string, description string, methods {METHODS}, dependencies array<string>, data_accessed array<string>")


def apis(parsed: DataFrame) -> DataFrame:
    return _typed(parsed, "api", f"path string, method string, handler string, params {PARAMS}, description string")


def errors(parsed: DataFrame) -> DataFrame:
    return _typed(parsed, "error", "description string")


def _pip(files: DataFrame, items: Column, pattern: str) -> DataFrame:
    part = lambda s, k: F.regexp_extract(s, pattern, k)
    return rows(files, F.filter(items, lambda s: s.rlike(pattern)), name=lambda s: part(s, 1), version=lambda s: F.when(part(s, 2) != "", part(s, 2)), type=lambda s: F.lit("runtime"), ecosystem=lambda s: F.lit("pip"))


def requirements(files: DataFrame) -> DataFrame:
    return _pip(files, F.filter(lines(F.col("content")), lambda s: ~F.startswith(s, F.lit("#"))), REQUIREMENT)


def pyproject_dependencies(files: DataFrame) -> DataFrame:
    """Quoted requirements below a line that sets dependencies, up to a line that starts with a bracket."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        opens = F.contains(line, F.lit("dependencies")) & F.contains(line, F.lit("="))
        closes = s["inside"] & ~opens & F.startswith(line, F.lit("]"))
        item = s["inside"] & ~opens & ~closes
        return F.struct((opens | (s["inside"] & ~closes)).alias("inside"), F.when(item, F.concat(s["out"], F.array(line))).otherwise(s["out"]).alias("out"))

    return _pip(files, F.aggregate(lines(F.col("content")), start, step, lambda s: s["out"]), QUOTED_REQUIREMENT)

"""Configuration files: Compose, Kubernetes, OpenAPI and database settings.

JSON is read by Spark; YAML and TOML are first turned into JSON in a task.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.operators.extract import field, no_relations, rows, some

# Fixed values.
VERBS = ["get", "post", "put", "delete", "patch"]
DATABASE_KEYS = ["database", "databases", "datasource", "db"]
COMPOSE_FILE = r"(^|/)docker-compose.*\.ya?ml$"


def _as_json(path: str, content: str | None) -> tuple[str | None, str | None]:
    """The file as a JSON object, and what is wrong if it can't be read as one."""
    try:
        if path.endswith((".yaml", ".yml")):
            import yaml

            data = yaml.safe_load(content)
        elif path.endswith(".toml"):
            import tomllib

            data = tomllib.loads(content)
        else:
            data = json.loads(content)
        if not isinstance(data, dict):
            return None, None if data is None or isinstance(data, list) else f"TypeError: {type(data).__name__} in place of an object"
        return json.dumps(data, default=str), None
    except Exception as e:  # whatever a broken file makes the parsers raise; the row says what
        return None, f"{type(e).__name__}: {e}"


def as_json(files: DataFrame) -> DataFrame:
    """Files with their content as JSON, and kind: compose, k8s, openapi, database or null; or with description, the error."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "content", "description")])

    def run(batches):
        for b in batches:
            path = b.column("path").to_pylist()
            made = list(map(_as_json, path, b.column("content").to_pylist()))
            yield pa.RecordBatch.from_pydict({"path": b.column("path"), "content": pa.array([c for c, _ in made], pa.string()), "description": pa.array([d for _, d in made], pa.string())})

    done = files.select("path", "content").mapInArrow(run, schema)
    keys = F.coalesce(F.json_object_keys("content"), F.array().cast("array<string>"))
    holds = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    kind = F.when(F.col("path").rlike(COMPOSE_FILE), "compose").when(holds("apiVersion") & holds("kind"), "k8s").when(holds("openapi", "swagger"), "openapi").when(holds("database", "databases", "datasource"), "database")
    return done.where("content is not null or description is not null").withColumn("kind", kind)


def errors(parsed: DataFrame) -> DataFrame:
    """One row for each file that can't be read."""
    return parsed.where("description is not null").select(F.col("path").alias("source_file"), F.lit(0).alias("pos"), "description")


def _images(files: DataFrame, images: Column, ecosystem: str) -> DataFrame:
    return rows(files, F.filter(images, lambda i: i.isNotNull()), name=lambda i: i, version=lambda i: F.lit(None).cast("string"), type=lambda i: F.lit("runtime"), ecosystem=lambda i: F.lit(ecosystem))


def compose_images(parsed: DataFrame) -> DataFrame:
    services = F.from_json("content", "struct<services:map<string,struct<image:string>>>")["services"]
    return _images(parsed.where("kind = 'compose'"), F.transform(F.map_values(services), lambda s: s["image"]), "docker")


def kubernetes_images(parsed: DataFrame) -> DataFrame:
    box = "array<struct<image:string>>"
    data = F.from_json("content", f"struct<kind:string,spec:struct<containers:{box},template:struct<spec:struct<containers:{box}>>>>")
    boxes = F.when(data["kind"] == "Deployment", data["spec"]["template"]["spec"]["containers"]).when(data["kind"] == "Pod", data["spec"]["containers"])
    return _images(parsed.where("kind = 'k8s'"), F.transform(boxes, lambda c: c["image"]), "kubernetes")


def _or(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values])


def openapi_endpoints(parsed: DataFrame) -> DataFrame:
    """One row for each path and verb; bodies and responses stay JSON."""
    op = "struct<operationId:string,summary:string,description:string,requestBody:string,responses:string,parameters:array<struct<name:string,`in`:string,required:boolean,schema:struct<type:string>>>>"
    paths = F.from_json("content", "struct<paths:map<string,map<string,string>>>")["paths"]
    pairs = F.flatten(F.transform(F.map_entries(paths), lambda p: F.transform(F.map_entries(p["value"]), lambda v: F.struct(p["key"].alias("path"), v["key"].alias("verb"), F.from_json(v["value"], op).alias("op")))))
    known = F.filter(pairs, lambda r: F.lower(r["verb"]).isin(VERBS) & r["op"].isNotNull())
    params = lambda r: F.transform(F.coalesce(r["op"]["parameters"], F.array().cast("array<struct<name:string,in:string,required:boolean,schema:struct<type:string>>>")), lambda p: F.struct(p["name"].alias("name"), F.coalesce(p["schema"]["type"], F.lit("any")).alias("type"), p["in"].alias("in"), F.coalesce(p["required"], F.lit(False)).alias("required")))
    return rows(
        parsed.where("kind = 'openapi'"), known, path=lambda r: r["path"], method=lambda r: F.upper(r["verb"]), handler=lambda r: F.coalesce(r["op"]["operationId"], F.lit("")), params=params,
        request_body=lambda r: r["op"]["requestBody"], response=lambda r: r["op"]["responses"], description=lambda r: _or(r["op"]["summary"], r["op"]["description"]),
    )


def openapi_schemas(parsed: DataFrame) -> DataFrame:
    one = "struct<required:array<string>,properties:map<string,struct<type:string,description:string>>>"
    data = F.from_json("content", f"struct<components:struct<schemas:map<string,{one}>>,definitions:map<string,{one}>>")
    newer = data["components"]["schemas"]
    schemas = F.map_entries(F.when(F.size(newer) > 0, newer).otherwise(data["definitions"]))
    must = lambda r: F.coalesce(r["value"]["required"], F.array().cast("array<string>"))
    fields = lambda r: F.transform(F.map_entries(r["value"]["properties"]), lambda p: field(p["key"], F.coalesce(p["value"]["type"], F.lit("any")), some((F.array_contains(must(r), p["key"]), "required")), description=p["value"]["description"]))
    return rows(parsed.where("kind = 'openapi'"), schemas, name=lambda r: r["key"], type=lambda r: F.lit("interface"), fields=fields, relationships=lambda r: no_relations(), raw_definition=lambda r: F.lit(None).cast("string"))


def database_dependencies(parsed: DataFrame) -> DataFrame:
    one = "struct<type:string,driver:string,engine:string,name:string,database:string>"
    raw = F.from_json("content", "struct<" + ",".join(f"{k}:string" for k in DATABASE_KEYS) + ">")
    entries = F.flatten(F.array(*[F.when(raw[k].isNull(), F.array().cast(f"array<{one}>")).when(raw[k].startswith("["), F.from_json(raw[k], f"array<{one}>")).when(raw[k].startswith("{"), F.array(F.from_json(raw[k], one))).otherwise(F.array().cast(f"array<{one}>")) for k in DATABASE_KEYS]))
    kind = lambda d: _or(d["type"], d["driver"], d["engine"])
    known = F.filter(F.coalesce(entries, F.array().cast(f"array<{one}>")), lambda d: kind(d).isNotNull())
    return rows(parsed.where("kind = 'database'"), known, name=lambda d: F.concat_ws(":", kind(d), _or(d["name"], d["database"])), version=lambda d: F.lit(None).cast("string"), type=lambda d: F.lit("runtime"), ecosystem=lambda d: F.lit("database"))

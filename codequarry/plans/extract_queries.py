"""Queries that write source files from the driver's tables and extract from them.

The SQL selects the columns that the files were written from, so it needs no parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators import enrich, manifest
from codequarry.operators.extract import configs, golang, java, jsts, pyast, sdl
from codequarry.operators.tables import spread
from codequarry.plans.queries import query
from codequarry.plans.tables import table


def _files(spark, sf_dir, source: str, path: str, *parts: str) -> DataFrame:
    """Files from rows of a table: path and parts are SQL expressions; parts are joined."""
    return spread(table(spark, sf_dir, source)).selectExpr(f"{path} as path", f"concat({', '.join(parts)}) as content")


def _each(df: DataFrame, items: str, nth: str, item: str) -> DataFrame:
    """One row for each item of a list, with its place.

    Before an inner explode Spark puts a filter on the list (not null, not empty) and moves it below the step that
    makes the list, which is then made three times for each record. An outer one has no such filter.
    """
    rest = [c for c in df.columns if c != items]
    return df.select(*rest, F.posexplode_outer(items).alias(nth, item)).where(F.col(nth).isNotNull())


def _fields(df: DataFrame, *more: str) -> DataFrame:
    """One row for each field of each record."""
    each = _each(df.select("source_file", "name", "type", "fields"), "fields", "nth", "f")
    return each.select("source_file", F.col("name").alias("record"), "type", "nth", F.col("f.name").alias("field"), F.col("f.type").alias("kind"), F.array_join("f.constraints", ",").alias("constraints"), *[F.col(f"f.{m}").alias(m) for m in more])


def _links(df: DataFrame) -> DataFrame:
    return _each(df.select("source_file", "name", "relationships"), "relationships", "nth", "r").select("source_file", F.col("name").alias("record"), F.col("r.type").alias("type"), F.col("r.target").alias("target"), F.col("r.field").alias("field"))


def _ddl(spark, sf_dir):
    body = "'-- parts\\nCREATE TABLE IF NOT EXISTS `t', p_partkey, '` (\\n  id INT PRIMARY KEY,\\n  price DECIMAL(10,', p_size % 5, ') NOT NULL DEFAULT ', p_size, ',\\n  brand_', p_size, ' VARCHAR(20) UNIQUE,\\n  CONSTRAINT fk FOREIGN KEY (price) REFERENCES r', p_size, ' (id)\\n);\\ncreate table u', p_partkey, ' (a serial);'"
    return _files(spark, sf_dir, "part", "concat('db/', p_partkey, '.sql')", body)


@query("SELECT 'db/' || p_partkey || '.sql' AS source_file, 't' || p_partkey AS name, 'table' AS type FROM part UNION ALL SELECT 'db/' || p_partkey || '.sql', 'u' || p_partkey, 'table' FROM part")
def sql_tables(spark, sf_dir):
    return sdl.sql_tables(_ddl(spark, sf_dir)).select("source_file", "name", "type")


@query(
    """SELECT 'db/' || p_partkey || '.sql' AS source_file, 't' || p_partkey AS record, 'table' AS type, nth::INTEGER AS nth, [ 'id', 'price', 'brand_' || p_size ][nth + 1] AS field,
 ['INT', 'DECIMAL(10,' || p_size % 5 || ')', 'VARCHAR(20)'][nth + 1] AS kind, ['primary_key', 'not_null,default=' || p_size, 'unique'][nth + 1] AS constraints FROM part, range(3) r(nth)
 UNION ALL SELECT 'db/' || p_partkey || '.sql', 'u' || p_partkey, 'table', 0, 'a', 'serial', 'auto_increment' FROM part"""
)
def sql_columns(spark, sf_dir):
    return _fields(sdl.sql_tables(_ddl(spark, sf_dir)))


@query("SELECT 'db/' || p_partkey || '.sql' AS source_file, 't' || p_partkey AS record, 'foreign_key' AS type, 'r' || p_size AS target, 'price' AS field FROM part")
def sql_fks(spark, sf_dir):
    return _links(sdl.sql_tables(_ddl(spark, sf_dir)))


def _graphql(spark, sf_dir):
    return _files(spark, sf_dir, "part", "concat('g/', p_partkey, '.graphql')", "'type Query { parts: [Part] }\\ntype Part', p_partkey, ' implements Node {\\n  id: ID!\\n  owners(first: Int): [Brand', p_size, '!]\\n  maker: Maker', p_size % 7, '\\n}\\ninput In', p_partkey, ' { size: Int! }'")


@query(
    """SELECT 'g/' || p_partkey || '.graphql' AS source_file, 'Part' || p_partkey AS record, 'type' AS type, nth::INTEGER AS nth, ['id', 'owners', 'maker'][nth + 1] AS field, ['ID', 'Brand' || p_size, 'Maker' || p_size % 7][nth + 1] AS kind,
 ['required', 'required,array', ''][nth + 1] AS constraints, nth = 2 AS nullable FROM part, range(3) r(nth) UNION ALL SELECT 'g/' || p_partkey || '.graphql', 'In' || p_partkey, 'input', 0, 'size', 'Int', 'required', false FROM part"""
)
def graphql_types(spark, sf_dir):
    return _fields(sdl.graphql_types(_graphql(spark, sf_dir)), "nullable")


@query("SELECT 'g/' || p_partkey || '.graphql' AS source_file, 'Part' || p_partkey AS record, ['has_many', 'has_one'][nth] AS type, ['Brand' || p_size, 'Maker' || p_size % 7][nth] AS target, ['owners', 'maker'][nth] AS field FROM part, range(1, 3) r(nth)")
def graphql_relations(spark, sf_dir):
    return _links(sdl.graphql_types(_graphql(spark, sf_dir)))


def _proto(spark, sf_dir):
    return _files(spark, sf_dir, "supplier", "concat('p/', s_suppkey, '.proto')", "'syntax = \"proto3\";\\nmessage Supplier', s_suppkey, ' {\\n  string name = 1;\\n  repeated Nation', s_nationkey, ' nations = ', s_nationkey + 2, ';\\n}'")


@query(
    """SELECT 'p/' || s_suppkey || '.proto' AS source_file, 'Supplier' || s_suppkey AS record, 'message' AS type, nth::INTEGER AS nth, ['name', 'nations'][nth + 1] AS field, ['string', 'Nation' || s_nationkey][nth + 1] AS kind, ['', 'repeated'][nth + 1] AS constraints,
 [1, s_nationkey + 2][nth + 1]::INTEGER AS field_number FROM supplier, range(2) r(nth)"""
)
def proto_fields(spark, sf_dir):
    return _fields(sdl.proto_messages(_proto(spark, sf_dir)), "field_number")


@query("SELECT 'p/' || s_suppkey || '.proto' AS source_file, 'Supplier' || s_suppkey AS record, 'has_many' AS type, 'Nation' || s_nationkey AS target, 'nations' AS field FROM supplier")
def proto_relations(spark, sf_dir):
    return _links(sdl.proto_messages(_proto(spark, sf_dir)))


def _go(spark, sf_dir):
    code = "'package main\\ntype Part', p_partkey, 'Service struct {\\n  // about\\n  ID int `gorm:\"primaryKey\" json:\"id,omitempty\"`\\n  Brands []Brand', p_size, '\\n  Repo *Store', p_size % 9, '\\n  *\\n}\\nfunc (s *Part', p_partkey, 'Service) Find', p_size, '(id int) (*Part, error) {\\n}\\nfunc (s *Other) Not() {}\\ntype Reader', p_size, ' interface {\\n  Read(n int) error\\n}\\nfunc main() {\\n  http.HandleFunc(\"/h', p_size, '\", x)\\n  r.GET(\"/p/', p_partkey, '\", y)\\n}'"
    return _files(spark, sf_dir, "part", "concat('go/', p_partkey, '.go')", code)


@query(
    """SELECT 'go/' || p_partkey || '.go' AS source_file, 'Part' || p_partkey || 'Service' AS record, 'model' AS type, nth::INTEGER AS nth, ['ID', 'Brands', 'Repo'][nth + 1] AS field, ['int', '[]Brand' || p_size, '*Store' || p_size % 9][nth + 1] AS kind,
 ['primary_key', '', ''][nth + 1] AS constraints, ['id', NULL, NULL][nth + 1] AS json_name FROM part, range(3) r(nth)"""
)
def go_structs(spark, sf_dir):
    return _fields(golang.structs(_go(spark, sf_dir)), "json_name")


@query("SELECT 'go/' || p_partkey || '.go' AS source_file, 'Part' || p_partkey || 'Service' AS record, ['has_many', 'belongs_to'][nth] AS type, ['Brand' || p_size, 'Store' || p_size % 9][nth] AS target, ['Brands', 'Repo'][nth] AS field FROM part, range(1, 3) r(nth)")
def go_relations(spark, sf_dir):
    return _links(golang.structs(_go(spark, sf_dir)))


@query("SELECT 'go/' || p_partkey || '.go' AS source_file, ['ANY', 'GET'][nth] AS method, ['/h' || p_size, '/p/' || p_partkey][nth] AS path FROM part, range(1, 3) r(nth)")
def go_routes(spark, sf_dir):
    return golang.routes(_go(spark, sf_dir)).select("source_file", "method", "path")


@query("SELECT 'go/' || p_partkey || '.go' AS source_file, 'Part' || p_partkey || 'Service' AS name, 'Find' || p_size || '(id int) (*Part, error)' AS methods, 'Store' || p_size % 9 AS dependencies FROM part")
def go_services(spark, sf_dir):
    m = F.array_join(F.transform("methods", lambda x: F.concat(x["name"], F.lit("("), x["params_raw"], F.lit(") "), x["returns"])), ";")
    return golang.services(_go(spark, sf_dir)).select("source_file", "name", m.alias("methods"), F.array_join("dependencies", ",").alias("dependencies"))


@query("SELECT 'go/' || p_partkey || '.go' AS source_file, 'Reader' || p_size AS name, 'Read' AS method, 'n int' AS params, 'error' AS returns FROM part")
def go_interfaces(spark, sf_dir):
    m = F.element_at("methods", 1)
    return golang.interfaces(_go(spark, sf_dir)).select("source_file", "name", m["name"].alias("method"), m["params_raw"].alias("params"), m["returns"].alias("returns"))


@query("SELECT 'm/' || s_suppkey || '/go.mod' AS source_file, ['example.com/n' || s_nationkey, 'example.com/b' || s_suppkey, 'example.com/c'][nth] AS name, ['v1.' || s_nationkey || '.0', 'v0.0.' || s_suppkey, 'v2.0.0'][nth] AS version FROM supplier, range(1, 4) r(nth)")
def go_mod(spark, sf_dir):
    files = _files(spark, sf_dir, "supplier", "concat('m/', s_suppkey, '/go.mod')", "'module example.com/x\\nrequire example.com/n', s_nationkey, ' v1.', s_nationkey, '.0\\nrequire (\\n\\texample.com/b', s_suppkey, ' v0.0.', s_suppkey, '\\n\\texample.com/c v2.0.0 // indirect\\n)\\nexample.com/no v1.0.0'")
    return golang.requirements(files).select("source_file", "name", "version")


def _ts(spark, sf_dir):
    code = "'export interface Part', p_partkey, ' extends Base {\\n  id: number;\\n  brand', p_size, '?: Array<string>;\\n}\\ntype Box = { size: number }\\nconst brand', p_size, 'Schema = new mongoose.Schema({ title: { type: String, required: true }, age: Number });\\napp.get(\"/a/', p_partkey, '\", f); router.post(`/b/', p_size, '\", g);\\nexport class Part', p_partkey, 'Controller extends X {\\n  constructor(private readonly: Repo', p_size, ', public b: Bus) { if (a) { } }\\n  async load', p_size, '(id: number): Promise<void> { for (;;) { } }\\n}\\nclass Plain { x() { } }'"
    return _files(spark, sf_dir, "part", "concat('ts/', p_partkey, '.ts')", code)


@query(
    """SELECT 'ts/' || p_partkey || '.ts' AS source_file, ['Part' || p_partkey, 'Part' || p_partkey, 'Box', 'brand' || p_size, 'brand' || p_size][k] AS record, ['interface', 'interface', 'type', 'model', 'model'][k] AS type, [0, 1, 0, 0, 1][k]::INTEGER AS nth,
 ['id', 'brand' || p_size, 'size', 'title', 'required'][k] AS field, ['number', 'Array<string>', 'number', 'String', 'true'][k] AS kind, ['required', '', 'required', 'required', ''][k] AS constraints, [false, true, false, NULL, NULL][k] AS optional FROM part, range(1, 6) r(k)"""
)
def ts_schemas(spark, sf_dir):
    return _fields(jsts.schemas(_ts(spark, sf_dir)), "optional")


@query("SELECT 'ts/' || p_partkey || '.ts' AS source_file, ['GET', 'POST'][nth] AS method, ['/a/' || p_partkey, '/b/' || p_size][nth] AS path FROM part, range(1, 3) r(nth)")
def js_routes(spark, sf_dir):
    return jsts.routes(_ts(spark, sf_dir)).select("source_file", "method", "path")


@query("SELECT 'ts/' || p_partkey || '.ts' AS source_file, 'Part' || p_partkey || 'Controller' AS name, 'load' || p_size || '(id: number): Promise<void>' AS methods, 'Repo' || p_size || ',Bus' AS dependencies FROM part")
def js_services(spark, sf_dir):
    m = F.array_join(F.transform("methods", lambda x: F.concat(x["name"], F.lit("("), x["params_raw"], F.lit("): "), x["returns"])), ";")
    return jsts.services(_ts(spark, sf_dir)).select("source_file", "name", m.alias("methods"), F.array_join("dependencies", ",").alias("dependencies"))


def _prisma(spark, sf_dir):
    return _files(spark, sf_dir, "part", "concat('pr/', p_partkey, '.prisma')", "'model Part', p_partkey, ' {\\n  id string @id\\n  // no\\n  size', p_size, ' int?\\n  brands Brand', p_size, '[]\\n  owner owner', p_size, ' @relation(fields: [x])\\n  @@index([id])\\n}'")


@query("SELECT 'pr/' || p_partkey || '.prisma' AS source_file, 'Part' || p_partkey AS record, 'model' AS type, nth::INTEGER AS nth, ['id', 'size' || p_size][nth + 1] AS field, ['string', 'int'][nth + 1] AS kind, ['primary_key,required', ''][nth + 1] AS constraints FROM part, range(2) r(nth)")
def prisma_fields(spark, sf_dir):
    return _fields(jsts.prisma_models(_prisma(spark, sf_dir)))


@query("SELECT 'pr/' || p_partkey || '.prisma' AS source_file, 'Part' || p_partkey AS record, ['has_many', 'belongs_to'][nth] AS type, ['Brand', 'owner'][nth] || p_size AS target, ['brands', 'owner'][nth] AS field FROM part, range(1, 3) r(nth)")
def prisma_relations(spark, sf_dir):
    return _links(jsts.prisma_models(_prisma(spark, sf_dir)))


@query("SELECT 'k/' || s_suppkey || '/package.json' AS source_file, ['runtime', 'runtime', 'dev'][nth] AS type, ['a' || s_suppkey, 'b', 'c' || s_nationkey][nth] AS name, ['^1.' || s_nationkey, '2', '~3'][nth] AS version FROM supplier, range(1, 4) r(nth)")
def package_json(spark, sf_dir):
    files = _files(spark, sf_dir, "supplier", "concat('k/', s_suppkey, '/package.json')", "'{\"name\": \"x\", \"dependencies\": {\"a', s_suppkey, '\": \"^1.', s_nationkey, '\", \"b\": \"2\"}, \"devDependencies\": {\"c', s_nationkey, '\": \"~3\"}}'")
    return jsts.package_dependencies(files).select("source_file", "type", "name", "version")


def _java(spark, sf_dir):
    code = "'/** Keeps parts.\\n * Well. */\\n@Service\\npublic class Part', p_partkey, 'Service {\\n  private final Brand', p_size, 'Repository repo;\\n  @Autowired private Clock clock;\\n  public List<Part> find', p_size, '(final int id, String name) { if (x) { Brand', p_size, 'Repository.save(1); } }\\n}\\n@Entity(name = \"p\")\\npublic class Part', p_partkey, ' {\\n  @Id @NotNull\\n  private Long id;\\n  @ManyToOne\\n  Maker maker', p_size, ';\\n}\\n@RequestMapping(\"/api\")\\nclass C { @GetMapping(\"/g/', p_partkey, '\")\\n  public Part get', p_size, '(int x) {} @DeleteMapping(value = \"/d/', p_size, '\") void none() {} }'"
    return _files(spark, sf_dir, "part", "concat('j/', p_partkey, '.java')", code)


@query("SELECT 'j/' || p_partkey || '.java' AS source_file, 'Part' || p_partkey AS record, 'entity' AS type, 0 AS nth, 'id' AS field, 'Long' AS kind, 'not_null,primary_key' AS constraints FROM part")
def java_entities(spark, sf_dir):
    return _fields(java.entities(_java(spark, sf_dir)))


@query("SELECT 'j/' || p_partkey || '.java' AS source_file, 'Part' || p_partkey AS record, 'many_to_one' AS type, 'Maker' AS target, 'maker' || p_size AS field FROM part")
def java_relations(spark, sf_dir):
    return _links(java.entities(_java(spark, sf_dir)))


@query("SELECT 'j/' || p_partkey || '.java' AS source_file, ['GET', 'DELETE'][nth] AS method, ['/api/g/' || p_partkey, '/api/d/' || p_size][nth] AS path, ['get' || p_size, 'unknown'][nth] AS handler FROM part, range(1, 3) r(nth)")
def java_endpoints(spark, sf_dir):
    return java.endpoints(_java(spark, sf_dir)).select("source_file", "method", "path", "handler")


@query("SELECT 'j/' || p_partkey || '.java' AS source_file, 'Part' || p_partkey || 'Service' AS name, 'Keeps parts.' || chr(10) || 'Well.' AS description, 'find' || p_size || '(int id, String name)' AS methods, 'Brand' || p_size || 'Repository,Clock' AS dependencies, 'Brand' || p_size AS data_accessed FROM part")
def java_services(spark, sf_dir):
    args = lambda m: F.array_join(F.transform(m["params"], lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")
    m = F.array_join(F.transform("methods", lambda x: F.concat(x["name"], F.lit("("), args(x), F.lit(")"))), ";")
    return java.services(_java(spark, sf_dir)).select("source_file", "name", "description", m.alias("methods"), F.array_join("dependencies", ",").alias("dependencies"), F.array_join("data_accessed", ",").alias("data_accessed"))


@query("SELECT 'x/' || s_suppkey || '/pom.xml' AS source_file, ['org.a' || s_nationkey || ':b' || s_suppkey, 'org.c:d'][nth] AS name, ['1.' || s_suppkey, NULL][nth] AS version FROM supplier, range(1, 3) r(nth)")
def pom_deps(spark, sf_dir):
    files = _files(spark, sf_dir, "supplier", "concat('x/', s_suppkey, '/pom.xml')", "'<project><dependency>\\n<groupId>org.a', s_nationkey, '</groupId> <artifactId>b', s_suppkey, '</artifactId>\\n<version>1.', s_suppkey, '</version></dependency><dependency><groupId>org.c</groupId><artifactId>d</artifactId></dependency></project>'")
    return java.pom_dependencies(files).select("source_file", "name", "version")


def _py(spark, sf_dir):
    code = "'class Part', p_partkey, '(Base):\\n    id = Column(Integer, primary_key=True)\\n    brand', p_size, ' = Column(String(20), nullable=False, unique=True)\\n    maker = relationship(\"Maker', p_size, '\")\\n\\nclass In', p_partkey, '(BaseModel):\\n    size: int = Field(ge=', p_size, ', le=99)\\n    tags: list[str]\\n\\nclass Part', p_partkey, 'Service:\\n    \"\"\"Keeps parts.\"\"\"\\n    def __init__(self, repo: Repo', p_size, ', n):\\n        pass\\n    def find', p_size, '(self, id: int, other) -> Part:\\n        \"\"\"Finds.\"\"\"\\n    async def hidden(self): ...\\n\\n@app.get(\"/p/', p_partkey, '\")\\ndef get', p_size, '(id: int): ...\\n\\n@app.route(\"/r/', p_size, '\", methods=[\"POST\", \"PUT\"])\\ndef both(): ...\\n'"
    return _files(spark, sf_dir, "part", "concat('py/', p_partkey, '.py')", code)


@query(
    """SELECT 'py/' || p_partkey || '.py' AS source_file, ['Part', 'Part', 'In', 'In', 'In', 'In'][k] || p_partkey AS record, ['model', 'model', 'model', 'model', 'interface', 'interface'][k] AS type, [0, 1, 0, 1, 0, 1][k]::INTEGER AS nth,
 ['id', 'brand' || p_size, 'size', 'tags', 'size', 'tags'][k] AS field, ['Integer', 'String', 'int', 'list[...]', 'int', 'list[...]'][k] AS kind, ['primary_key', 'not_null,unique', '', '', 'ge=' || p_size || ',le=99', ''][k] AS constraints FROM part, range(1, 7) r(k)"""
)
def py_models(spark, sf_dir):
    return _fields(pyast.schemas(pyast.parse(_py(spark, sf_dir), kinds=["schema"])))


@query("SELECT 'py/' || p_partkey || '.py' AS source_file, 'Part' || p_partkey || 'Service' AS name, 'Keeps parts.' AS description, 'find' || p_size || '(id int, other Any) Part Finds.' AS methods, 'Repo' || p_size AS dependencies FROM part")
def py_services(spark, sf_dir):
    args = lambda m: F.array_join(F.transform(m["params"], lambda p: F.concat_ws(" ", p["name"], p["type"])), ", ")
    m = F.array_join(F.transform("methods", lambda x: F.concat(x["name"], F.lit("("), args(x), F.lit(") "), F.concat_ws(" ", x["returns"], x["docstring"]))), ";")
    return pyast.services(pyast.parse(_py(spark, sf_dir), kinds=["service"])).select("source_file", "name", "description", m.alias("methods"), F.array_join("dependencies", ",").alias("dependencies"))


@query("SELECT 'py/' || p_partkey || '.py' AS source_file, ['GET', 'POST', 'PUT'][k] AS method, ['/p/' || p_partkey, '/r/' || p_size, '/r/' || p_size][k] AS path, ['get' || p_size, 'both', 'both'][k] AS handler FROM part, range(1, 4) r(k)")
def py_routes(spark, sf_dir):
    return pyast.apis(pyast.parse(_py(spark, sf_dir), kinds=["api"])).select("source_file", "method", "path", "handler")


@query("SELECT 'e/' || s_suppkey || '.py' AS source_file, true AS failed FROM supplier WHERE s_nationkey % 2 = 0")
def py_errors(spark, sf_dir):
    files = _files(spark, sf_dir, "supplier", "concat('e/', s_suppkey, '.py')", "if(s_nationkey % 2 = 0, 'def broken(:', 'x = 1')")
    return pyast.errors(pyast.parse(files, kinds=["error"])).select("source_file", F.contains("description", F.lit("SyntaxError")).alias("failed"))


@query("SELECT 'r/' || s_suppkey || '/requirements.txt' AS source_file, ['a-' || s_nationkey, 'b'][k] AS name, ['1.' || s_suppkey, NULL][k] AS version FROM supplier, range(1, 3) r(k)")
def pip_deps(spark, sf_dir):
    files = _files(spark, sf_dir, "supplier", "concat('r/', s_suppkey, '/requirements.txt')", "'# all\\na-', s_nationkey, '==1.', s_suppkey, '\\n\\n  b  \\n-r x'")
    return pyast.requirements(files).where("name not like '-%'").select("source_file", "name", "version")


@query("SELECT 'r/' || s_suppkey || '/pyproject.toml' AS source_file, ['a-' || s_nationkey, 'b'][k] AS name, ['1.' || s_suppkey, NULL][k] AS version FROM supplier, range(1, 3) r(k)")
def pyproject_deps(spark, sf_dir):
    files = _files(spark, sf_dir, "supplier", "concat('r/', s_suppkey, '/pyproject.toml')", "'[project]\\nname = \"x\"\\ndependencies = [\\n  \"a-', s_nationkey, '>=1.', s_suppkey, '\",\\n  \"b\",\\n]\\nother = [\\n  \"c\",\\n]'")
    return pyast.pyproject_dependencies(files).select("source_file", "name", "version")


def _openapi(spark, sf_dir):
    doc = "'{\"openapi\": \"3.0\", \"paths\": {\"/p/', p_partkey, '\": {\"get\": {\"operationId\": \"get', p_size, '\", \"description\": \"d\", \"parameters\": [{\"name\": \"q\", \"in\": \"query\", \"schema\": {\"type\": \"integer\"}}]}, \"trace\": {}, \"post\": {\"summary\": \"s', p_size, '\"}}}, \"components\": {\"schemas\": {\"S', p_size, '\": {\"required\": [\"a\"], \"properties\": {\"a\": {\"type\": \"string\", \"description\": \"x\"}, \"b\": {}}}}}}'"
    return _files(spark, sf_dir, "part", "concat('o/', p_partkey, '.json')", doc)


@query("SELECT 'o/' || p_partkey || '.json' AS source_file, ['GET', 'POST'][k] AS method, '/p/' || p_partkey AS path, ['get' || p_size, ''][k] AS handler, ['d', 's' || p_size][k] AS description, ['q:integer:query:false', ''][k] AS params FROM part, range(1, 3) r(k)")
def openapi_endpoints(spark, sf_dir):
    rows = configs.openapi_endpoints(configs.as_json(_openapi(spark, sf_dir)))
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["type"], p["in"], p["required"].cast("string"))), ",")
    return rows.select("source_file", "method", "path", "handler", "description", params.alias("params"))


@query("SELECT 'o/' || p_partkey || '.json' AS source_file, 'S' || p_size AS record, 'interface' AS type, nth::INTEGER AS nth, ['a', 'b'][nth + 1] AS field, ['string', 'any'][nth + 1] AS kind, ['required', ''][nth + 1] AS constraints, ['x', NULL][nth + 1] AS description FROM part, range(2) r(nth)")
def openapi_schemas(spark, sf_dir):
    return _fields(configs.openapi_schemas(configs.as_json(_openapi(spark, sf_dir))), "description")


@query("SELECT 'c/' || s_suppkey || '/docker-compose.yml' AS source_file, ['img' || s_nationkey || ':1', 'db'][k] AS name, 'docker' AS ecosystem FROM supplier, range(1, 3) r(k)")
def compose_images(spark, sf_dir):
    files = _files(spark, sf_dir, "supplier", "concat('c/', s_suppkey, '/docker-compose.yml')", "'services:\\n  a:\\n    image: img', s_nationkey, ':1\\n  b:\\n    build: .\\n  c:\\n    image: db\\n'")
    return configs.compose_images(configs.as_json(files)).select("source_file", "name", "ecosystem")


@query("SELECT 'k8/' || s_suppkey || '.yaml' AS source_file, 'img' || s_nationkey AS name, 'kubernetes' AS ecosystem FROM supplier WHERE s_suppkey % 3 < 2")
def k8s_images(spark, sf_dir):
    pod = "'apiVersion: v1\\nkind: Pod\\nspec:\\n  containers:\\n  - image: img', s_nationkey"
    deployment = "'apiVersion: apps/v1\\nkind: Deployment\\nspec:\\n  template:\\n    spec:\\n      containers:\\n      - image: img', s_nationkey"
    files = _files(spark, sf_dir, "supplier", "concat('k8/', s_suppkey, '.yaml')", f"case s_suppkey % 3 when 0 then concat({pod}) when 1 then concat({deployment}) else 'a: [unclosed' end")
    return configs.kubernetes_images(configs.as_json(files)).select("source_file", "name", "ecosystem")


@query("SELECT 'd/' || s_suppkey || '.toml' AS source_file, ['pg:n' || s_nationkey, 'redis'][k] AS name FROM supplier, range(1, 3) r(k) WHERE s_suppkey % 2 = 0 OR k = 1")
def db_config(spark, sf_dir):
    files = _files(spark, sf_dir, "supplier", "concat('d/', s_suppkey, '.toml')", "'[database]\\ntype = \"pg\"\\nname = \"n', s_nationkey, '\"\\n', if(s_suppkey % 2 = 0, '[[databases]]\\nengine = \"redis\"\\n', '')")
    return configs.database_dependencies(configs.as_json(files)).select("source_file", "name")


_EXT = "['.py', '.md', '.yaml', '.ts', '.png', '.txt'][doc_id % 6 + 1]"


@query(
    f"""WITH f AS (SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN '/user_model' ELSE '/util' END || {_EXT} AS path FROM documents)
 SELECT doc_id, path, CASE WHEN doc_id % 6 IN (0, 3) AND doc_id % 2 = 0 THEN 1 WHEN doc_id % 6 IN (0, 3) THEN 2 ELSE 3 END AS tier, ['python', 'markdown', 'yaml', 'typescript', 'unknown', 'text'][doc_id % 6 + 1] AS language, doc_id % 6 = 4 AS is_binary FROM f"""
)
def tier_classify(spark, sf_dir):
    ext = "element_at(array('.py', '.md', '.yaml', '.ts', '.png', '.txt'), cast(doc_id % 6 + 1 as int))"
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"concat(source, if(doc_id % 2 = 0, '/user_model', '/util'), {ext}) as path", "text")
    path = F.col("path")
    return d.select("doc_id", "path", manifest.tier(path).alias("tier"), manifest.language(path).alias("language"), F.coalesce(manifest.is_binary(path, F.coalesce("text", F.lit(""))), F.lit(False)).alias("is_binary"))


@query(
    """WITH RECURSIVE t AS (SELECT source AS repo, lpad(doc_id::VARCHAR, 9, '0') AS path, (length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM documents),
 o AS (SELECT repo, path, tokens, row_number() OVER (PARTITION BY repo ORDER BY tokens DESC, path) AS k, sum(tokens) OVER (PARTITION BY repo) AS total FROM t),
 g AS (SELECT repo, k, path, tokens, total, CASE WHEN total <= 8000 OR tokens <= 8000 THEN tokens ELSE 0 END AS used, total <= 8000 OR tokens <= 8000 AS kept FROM o WHERE k = 1
   UNION ALL SELECT o.repo, o.k, o.path, o.tokens, o.total, CASE WHEN o.total <= 8000 OR g.used + o.tokens <= 8000 THEN g.used + o.tokens ELSE g.used END, o.total <= 8000 OR g.used + o.tokens <= 8000 FROM g JOIN o ON o.repo = g.repo AND o.k = g.k + 1)
 SELECT repo, path, tokens, kept FROM g"""
)
def token_budget(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr("source as repo", "lpad(cast(doc_id as string), 9, '0') as path", "cast(length(coalesce(text, '')) div 4 as bigint) as tokens")
    spent = files.select("repo").distinct().withColumn("tokens", F.lit(2000))
    return manifest.within_budget(files, spent, 10_000)


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_salvage(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "case event_id % 3 when 0 then concat('Here it is:\\n```json\\n', props, '\\n```\\nDone {') when 1 then concat('So: ', props, ' and {more}') else props end as answer")
    return enrich.salvage_json(e, "answer").select("event_id", F.get_json_object("json", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, doc_id % 3 = 0 AND length(coalesce(text, '')) <= 100000 AS cached, CASE WHEN length(coalesce(text, '')) > 100000 THEN 'too large' END AS error FROM documents")
def enrich_cached(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('f/', doc_id) as path", "coalesce(text, '') as content")
    cache = enrich.extract(d.where("doc_id % 3 = 0"), None, enrich.OfflineProvider()).select("key", "answer")
    return enrich.extract(d, cache, enrich.OfflineProvider()).select("doc_id", "cached", "error")

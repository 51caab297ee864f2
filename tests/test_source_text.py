"""Outlines and bodies of messy sources: braces in strings and comments, CRLF, one-line and unclosed bodies."""

import time

import pytest
from pyspark.sql import functions as F

from codequarry.operators.extract import java, jsts, sections
from codequarry.operators.outline import lex, outline


def show(source, language):
    return outline(source, language).split("\n")


PYTHON = '''"""Module."""
import os
from a import (
    b,
)


LIMIT = 10
limit = 11

@dec
class A(Base,
        metaclass=M):
    r"""Doc with def f(): and import x

    class Fake:
    """
    x: int = 1
    KIND = "def g(): {"

    # a note
    def one(self): return 1

    async def two(
        self, a: dict = {"k": "):"},  # def three():
    ) -> int:
        \'\'\'Two.\'\'\'
        text = """
import hidden
def hidden(): pass
"""
        return 2


def last():
    import inner
    pass

if TYPE_CHECKING:
    from x import y
'''


def test_python_outline():
    assert show(PYTHON, "python") == [
        "import os", "from a import (", "", "LIMIT = 10", "", "@dec", "class A(Base,", "        metaclass=M):", '    r"""Doc with def f(): and import x', "", "    class Fake:", '    """',
        '    KIND = "def g(): {"', "", "    # a note", "    def one(self): return 1", "        ...", "    async def two(", '        self, a: dict = {"k": "):"},  # def three():', "    ) -> int:",
        "        '''Two.'''", "        ...", "def last():", "    ...", "    from x import y",
    ]


def test_broken_python_goes_on_at_the_next_head():
    assert show("def broken(a, (:\n    x = 1\n\nclass B:\n    def ok(self):\n        pass\n", "python") == ["def broken(a, (:", "    x = 1", "", "    ...", "class B:", "    def ok(self):", "        ..."]
    assert outline("", "python") == "" and outline('x = """never ends\ndef f():\n', "python") == ""


JAVA = """package a.b;
import java.util.*;

/** Keeps {things}.
 * class Fake {
 */
@Service
public class Shop extends Base
    implements Face {
  private String brace = "{ not // a comment";
  char c = '{';

  // } still in the class
  @Get("/x{id}")
  public void f(int a) {
    if (a > 0) { g(); /* } */ }
    String s = \"\"\"
      } class Text {
      \"\"\";
  }
  int one() { return 1; }
  int two();
  enum Kind { A, B }
}
interface Face {
  void m();
}
"""


def test_java_outline():
    assert show(JAVA, "java") == [
        "package a.b;", "import java.util.*;", "", "/** Keeps {things}.", " * class Fake {", " */", "@Service", "public class Shop extends Base", "    implements Face {",
        '  private String brace = "{ not // a comment";', "  char c = '{';", "", "  // } still in the class", '  @Get("/x{id}")', "  public void f(int a) {", "    // ...",
        "  int one() { return 1; }", "    // ...", "  int two();", "  enum Kind { A, B }", "    // ...", "}", "interface Face {", "  void m();", "}",
    ]
    assert show(JAVA.replace("\n", "\r\n"), "java") == show(JAVA, "java")


def test_go_and_rust_outlines():
    go = "package p\nimport (\n\t\"a\"\n)\n\n// F does {\nfunc F() {}\nfunc G() string {\n\treturn `} func H() {`\n}\n\ntype T struct {\n\tA int `json:\"{a}\"`\n\tf func() struct{}\n}\n"
    assert show(go, "go") == ["package p", "import (", '\t"a"', ")", "", "// F does {", "func F() {}", "  // ...", "func G() string {", "  // ...", "", "type T struct {", '\tA int `json:"{a}"`', "\tf func() struct{}", "   // ...", "}"]
    rust = "use a::b;\n#[derive(Debug)]\npub struct S<'a> {\n    x: &'a str,\n}\n/* one { /* two */ } */\npub fn f<'a>(x: &'a str) -> char {\n    let y = r#\"} fn no() {\"#;\n    '{'\n}\nfn g() {}\n"
    assert show(rust, "rust") == ["use a::b;", "#[derive(Debug)]", "pub struct S<'a> {", "    x: &'a str,", "}", "/* one { /* two */ } */", "pub fn f<'a>(x: &'a str) -> char {", "  // ...", "fn g() {}", "  // ..."]
    csharp = 'using System;\nnamespace A;\npublic class C {\n  string p = @"c:\\{";\n  void F() {\n    x = $@"}""{";\n  }\n}\n'
    assert show(csharp, "csharp") == ["using System;", "namespace A;", "public class C {", '  string p = @"c:\\{";', "  void F() {", "    // ...", "}"]


SCRIPT = """import {
  a,
} from 'a';
import b from "b"
const c = require('c');

export * from './d';
/* class Fake { */
export class Shop extends Base {
  private name: string = `a ${b({ c: `}${d}` })} {`;
  re = /[{"'`]\\/}/g;

  @Input() constructor(private a: A) { }
  async find<T>(
    x: T,
  ): Promise<T> {
    return x / 2 / { y: '}' };
  }
  get size(): number { return 1; }
  abstract later(): void;
}
export interface Shape {
  a: { b: string };
}
export default function run() {
  const s = "}";
  return s;
}
const handler = async () => {
  if (a) { b(); }
};
export const X = 1;
enum Kind { A }
run();
"""


def test_script_outline():
    assert show(SCRIPT, "typescript") == [
        "import {", "  a,", "} from 'a';", 'import b from "b"', "const c = require('c');", "", "export * from './d';", "/* class Fake { */", "export class Shop extends Base {",
        "  private name: string = `a ${b({ c: `}${d}` })} {`;", "  re = /[{\"'`]\\/}/g;", "", "  @Input() constructor(private a: A) { }", "  async find<T>(", "    x: T,", "  ): Promise<T> {", "    // ...",
        "  get size(): number { return 1; }", "    // ...", "  abstract later(): void;", "}", "export interface Shape {", "  a: { b: string };", "}", "export default function run() {", "  // ...",
        "const handler = async () => {", "  // ...", "export const X = 1;", "enum Kind { A }", "  // ...",
    ]


@pytest.mark.parametrize("language", ["java", "csharp", "go", "rust", "javascript", "python"])
def test_lexers_keep_lines_and_lengths(language):
    for source in (PYTHON, JAVA, SCRIPT, "'", '"', "`${", "/*", '"""', "a\\", "\n\n", "x", "r#\"", "`${`${`"):
        lines = lex(source, language)
        assert [x.text for x in lines] == source.splitlines() and all(len(x.code) == len(x.text) for x in lines)


def test_unclosed_bodies_end_at_the_next_declaration():
    source = "func A() {\n\tif x {\n\nfunc B() int {\n\treturn 1\n}\n"
    assert show(source, "go") == ["func A() {", "  // ...", "func B() int {", "  // ..."]
    script = "class A {\n  f() {\n    g({\n}\n\nclass B {\n  h() { }\n}\n"
    assert "class B {" in show(script, "javascript") and "  h() { }" in show(script, "javascript")


# bodies by position -----------------------------------------------------------------------


def plain_body(text, start):
    depth, opened = 0, False
    for k in range(text.find("{", start), len(text)) if "{" in text[start:] else ():
        depth += (text[k] == "{") - (text[k] == "}")
        opened = True
        if not depth:
            return text[start : k + 1]
    return "" if opened or True else None


TEXTS = [
    "class A { x { } } class B { y }",
    "} class A { { } class B {",
    "é 🙂 class Ä { ü } class B\n{ }}",
    "class A class B { }",
    "no classes { }",
    "",
    "class A { " + "x { } " * 2000 + "} class Z { }",
    "x" * 5000 + "class A {" + "y" * 9000 + "}",
]


def test_sections_match_a_plain_scan(spark):
    import re

    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(99, None)], "k int, content string")
    got = {r.k: r.s for r in df.select("k", sections(F.col("content"), r"class\s+(\w+)", before=7, ahead=11).alias("s")).collect()}
    assert got[99] == []
    for k, t in enumerate(TEXTS):
        want = [(m[0], plain_body(t, m.start()), t[max(0, m.start() - 7) : m.start()], t[m.end() : m.end() + 11]) for m in re.finditer(r"class\s+(\w+)", t)]
        assert [tuple(s) for s in got[k]] == want, k


def test_a_large_source_with_many_mappings(spark):
    """Ten thousand mappings and a thousand classes in a file of over a megabyte."""
    methods = "".join(f'  @GetMapping("/p{k}")\n  public Item get{k}(int a) {{ if (a > {k}) {{ run("{"x" * 40}"); }} }}\n' for k in range(10_000))
    classes = "".join(f"@Service\npublic class S{k} {{\n  public Item find{k}(int a) {{ }}\n}}\n" for k in range(1000))
    files = spark.createDataFrame([("A.java", f'@RequestMapping("/api")\nclass Web {{\n{methods}}}\n{classes}')], "path string, content string")
    assert len(files.first().content) > 1 << 20
    t = time.time()
    found = java.endpoints(files).select("path", "handler").collect()
    assert [(r.path, r.handler) for r in found] == [(f"/api/p{k}", f"get{k}") for k in range(10_000)]
    services = java.services(files).select("name", "methods").collect()
    assert [(r.name, [m.name for m in r.methods]) for r in services] == [(f"S{k}", [f"find{k}"]) for k in range(1000)]
    assert time.time() - t < 120


MESSY_JAVA = '@Entity\nclass A {\r\n  @Id\n  private Long id;\n  void f() { g("x"); }\n}\n@Entity class B { private int n; }\n@Entity class C { private int lost;\n'
MESSY_TS = "export class UserService {\n  constructor(private a: Repo) { }\n  find(x: number): User { return { y: 1 }; }\n}\nclass OrderService { place(o: Order): void { } }\nclass Other { f() { } }\nclass LostService { f() {\n"


def test_several_records_in_one_file(spark):
    files = spark.createDataFrame([("A.java", MESSY_JAVA), ("empty.java", ""), ("crlf.java", MESSY_JAVA.replace("\n", "\r\n"))], "path string, content string")
    got = {(r.source_file, r.name): [f.name for f in r.fields] for r in java.entities(files).collect()}
    assert got == {(p, n): f for p in ("A.java", "crlf.java") for n, f in (("A", ["id"]), ("B", ["n"]), ("C", []))}
    files = spark.createDataFrame([("a.ts", MESSY_TS)], "path string, content string")
    got = [(r.name, [m.name for m in r.methods], list(r.dependencies)) for r in jsts.services(files).collect()]
    assert [g[0] for g in got] == ["UserService", "OrderService"] and "find" in got[0][1] and got[0][2] == ["Repo"]


def test_a_constructor_is_found_wherever_it_stands_in_its_class(spark):
    """Only the first 2000 characters behind a class's start were searched, be they its own or another's."""
    filler = "".join(f"  step{k}(x: number): void {{ run(x); }}\n" for k in range(300))
    wide = ", ".join(f"private p{k}: Type{k}" for k in range(200))  # begins before the 2000th character and ends behind it
    long = lambda name, given: f"export class {name}Service {{\n{filler}  constructor({given}) {{ }}\n}}\n"
    far = "/* " + "é𝄞 " * 5000 + "*/"
    files = {
        "late.ts": long("Late", "private a: A, public b: B"),
        "wide.ts": f"class WideService {{ f() {{ }}\n  constructor({wide}) {{ }}\n}}\n",
        "far.ts": f"{far}\nclass FarService {{ f() {{ }} {far}\n  constructor(private c: C) {{ }} }}",
        "own.ts": "class NoneService { f() { } }\nclass Other { constructor(private d: D) { } }\nclass NextService { constructor(private e: E) { } g() { } }\n",
        "many.ts": "".join(long(f"M{k}", f"private a: A{k}") for k in range(8)),
        "early.ts": f"class EarlyService {{ f() {{ }} end = '}}';\n{filler}  constructor(private a: A) {{ }}\n}}\nclass Box<T> implements Face {{ constructor(private t: T) {{ }} }}\n",
        "face.ts": "class FaceService { f() { } }\nclass Box<T> implements Face { constructor(private t: T) { } }\n",
        "lost.ts": f"class LostService {{ f() {{ }} {filler} constructor(private a: A) {{ }}",
    }
    got = {(r.source_file, r.name): list(r.dependencies) for r in jsts.services(spark.createDataFrame(list(files.items()), "path string, content string")).collect()}
    assert got == {
        ("late.ts", "LateService"): ["A", "B"], ("wide.ts", "WideService"): [f"Type{k}" for k in range(200)], ("far.ts", "FarService"): ["C"],
        ("own.ts", "NoneService"): [], ("own.ts", "NextService"): ["E"], ("early.ts", "EarlyService"): ["A"], ("face.ts", "FaceService"): [], **{("many.ts", f"M{k}Service"): [f"A{k}"] for k in range(8)},
    }

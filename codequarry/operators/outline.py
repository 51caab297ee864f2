"""Outlines of source files: declarations, imports and comments stay, bodies become a mark.

A lexer passes over the whole text once and says of each line what of it is code: strings, template
and regular-expression literals, and comments are blanked, with a stack for what nests in them
(expressions in templates, comments in comments). The outlines then walk over lines with a stack of
scopes and never see a brace, keyword or bracket that stands in a string or comment.

Results are the lines that tell the structure, as they are; blank lines are squeezed to one. Unlike a
scanner of raw lines, a one-line body hides nothing that follows it. A body that never ends, as in a
broken file, ends where a line that is indented no deeper than its head begins a declaration.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# lexer --------------------------------------------------------------------------------------

_LINE_COMMENT, _BLOCK_COMMENT = r"//[^\n]*", r"/\*(?:.*?\*/|.*\Z)"
_STRING, _CHAR = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\[^\n]{1,9}?|[^\\'\n])'"
_TEXT_BLOCK = r'"""(?:.*?"""|.*\Z)'

#: The tokens of each language, comments first; what none takes is code.
_TOKENS = {
    "java": [("comment", _LINE_COMMENT), ("comment", _BLOCK_COMMENT), ("string", _TEXT_BLOCK), ("string", _STRING), ("string", _CHAR)],
    "csharp": [("comment", _LINE_COMMENT), ("comment", _BLOCK_COMMENT), ("string", _TEXT_BLOCK), ("string", r'(?:@\$?|\$@)"(?:""|[^"])*"?'), ("string", _STRING), ("string", _CHAR)],
    "go": [("comment", _LINE_COMMENT), ("comment", _BLOCK_COMMENT), ("string", r"`[^`]*`?"), ("string", _STRING), ("string", _CHAR)],
    "rust": [("comment", _LINE_COMMENT), ("nested", r"/\*"), ("string", r'\bb?r(?P<hashes>#*)"(?:.*?"(?P=hashes)|.*\Z)'), ("string", r'"(?:\\.|[^"\\])*"?'), ("string", _CHAR)],
    "javascript": [("comment", _LINE_COMMENT), ("comment", _BLOCK_COMMENT), ("string", _STRING), ("string", r"'(?:\\.|[^'\\\n])*'?"), ("template", "`"), ("slash", "/"), ("brace", "[{}]")],
    "python": [("comment", r"#[^\n]*"), ("string", r"\b[rRbBuUfF]{0,2}(?P<q3>\"\"\"|''')(?:(?:\\.|[^\\])*?(?P=q3)|.*\Z)"), ("string", r"(?P<q3b>\"\"\"|''')(?:(?:\\.|[^\\])*?(?P=q3b)|.*\Z)"), ("string", r"\"(?:\\.|[^\"\\\n])*\"?"), ("string", r"'(?:\\.|[^'\\\n])*'?")],
}
_TOKENS["typescript"] = _TOKENS["javascript"]
OUTLINED = tuple(_TOKENS)
_LEXERS = {k: re.compile("|".join(f"(?P<t{n}_{kind}>{p})" for n, (kind, p) in enumerate(tokens)), re.S) for k, tokens in _TOKENS.items()}
_NESTED = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"\\.|\$\{|`", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:;!&|?{}\[+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|new))\s*$")


@dataclass
class Line:
    text: str  # as it stands
    code: str  # strings and comments blanked; of the same length
    inside: str  # "comment" or "string" if the line begins in one


def lex(source: str, language: str) -> list[Line]:
    """The lines of a source with what of them is code."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    code, at, spans = list(source), 0, []
    lexer, templates, depth = _LEXERS[language], [], 0

    def blank(start: int, end: int, kind: str) -> None:
        code[start:end] = [c if c == "\n" else " " for c in code[start:end]]
        spans.append((start, end, kind))

    def template(start: int) -> int:
        """Blank a template's text from a place on, up to its end or to the next expression in it."""
        for t in _TEMPLATE.finditer(source, start):
            if t[0] == "`":
                blank(start, t.end(), "string")
                return t.end()
            if t[0] == "${":
                blank(start, t.end(), "string")
                templates.append(depth)
                return t.end()
        blank(start, len(source), "string")
        return len(source)

    while (m := lexer.search(source, at)) is not None:
        kind, at = m.lastgroup.partition("_")[2], m.end()
        if kind in ("comment", "string"):
            if m.end() == m.start():
                at += 1
                continue
            blank(m.start(), m.end(), kind)
        elif kind == "nested":
            level, end = 1, len(source)
            for n in _NESTED.finditer(source, m.end()):
                level += 1 if n[0] == "/*" else -1
                if not level:
                    end = n.end()
                    break
            blank(m.start(), end, "comment")
            at = end
        elif kind == "template":
            blank(m.start(), m.end(), "string")
            at = template(m.end())
        elif kind == "slash":
            start = source.rfind("\n", 0, m.start()) + 1
            literal = _REGEX.match(source, m.start())
            if literal and _BEFORE_REGEX.search("".join(code[start : m.start()])):
                blank(m.start(), literal.end(), "string")
                at = literal.end()
        elif m[0] == "{":
            depth += 1
        elif templates and depth == templates[-1]:  # the expression ends, its template goes on
            templates.pop()
            code[m.start()] = " "
            at = template(m.end())
        else:
            depth -= 1
    texts = source.split("\n")
    if texts and not texts[-1]:
        texts.pop()
    codes, out, place, k = "".join(code).split("\n"), [], 0, 0
    for text, masked in zip(texts, codes, strict=False):
        while k < len(spans) and spans[k][1] <= place:
            k += 1
        inside = spans[k][2] if k < len(spans) and spans[k][0] < place else ""
        out.append(Line(text, masked, inside))
        place += len(text) + 1
    return out


class _Out(list):
    def blank(self) -> None:
        if self and self[-1].strip():
            self.append("")


def _indent(text: str) -> int:
    return len(text) - len(text.lstrip())


# Python -------------------------------------------------------------------------------------

_PY_HEAD = re.compile(r"\s*(?:class|(?:async\s+)?def)\s")
_PY_CONSTANT = re.compile(r"[A-Z_][A-Z0-9_]*\s*[:=]")
_PY_DOC = re.compile(r"\s*[rRuU]?(\"\"\"|''')")


def _statements(lines: list[Line]) -> list[tuple[int, int]]:
    """Logical lines as ranges of lines: brackets, strings and backslashes carry on; so do no heads of a broken file."""
    out, start, depth = [], 0, 0
    for k, line in enumerate(lines):
        if k > start and not line.inside and depth > 0 and _PY_HEAD.match(line.code):
            out.append((start, k))
            start, depth = k, 0
        depth = max(0, depth + sum(line.code.count(c) for c in "([{") - sum(line.code.count(c) for c in ")]}"))
        goes_on = depth > 0 or line.code.rstrip().endswith("\\") or (k + 1 < len(lines) and lines[k + 1].inside == "string")
        if not goes_on:
            out.append((start, k + 1))
            start = k + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def python_outline(source: str) -> str:
    """Imports, decorators, heads of classes and functions, docstrings, comments and constants; a function's body is dots."""
    lines = lex(source or "", "python")
    out, hidden, statements = _Out(), None, _statements(lines)
    k = 0
    while k < len(statements):
        start, end = statements[k]
        text, k = lines[start].text, k + 1
        bare = text.strip()
        if not bare:
            if hidden is None:
                out.blank()
            continue
        if hidden is not None and _indent(text) > hidden:
            continue
        hidden = None
        if _PY_HEAD.match(lines[start].code):
            out += [x.text for x in lines[start:end]]
            if k < len(statements) and _PY_DOC.match(lines[statements[k][0]].text):
                out += [x.text for x in lines[statements[k][0] : statements[k][1]]]
                k += 1
            if not bare.startswith("class"):
                out.append(" " * (_indent(text) + 4) + "...")
                hidden = _indent(text)
        elif bare.startswith(("import ", "from ", "@", "#")) or _PY_CONSTANT.match(bare):
            out.append(text)
    return "\n".join(out)


# languages with braces ------------------------------------------------------------------------

# Fixed values.
_MODIFIERS = r"(?:public\s+|private\s+|protected\s+|internal\s+|static\s+|final\s+|abstract\s+|override\s+|virtual\s+|async\s+|unsafe\s+)*"
_IMPORTS = {"java": ("import ", "package "), "go": ("import ", "package "), "csharp": ("using ", "namespace "), "rust": ("use ", "mod ", "extern crate ")}
_TYPE = re.compile(rf"\s*(?:pub(?:\(crate\))?\s+)?{_MODIFIERS}(?:class |interface |struct |enum |trait |impl |type \w+\s+(?:struct|interface|enum)\b)")
_FUNCTION = re.compile(r"\s*(?:pub(?:\(crate\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:fn\s+\w+|func\s+)")
_JS_IMPORT = re.compile(r"\s*(?:import |export \{|export \* |(?:const|let|var) \w+ = require\()")
_JS_EXPORT = re.compile(r"\s*export\s+(?!(?:default\s+)?(?:class |function |async |interface |type |enum |abstract ))")
_JS_CLASS = re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+")
_JS_SHAPE = re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:interface |type )")
_JS_FUNCTION = re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s+\w+|enum\s+\w+)")
_JS_VALUE = re.compile(r"\s*(?:export\s+)?(?:const|let|var)\s+\w+")
_JS_METHOD = re.compile(r"\s*(?:(?:public|private|protected|static|abstract|override|readonly)\s+)*(?:async\s+)?(?:get\s+|set\s+)?(?:constructor|\w+)\s*(?:<[^>]*>)?\s*\(")
_JS_FIELD = re.compile(r"\s*(?:(?:public|private|protected|static|readonly|abstract|override)\s+)*\w+\s*[?!]?\s*[:=;]")


class _Walk:
    """Lines of a language with braces, taken one after another."""

    def __init__(self, source: str, language: str):
        self.lines, self.out, self.k = lex(source or "", language), _Out(), 0

    @property
    def line(self) -> Line | None:
        return self.lines[self.k] if self.k < len(self.lines) else None

    def keep(self) -> str:
        """Keep the line and go on; returns its code."""
        line = self.lines[self.k]
        self.out.append(line.text)
        self.k += 1
        return line.code

    def comment(self) -> bool:
        """Keep a comment with all its lines, an annotation's line; squeeze blanks."""
        bare = self.line.text.lstrip()
        if not bare:
            self.out.blank()
            self.k += 1
        elif bare.startswith("/*"):
            self.keep()
            while self.line and self.line.inside == "comment":
                self.keep()
        elif bare.startswith(("//", "@")):
            self.keep()
        else:
            return False
        return True

    def head(self, code: str, ends: str = "{") -> str:
        """Keep lines until one has a brace (or another end); returns the code of all."""
        while self.line and not any(c in code for c in ends):
            code += "\n" + self.keep()
        return code

    def body(self, code: str, indent: int, mark: bool = True, keep: bool = False) -> None:
        """Pass over (or keep) what code has opened."""
        depth = code.count("{") - code.count("}")
        if mark:
            self.out.append(" " * (indent + 2) + "// ...")
        while self.line and depth > 0:
            line = self.line
            if not line.inside and line.code.strip() and _indent(line.text) <= indent and self.declares(line.code):
                return  # the body has lost its end
            depth += line.code.count("{") - line.code.count("}")
            if keep:
                self.out.append(line.text)
            self.k += 1

    def declares(self, code: str) -> bool:
        return bool(_TYPE.match(code) or _FUNCTION.match(code) or _JS_CLASS.match(code) or _JS_FUNCTION.match(code))


def brace_outline(source: str, language: str = "java") -> str:
    """Imports, types with their members, functions and comments of Java, Go, C# and Rust."""
    w = _Walk(source, language)
    imports = _IMPORTS[language]
    while w.line:
        line = w.line
        bare, indent = line.code.lstrip(), _indent(line.text)
        if not line.inside and (w.comment() or line.text.lstrip().startswith("#") and w.keep() is not None):
            continue
        if line.inside:
            w.k += 1
        elif bare.startswith(imports):
            code = w.keep()
            if language == "go" and "(" in code and ")" not in code:
                w.head("", ")")
        elif _FUNCTION.match(line.code):
            code = w.head(w.keep(), "{;")
            w.body(code, indent)
        elif _TYPE.match(line.code):
            _members(w, w.head(w.keep(), "{;"), indent)
        else:
            w.k += 1
    return "\n".join(w.out)


def _members(w: _Walk, code: str, indent: int) -> None:
    """What stands in a type: every line at its own level, with marks for bodies."""
    depth = code.count("{") - code.count("}")
    while w.line and depth > 0:
        line = w.line
        own = _indent(line.text)
        if line.inside or not line.code.strip():  # comments and blank lines stay as they are
            w.keep()
        elif own <= indent and w.declares(line.code) and depth == 1:
            return  # the type has lost its end
        elif line.code.lstrip().startswith("}"):
            depth += w.keep().count("{") - line.code.count("}")
        elif "{" in line.code:
            w.body(w.keep(), own)
        else:
            w.keep()


def script_outline(source: str, language: str = "typescript") -> str:
    """Imports, exports, classes with their members, interfaces whole, functions and values of JavaScript and TypeScript."""
    w = _Walk(source, language)
    while w.line:
        line = w.line
        code, indent = line.code, _indent(line.text)
        if line.inside:
            w.k += 1
        elif w.comment():
            continue
        elif _JS_IMPORT.match(line.text):
            code = w.keep()
            while w.line and w.line.text.strip() and not code.rstrip().endswith(";") and not (code.rstrip().endswith(("}", " ")) and "from" in code) and _open(code):
                code += "\n" + w.keep()
        elif _JS_CLASS.match(code):
            _script_members(w, w.head(w.keep()), indent)
        elif _JS_SHAPE.match(code):
            code = w.keep()
            if "{" in code:
                w.body(code, indent, mark=False, keep=True)
        elif _JS_FUNCTION.match(code):
            code = w.head(w.keep(), "{;")
            if "{" in code:
                w.body(code, indent)
        elif _JS_VALUE.match(code):
            code = w.keep()
            if code.count("{") > code.count("}"):
                w.body(code, indent)
        elif _JS_EXPORT.match(code):
            w.keep()
        else:
            w.k += 1
    return "\n".join(w.out)


def _open(code: str) -> bool:
    """Whether an import goes on: a bracket is open, or the line ends before its source."""
    return code.count("{") > code.count("}") or code.count("(") > code.count(")") or code.rstrip().endswith((",", "from"))


def _script_members(w: _Walk, code: str, indent: int) -> None:
    """Methods and fields of a class, up to the brace that closes it."""
    depth = code.count("{") - code.count("}")
    while w.line and depth > 0:
        line = w.line
        own = _indent(line.text)
        if line.inside:
            w.k += 1
        elif line.text.lstrip().startswith("}"):
            depth += line.code.count("{") - line.code.count("}")
            w.keep()
        elif w.comment():
            continue
        elif own <= indent and w.declares(line.code):
            return
        elif _JS_METHOD.match(line.code):
            code = w.head(w.keep(), "{;")
            if "{" in code:
                w.body(code, own)
        elif _JS_FIELD.match(line.code):
            code = w.keep()
            w.body(code, own, mark=False)
        else:
            code = line.code
            w.k += 1
            w.body(code, own, mark=False)


def outline(source: str, language: str) -> str:
    if language == "python":
        return python_outline(source)
    if language in ("javascript", "typescript"):
        return script_outline(source, language)
    return brace_outline(source, language)

"""Chunk generators: one source file in, its chunks out.

Python is parsed with the standard library's syntax tree, HTML with its parser, JavaScript and CSS
with small scanners that know strings, comments and nesting.  A file that can't be parsed has no
chunks.  Parsing is per file, so it runs as one pass over the files without any shuffle.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import io
import re
import tokenize
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.sources.files import CHUNK

# Django's field classes, admin attributes, view methods and Meta options that are kept.
MODEL_FIELDS = ["CharField", "TextField", "IntegerField", "FloatField", "BooleanField", "DateField", "DateTimeField", "ForeignKey", "ManyToManyField", "OneToOneField", "EmailField"]
FORM_FIELDS = ["CharField", "IntegerField", "BooleanField", "ChoiceField", "EmailField", "DateField", "FileField"]
ADMIN_ATTRIBUTES = ["list_display", "list_filter", "search_fields", "readonly_fields", "exclude", "fields"]
VIEW_METHODS = ["get", "post", "put", "delete", "dispatch", "setup", "get_context_data", "get_queryset"]
META_OPTIONS = ["db_table", "verbose_name", "verbose_name_plural", "ordering", "indexes", "unique_together", "abstract", "managed"]
HTML_CHUNKS = ["div", "section", "article", "template", "main"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension, ast.match_case)


def chunk_id(*parts: object) -> str:
    return hashlib.md5("\x1f".join(map(str, parts)).encode()).hexdigest()


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


def chunk(kind: str, name: str, path: str, language: str, code: str, first: int, last: int, **more) -> dict:
    qualified = f"{stem(path)}.{name}" if kind in ("class", "function", "method") or kind.startswith("django_") else name
    given = {"docstring": None, "signature": None, "complexity": 1, "parent": None, "dependencies": [], "references": [], "defines": [], "metadata": {}} | more
    given["metadata"] = {"decorators": [], "base_classes": [], "is_async": False, "fields": {}, "meta": {}} | given["metadata"]
    return {"id": chunk_id(path, kind, qualified, first, last), "type": kind, "name": name, "qualified_name": qualified, "code": code, "file_path": path, "language": language, "start_line": first, "end_line": last} | given


# ---------------------------------------------------------------- Python


def import_map(tree: ast.AST) -> dict[str, str]:
    """What each imported name stands for."""
    out = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out |= {a.asname or a.name.split(".")[0]: a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            out |= {a.asname or a.name: f"{'.' * node.level}{node.module or ''}.{a.name}" for a in node.names if a.name != "*"}
    return out


def used(node: ast.AST, imports: dict[str, str]) -> list[str]:
    """Modules of the imported names that stand in a node, sorted."""
    names = {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}
    return sorted({imports[n].lstrip(".").split(".")[0] or n for n in names if n in imports})


def complexity(node: ast.AST) -> int:
    """1 + decision points."""
    return 1 + sum(isinstance(n, DECISIONS) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(node))


def signature(node: ast.AST) -> str:
    if isinstance(node, ast.ClassDef):
        return f"class {node.name}({', '.join(map(ast.unparse, node.bases))}):"
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)}){returns}:"


def token_count(code: str) -> int:
    """Tokens of Python code; blank-separated words of what isn't."""
    try:
        return sum(1 for _ in tokenize.generate_tokens(io.StringIO(code).readline))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return len(code.split())


def django_kind(bases: list[str]) -> str | None:
    """What a class is by its bases' names."""
    for suffix, kind in (("ModelAdmin", "django_admin"), ("Admin", "django_admin"), ("ModelForm", "django_form"), ("Form", "django_form"), ("View", "django_view"), ("Manager", "django_manager"), ("Model", "django_model")):
        if any(b.split(".")[-1] == suffix or (suffix == "View" and b.endswith("View")) for b in bases):
            return kind
    return None


def class_fields(node: ast.ClassDef, kind: str | None) -> dict[str, str]:
    """Declared fields, attributes or methods that the kind of class is known by."""
    out: dict[str, str] = {}
    for item in node.body:
        if isinstance(item, ast.Assign) and len(item.targets) == 1 and isinstance(item.targets[0], ast.Name):
            name = item.targets[0].id
            if isinstance(item.value, ast.Call) and kind in ("django_model", "django_form"):
                called = ast.unparse(item.value.func).split(".")
                known, place = (MODEL_FIELDS, "models") if kind == "django_model" else (FORM_FIELDS, "forms")
                if called[-1] in known and called[:-1] in ([], [place]):
                    args = [f"pos_{i}={ast.unparse(a)}" for i, a in enumerate(item.value.args)] + [f"{k.arg}={ast.unparse(k.value)}" for k in item.value.keywords if k.arg]
                    out[name] = f"{called[-1]}({', '.join(args)})"
            elif kind == "django_admin" and name in ADMIN_ATTRIBUTES:
                out[name] = ast.unparse(item.value)
        elif isinstance(item, ast.FunctionDef | ast.AsyncFunctionDef) and (kind == "django_manager" or (kind == "django_view" and item.name in VIEW_METHODS)):
            out[item.name] = " ".join(["method", *("@" + ast.unparse(d) for d in item.decorator_list)])
    return out


def meta_options(node: ast.ClassDef) -> dict[str, str]:
    inner = [n for n in node.body if isinstance(n, ast.ClassDef) and n.name == "Meta"]
    calls = [n for n in ast.walk(node) if isinstance(n, ast.Call) and ast.unparse(n.func) == "admin.site.register" and n.args]
    registers = {"admin_registers": ast.unparse(calls[-1].args[0])} if calls else {}
    return registers | {n.targets[0].id: ast.unparse(n.value) for m in inner for n in m.body if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name) and n.targets[0].id in META_OPTIONS}


def python_chunks(path: str, content: str) -> list[dict]:
    """Functions, methods and classes, inner ones first."""
    tree = ast.parse(content)
    imports, lines, out = import_map(tree), content.split("\n"), []
    registered = {ast.unparse(n.args[0]) for n in ast.walk(tree) if isinstance(n, ast.Call) and ast.unparse(n.func) == "admin.site.register" and n.args}

    def visit(node: ast.AST, owner: str | None) -> None:
        is_class = isinstance(node, ast.ClassDef)
        is_function = isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef)
        for child in ast.iter_child_nodes(node):
            visit(child, node.name if is_class else None if is_function else owner)
        if not is_class and not is_function:
            return
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        bases = list(map(ast.unparse, node.bases)) if is_class else []
        kind = (django_kind(bases) or "class") if is_class else "method" if owner else "function"
        fields = class_fields(node, kind) if is_class else {}
        if is_class and node.name in registered:
            fields["registered"] = "admin.site"
        text = ast.get_docstring(node, clean=False)
        names = sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)} - {node.name})
        out.append(
            chunk(
                kind,
                node.name,
                path,
                "python",
                "\n".join(lines[first - 1 : node.end_lineno]),
                first,
                node.end_lineno,
                docstring=text.strip() if text else None,
                signature=signature(node),
                complexity=complexity(node),
                parent=owner,
                dependencies=sorted({*used(node, imports), *(b.split(".")[-1] for b in bases)})[:10],
                references=names,
                defines=[node.name, *(n.name for n in node.body if is_class and isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef))],
                metadata={"decorators": ["@" + ast.unparse(d) for d in node.decorator_list], "base_classes": bases, "is_async": isinstance(node, ast.AsyncFunctionDef), "fields": fields, "meta": meta_options(node) if is_class else {}},
            )
        )

    visit(tree, None)
    return out


# ---------------------------------------------------------------- JavaScript and CSS

# comments, regular expressions (behind what can't end a value), strings
REGEX = r"(?:(?<=[=(,:;!&|?\[{\n])|(?<=return))[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[dgimsuvy]*"
BLANKED = re.compile(r"/\*.*?\*/|//[^\n]*|" + REGEX + r"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)


def blanked(code: str) -> str:
    """The code with strings and comments blanked out, all positions kept."""
    return BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


BRACES = re.compile(r"[{}()\[\]]")


def closing(code: str, at: int) -> int:
    """The place after the brace that closes the one at a place."""
    depth = 0
    for m in BRACES.finditer(code, at):
        depth += 1 if m[0] in "{([" else -1
        if depth == 0:
            return m.end()
    return len(code)


@lru_cache(maxsize=4)
def line_breaks(code: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", code)]


def line_of(code: str, at: int) -> int:
    return bisect.bisect_left(line_breaks(code), at) + 1


JS = re.compile(
    r"(?P<import>^[ \t]*import\b[^;\n]*;?)"
    r"|(?P<export>^[ \t]*export\s+(?:\{[^}]*\}|\*)[^;\n]*;?)"
    r"|\bclass\s+(?P<class>[A-Za-z_$][\w$]*)[^{]*\{"
    r"|\b(?P<async>async\s+)?function\b\s*\*?\s*(?P<function>[A-Za-z_$][\w$]*)?\s*\("
    r"|\b(?:const|let|var)\s+(?P<variable>[A-Za-z_$][\w$]*)\s*=\s*(?=[\[{]|(?:async\s*)?\([^()]*\)\s*=>|(?:async\s+)?[A-Za-z_$][\w$]*\s*=>|(?:async\s+)?function\b|class\b)",
    re.M,
)
MEMBER = re.compile(r"^[ \t]*(?:static\s+)?(?:async\s+)?(?:(?P<kind>get|set)\s+)?\*?(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:(?P<method>\()|(?P<property>=|;))", re.M)


def body_end(code: str, at: int) -> int:
    """The end of a function whose parameters begin at a place."""
    after = closing(code, at)
    brace = code.find("{", after)
    return closing(code, brace) if brace >= 0 else after


def javascript_chunks(path: str, content: str) -> list[dict]:
    code, out = blanked(content), []

    def add(kind: str, name: str, first: int, last: int, **more) -> None:
        text = content[first:last].strip("\n")
        out.append(chunk(kind, name, path, "javascript", text, line_of(content, first + len(content[first:last]) - len(content[first:last].lstrip("\n"))), line_of(content, last), signature=text.strip().split("\n")[0].strip(), **more))

    inside = 0
    for m in JS.finditer(code):
        first = m.start()
        if m["import"] or m["export"]:
            kind = "import" if m["import"] else "export"
            found = re.search(r"""['"]([^'"]+)['"]""", content[first : m.end()])
            add(kind, found[1] if found else content[first : m.end()].strip(), first, m.end(), dependencies=[found[1].split("/")[0]] if found else [])
        elif m["class"]:
            last = closing(code, m.end() - 1)
            base = re.search(r"extends\s+([\w$.]+)", m[0])
            add("class", m["class"], first, last, defines=[m["class"]], metadata={"base_classes": [base[1]] if base else []})
            members(m["class"], m.end(), last - 1, code, add)
            inside = max(inside, last)
        elif m["variable"]:
            value = code[m.end() :]
            end = m.end()
            if value[:1] in "[{":
                end = closing(code, m.end())
            elif re.match(r"(async\s+)?function\b", value):
                end = body_end(code, code.find("(", m.end()))
            elif value.startswith("class"):
                end = closing(code, code.find("{", m.end()))
            else:
                arrow = code.find("=>", m.end()) + 2
                rest = re.match(r"\s*", code[arrow:]).end() + arrow
                end = closing(code, rest) if code[rest : rest + 1] == "{" else (re.compile(r"[;\n]|\Z").search(code, rest).start())
            add("variable", m["variable"], first, end, defines=[m["variable"]])
        elif first >= inside or m["function"]:
            last = body_end(code, m.end() - 1)
            add("function" if m["function"] else "anonymous_function", m["function"] or "anonymous", first, last, defines=[m["function"]] if m["function"] else [], metadata={"is_async": bool(m["async"])})
    return out


def members(owner: str, first: int, last: int, code: str, add) -> None:
    """Methods, properties, getters and setters of a class, each once, with their class."""
    at = first
    while m := MEMBER.search(code, at, last):
        if m["method"]:
            end = body_end(code, m.end() - 1)
            if m["name"] not in ("if", "for", "while", "switch", "return"):
                add({"get": "getter", "set": "setter"}.get(m["kind"], "method"), m["name"], m.start(), end, parent=owner, defines=[m["name"]])
        else:
            end = re.compile(r"[;\n]|\Z").search(code, m.end() - 1).end()
            add("property", m["name"], m.start(), end, parent=owner)
        at = max(end, m.end())


def css_chunks(path: str, content: str) -> list[dict]:
    """Rules and at-rules, also those within others; meta tells rule sets, at-rules and keyframes apart."""
    code, out = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), content, flags=re.S), []
    head, todo = re.compile(r"[^{};]*([{;])"), [(0, len(code))]
    while todo:
        at, stop = todo.pop(0)
        while (m := head.search(code, at, stop)) is not None:
            selector = code[m.start() : m.end() - 1].strip()
            end = closing(code, m.end() - 1) if m[1] == "{" else m.end()
            if selector and (m[1] == "{" or selector.startswith("@")):
                first = m.start() + len(m[0]) - len(m[0].lstrip())
                kind = "rule_set" if selector[0] != "@" else "keyframes" if "keyframes" in selector.split()[0] else "at_rule"
                out.append(chunk("css_rule", selector, path, "css", content[first:end], line_of(content, first), line_of(content, end), metadata={"meta": {"kind": kind}}))
                if m[1] == "{" and kind != "keyframes":
                    todo.append((m.end(), end - 1))
            at = end
    return out


# ---------------------------------------------------------------- HTML and others


class Elements(HTMLParser):
    """Spans of the elements that become chunks."""

    kept: list[str] | None = HTML_CHUNKS

    def __init__(self, content: str):
        super().__init__(convert_charrefs=False)
        self.starts = [0, *(m.end() for m in re.finditer("\n", content))]
        self.open: list[tuple[str, int, str]] = []
        self.found: list[tuple[str, int, int, str]] = []
        self.feed(content)
        self.close()

    def place(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append((tag, self.place(), dict(attrs).get("id") or dict(attrs).get("class") or tag))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                name, first, label = self.open[i]
                del self.open[i:]
                if self.kept is None or name in self.kept:
                    self.found.append((name, first, self.place() + len(tag) + 3, label))
                return


def html_chunks(path: str, content: str) -> list[dict]:
    """Larger elements; the whole file if it has none."""
    out = []
    for tag, first, last, label in Elements(content).found:
        if len(content[first:last].strip()) > 50:
            out.append(chunk("html_element", label, path, "html", content[first:last], line_of(content, first), line_of(content, last), metadata={"meta": {"tag": tag}}))
    return sorted(out, key=lambda c: (c["start_line"], -c["end_line"])) or file_chunk(path, "html", content, "html_file")


def file_chunk(path: str, language: str, content: str, kind: str = "file") -> list[dict]:
    return [chunk(kind, path.rsplit("/", 1)[-1], path, language, content, 1, content.count("\n") + 1)] if content.strip() else []


PARSERS = {"python": python_chunks, "javascript": javascript_chunks, "css": css_chunks, "html": html_chunks}


FAILURES = (SyntaxError, ValueError, RecursionError)


def generated(path: str, language: str, content: str) -> list[dict]:
    """The chunks of one file; one of FAILURES is raised if it doesn't parse."""
    return PARSERS[language](path, content) if language in PARSERS else file_chunk(path, language, content)


def parsed(path: str, language: str, content: str) -> list[dict]:
    """The chunks of one file; none if it doesn't parse."""
    try:
        return generated(path, language, content)
    except FAILURES:
        return []


def failure(path: str, language: str, content: str) -> str | None:
    """Why a file doesn't parse."""
    try:
        generated(path, language, content)
    except FAILURES as error:
        return f"{type(error).__name__}: {error}"
    return None


def tree(language: str, content: str) -> list[str]:
    """The syntax tree of a Python or HTML file, a node's type on each line, indented by depth."""
    if language == "python":
        out: list[str] = []
        todo: list[tuple[ast.AST, int]] = [(ast.parse(content), 0)]
        while todo:
            node, depth = todo.pop()
            out.append("  " * depth + type(node).__name__)
            todo += [(child, depth + 1) for child in reversed(list(ast.iter_child_nodes(node)))]
        return out
    spans = [(first, last, tag) for tag, first, last in all_elements(content)] if language == "html" else []
    return ["  " * sum(a < first and last <= b for a, b, _ in spans) + tag for first, last, tag in sorted(spans)]


def all_elements(content: str) -> list[tuple[str, int, int]]:
    class Every(Elements):
        kept = None

    return [(tag, first, last) for tag, first, last, _ in Every(content).found]


def chunks(files: DataFrame) -> DataFrame:
    """The chunks of files (file_path, language, content)."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in re.split(r", (?![^<]*>)", CHUNK)]
        for part in parts:
            for row in part.itertuples(index=False):
                if found := parsed(row.file_path, row.language, row.content or ""):
                    yield pd.DataFrame(found, columns=columns)

    return files.select("file_path", "language", "content").mapInPandas(work, CHUNK)


def outcomes(files: DataFrame) -> DataFrame:
    """chunks() and errors() of files in one pass: chunks with a null error, and a row with file_path, language and error for each file that doesn't parse."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*(c.split()[0] for c in re.split(r", (?![^<]*>)", CHUNK)), "error"]
        for part in parts:
            for row in part.itertuples(index=False):
                try:
                    found = [c | {"error": None} for c in generated(row.file_path, row.language, row.content or "")]
                except FAILURES as error:
                    found = [dict.fromkeys(columns) | {"file_path": row.file_path, "language": row.language, "error": f"{type(error).__name__}: {error}"}]
                if found:
                    yield pd.DataFrame(found, columns=columns).astype(object)

    return files.select("file_path", "language", "content").mapInPandas(work, f"{CHUNK}, error string")


def errors(files: DataFrame) -> DataFrame:
    """(file_path, language, error) of the files that don't parse."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(r.file_path, r.language, e) for r in part.itertuples(index=False) if (e := failure(r.file_path, r.language, r.content or ""))]
            yield pd.DataFrame(found, columns=["file_path", "language", "error"])

    return files.select("file_path", "language", "content").mapInPandas(work, "file_path string, language string, error string")

"""The registry itself, table loading, and the table of chunks for code-only features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder: called with a name it reads one; path() says where it is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(sql: str | None = None):
    """Register a function of (load, spark) under its name; load is the Tables of the folder."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir), spark)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


KINDS = ["class", "method", "function", "css_rule", "lambda"]
CHUNK_COLUMNS = "id string, type string, name string, file_path string, language string, code string, parent string, dependencies array<string>, defines array<string>"
CHUNKS = [
    ("c01", "class", "Store", "app/models/store.py", "python", "class Store(Base):\n    pass", None, ["Base", "Reader"], ["Store"]),
    ("c02", "method", "save", "app/models/store.py", "python", "def save(self):\n    import json\n    return json.dumps(self.rows)", "Store", ["json"], ["save"]),
    ("c03", "method", "load", "app/models/store.py", "python", "def load(self):\n    for row in Reader(self.path):\n        if row: self.rows.append(row)", "Store", ["Reader"], ["load"]),
    ("c04", "function", "build", "app/core/build.py", "python", "def build(path):\n    store = Store(path)\n    return store.load()", None, ["Store", "load"], ["build"]),
    ("c05", "function", "copy_a", "app/core/a.py", "python", "def copy(x):\n    return x", None, [], ["copy"]),
    ("c06", "function", "copy_b", "app/core/b.py", "python", "def copy(x):\n    return x", None, [], ["copy"]),
    ("c07", "function", "render", "web/ui/render.js", "javascript", "function render(x) {\n  return x ? draw(x) : null;\n}", None, ["draw"], ["render"]),
    ("c08", "css_rule", ".card", "web/css/site.css", "css", ".card { color: red }", None, [], []),
    ("c09", "html_element", "div", "web/index.html", "html", "<div>hello</div>", None, [], []),
    ("c10", "macro", "odd", "tools/odd.txt", "text", "odd text", None, ["build"], []),
    ("c11", "function", "empty", "tests/test_empty.py", "python", "", None, ["build", "render"], ["empty"]),
    ("c12", "class", "Reader", "app/views/reader.py", "python", "class Reader(Store):\n    async def read(self): ...", None, ["Store"], ["Reader", "read"]),
    ("c13", "lambda", "key", "app/core/sort.py", "python", "lambda r: r.key", None, [], []),
    ("c14", "module", "core", "app/core/__init__.py", "python", "from app.core import build", None, ["build"], []),
]


def chunks(load: Tables) -> DataFrame:
    """A chunk for every document, and the few above: what a project of that size would have.

    Five chunks share a file (a class, one of its methods, others); a chunk depends on the one of half
    its number; its code is a head in its language and the document's text in ASCII.
    """
    d = F.col("doc_id")

    def numbered(head: str, number: Column, tail: str = "") -> Column:
        return F.concat(F.lit(head), number.cast("string"), F.lit(tail))

    def one_of(values: list[Column], at: Column) -> Column:
        return F.element_at(F.array(*values), (at + 1).cast("int"))

    half, bare = F.floor(d / 2), F.regexp_replace("text", r"[^ -~\n]+", " ")
    heads = {
        "python": [numbered("import m", d % 11, "\n"), numbered("from p", d % 13, ".q import r\n"), numbered("def n", d, "(x):\n"), numbered("    return n", half, "(Box(x))\n")],
        "javascript": [numbered("import A from 'lib", d % 9, "/x';\n"), numbered("function n", d, "(x) "), numbered("{ return n", half, "(x) }\n")],
        "html": [numbered('<script src="js', d % 9, '/a.js"></script>'), numbered('<link href="css', d % 5, '/s.css">')],
        "css": [numbered('@import "base', d % 9, '/a.css"; '), numbered(".a { background: url(img", d % 5, "/x.png) }")],
    }
    own = load("documents").select(
        numbered("d", d).alias("id"),
        one_of([F.lit(k) for k in KINDS], d % 5).alias("type"),
        numbered("n", d).alias("name"),
        F.concat(one_of([F.lit("tests/"), F.lit("app/models/"), F.lit("web/")], F.floor(d / 5) % 3), numbered("f", F.floor(d / 5), ".py")).alias("file_path"),
        one_of([F.lit(k) for k in heads], d % 4).alias("language"),
        F.concat(one_of([F.concat(*parts) for parts in heads.values()], d % 4), bare).alias("code"),
        F.when(d % 5 == 1, numbered("n", d - 1)).alias("parent"),
        F.when(d % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(numbered("n", half), numbered("m", d % 11))).alias("dependencies"),
        F.array(numbered("n", d), numbered("v", d)).alias("defines"),
    )
    return load.spark.createDataFrame(CHUNKS, CHUNK_COLUMNS).unionByName(own)


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql, value)) + "] :: VARCHAR[]"
    return "'" + value.replace("'", "''") + "'"


NAMES = ", ".join(c.split()[0] for c in CHUNK_COLUMNS.split(", "))
#: The same rows as a relation of DuckDB.
CHUNKS_SQL = (
    f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, row)) + ')' for row in CHUNKS)}) inline({NAMES}) UNION ALL "
    + r"""SELECT 'd' || doc_id, CASE doc_id % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'function' WHEN 3 THEN 'css_rule' ELSE 'lambda' END, 'n' || doc_id,
CASE (doc_id // 5) % 3 WHEN 0 THEN 'tests/' WHEN 1 THEN 'app/models/' ELSE 'web/' END || 'f' || (doc_id // 5) || '.py', CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'html' ELSE 'css' END,
CASE doc_id % 4 WHEN 0 THEN 'import m' || (doc_id % 11) || chr(10) || 'from p' || (doc_id % 13) || '.q import r' || chr(10) || 'def n' || doc_id || '(x):' || chr(10) || '    return n' || (doc_id // 2) || '(Box(x))' || chr(10)
WHEN 1 THEN 'import A from ''lib' || (doc_id % 9) || '/x'';' || chr(10) || 'function n' || doc_id || '(x) { return n' || (doc_id // 2) || '(x) }' || chr(10)
WHEN 2 THEN '<script src="js' || (doc_id % 9) || '/a.js"></script><link href="css' || (doc_id % 5) || '/s.css">'
ELSE '@import "base' || (doc_id % 9) || '/a.css"; .a { background: url(img' || (doc_id % 5) || '/x.png) }' END || regexp_replace(text, '[^ -~\n]+', ' ', 'g'),
CASE WHEN doc_id % 5 = 1 THEN 'n' || (doc_id - 1) END, CASE WHEN doc_id % 7 = 0 THEN [] :: VARCHAR[] ELSE ['n' || (doc_id // 2), 'm' || (doc_id % 11)] END, ['n' || doc_id, 'v' || doc_id] FROM documents) chunks"""
    + f"({NAMES})"
)

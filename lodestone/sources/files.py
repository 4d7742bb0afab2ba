"""Reading projects, chunk files, prompts and symbols; writing chunks and results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension, and what is ignored by default.
LANGUAGES = {".py": "python", ".js": "javascript", ".mjs": "javascript", ".css": "css", ".html": "html"}
IGNORED = ["__pycache__", ".git", ".venv", "venv", "node_modules", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", "coverage", "*.pyc", "*.min.js", "*.egg-info", ".idea"]

CHUNK = (
    "id string, type string, name string, qualified_name string, code string, file_path string, language string, start_line int, end_line int, docstring string, signature string, complexity int, parent string, "
    "dependencies array<string>, references array<string>, defines array<string>, metadata struct<decorators:array<string>,base_classes:array<string>,is_async:boolean,fields:map<string,string>,meta:map<string,string>>"
)
SYMBOL = "name string, path string, line int, kind string, scope string"
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def language(path: Column) -> Column:
    """The language of a path by its extension; null if it is none of ours."""
    pairs = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(pairs, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def pattern(glob: str) -> str:
    """A regular expression for one ignore pattern: anywhere in a path unless it begins with a slash."""
    glob, rooted = glob.rstrip("/"), "/" in glob.rstrip("/")
    out = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.split(r"(\*\*|\*|\?)", glob.lstrip("/")))
    return f"{'^' if rooted else '(^|/)'}{out}(/|$)"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path is ignored: the last pattern that matches decides, and ! takes a path back in."""
    rules = [p.strip() for p in patterns if p.strip() and not p.startswith("#")]
    if not any(p.startswith("!") for p in rules):
        return path.rlike("|".join(map(pattern, rules))) if rules else F.lit(False)
    out = F.lit(False)
    for p in rules:
        out = F.when(path.rlike(pattern(p.removeprefix("!"))), F.lit(not p.startswith("!"))).otherwise(out)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def gitignore(spark: SparkSession, root: str) -> list[str]:
    """The lines of the project's .gitignore; none without one.  Readers skip hidden files, so it is opened as a file."""
    path = f"{root.rstrip('/')}/.gitignore"
    if not exists(spark, path):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def project(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(file_path, language, content): the source files below root that aren't ignored, by default, by the project's .gitignore or by patterns; one scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    where = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    relative = F.regexp_replace(where, "^" + re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")) + "/", "")
    named = files.select(relative.alias("file_path"), "content").withColumn("language", language(F.col("file_path")))
    return named.filter(F.col("language").isNotNull() & ~ignored(F.col("file_path"), [*IGNORED, *gitignore(spark, root), *(patterns or [])])).select("file_path", "language", F.decode("content", "UTF-8").alias("content"))


def chunk_file(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON file (an object with a list of chunks, or a bare list), or of a folder of write_envelope()."""
    if exists(spark, f"{path}/envelope"):
        return spark.read.json(f"{path}/chunks")
    found = spark.read.option("multiLine", True).json(path)
    return found.select(F.explode("chunks").alias("c")).select("c.*") if "chunks" in found.columns else found


def embedded_file(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame | None:
    """Chunks with their embeddings from a JSON file; those without a vector (of so many dimensions) are left out; None without the file."""
    if not exists(spark, path):
        return None
    rows = chunk_file(spark, path)
    if "embedding" not in rows.columns:
        return rows.withColumn("embedding", F.array().cast("array<double>")).limit(0)
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rows.filter((F.size("embedding") == dim) if dim else (F.size("embedding") > 0))


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbols from JSON lines as tag programs write them; lines that are no symbols are left out."""
    lines = spark.read.text(path).select(F.from_json("value", SYMBOL).alias("s")).select("s.*")
    return lines.filter(F.col("name").isNotNull())


ENTRY = "file string, line int, kind string, scope string"


def symbol_index(spark: SparkSession, path: str) -> DataFrame | None:
    """(name, file, line, kind, scope) from a JSON object of names with lists of places; None without the file."""
    if not exists(spark, path):
        return None
    whole = spark.read.text(path, wholetext=True)
    named = whole.select(F.explode(F.from_json("value", f"map<string, array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>>")).alias("name", "places"))
    return named.select("name", F.explode("places").alias("p")).select("name", "p.*")


def multimap(symbols: DataFrame) -> DataFrame:
    """(name, places): all places of each symbol, in order of file and line."""
    place = F.struct(F.col("path").alias("file"), "line", "kind", "scope")
    return symbols.groupBy("name").agg(F.array_sort(F.collect_list(place)).alias("places"))


def write_symbol_index(symbols: DataFrame, path: str) -> None:
    """The multimap as JSON lines, one symbol each."""
    multimap(symbols).write.mode("overwrite").json(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, type, content): Markdown and plain files below a folder as one text each, CSV files as one text a row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("type"), F.decode("content", "UTF-8").alias("content"))
    whole = found.filter(F.col("type").isin("md", "markdown", "txt", "rst")).select(F.col("path").alias("file_path"), F.when(F.col("type").isin("md", "markdown"), "markdown").otherwise("text").alias("type"), "content")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file_path"), F.lit("csv").alias("type"), F.col("value").alias("content")).filter(F.trim("content") != "")
    return whole.unionByName(rows)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, prompt): the non-blank lines of a text file, or of all text files below a folder; seq is the number of the line in its file."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    lines = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("seq", "line"))
    return lines.select("file", (F.col("seq") + 1).cast("long").alias("seq"), F.trim("line").alias("prompt")).filter("prompt <> ''")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet by language, nested columns as they are."""
    chunks.write.mode("overwrite").partitionBy("language").parquet(path)


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: total_chunks, by_language and by_type (counts), from one pass."""
    sets = chunks.groupingSets([[], ["language"], ["type"]], "language", "type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))

    def counts(level: int, name: str) -> Column:
        own = F.collect_list(F.when((F.col("g") == level) & F.col(name).isNotNull(), F.struct(name, "n")))
        return F.map_from_entries(F.array_sort(own)).alias(f"by_{name}")

    return sets.agg(F.coalesce(F.sum(F.when(F.col("g") == 3, F.col("n"))), F.lit(0)).alias("total_chunks"), counts(1, "language"), counts(2, "type"))


def write_envelope(chunks: DataFrame, path: str, **about: str) -> None:
    """Chunks as JSON lines beside an envelope: what is said about them, and their statistics."""
    chunks.write.mode("overwrite").json(f"{path}/chunks")
    stored = chunks.sparkSession.read.schema(chunks.schema).json(f"{path}/chunks")
    row = statistics(stored).select(*[F.lit(v).alias(k) for k, v in about.items()], F.current_timestamp().cast("string").alias("generated_at"), "*")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/envelope")


def write_report(validated: DataFrame, path: str, most: int | None = 10) -> None:
    """A validation report: of the first chunks by id (all without a limit), without their vectors."""
    rows = validated.drop("embedding")
    (rows.orderBy("id").limit(most) if most else rows).write.mode("overwrite").json(path)


def save(rows: DataFrame, home: str, method: str, language: str, form: str | None = None) -> str:
    """Rows for debugging under home/method/language: flat ones as CSV, one column of text as text, else JSON; the path."""
    nested = any(kind.startswith(("array", "struct", "map")) for _, kind in rows.dtypes)
    form = form or ("json" if nested else "text" if [kind for _, kind in rows.dtypes] == ["string"] else "csv")
    path = f"{home.rstrip('/')}/{table_name(method)}/{table_name(language)}/{form}"
    write_results(rows, path, form, append=False)
    return path


def as_text(chunks: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for stores without nesting."""
    return chunks.select(*[F.to_json(name).alias(name) if kind.startswith(("array", "struct", "map")) else F.col(name) for name, kind in chunks.dtypes])


def write_results(rows: DataFrame, path: str, form: str = "json", append: bool = True) -> None:
    """Rows as JSON lines, CSV, plain text or Parquet."""
    if form not in ("json", "csv", "text", "parquet"):
        raise ValueError(f"no such form: {form}")
    flat = as_text(rows) if form == "csv" else rows
    writer = flat.write.mode("append" if append else "overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def table_name(name: str) -> str:
    """The name, if it can be a table's."""
    if not IDENTIFIER.match(name):
        raise ValueError(f"no table name: {name!r}")
    return name

"""Chunk enhancement: embedding texts, routing, symbol joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def filled(column: Column) -> Column:
    """The column, null where it is empty."""
    return F.when(column != "", column)


def joined_fields(*names: str) -> Column:
    return F.concat_ws(" ", *[filled(F.col(n)) for n in names])


def embedding_text(chunks: DataFrame) -> Column:
    """The parts of a chunk that it has, a line each; columns that chunks lack are left out."""

    def part(name: str, build) -> list[Column]:
        return [build(F.col(name))] if name in chunks.columns else []

    def listed(prefix: str, values: Column, most: int | None = None) -> Column:
        some = values if most is None else F.slice(values, 1, most)
        return F.when(F.size(values) > 0, F.concat(F.lit(prefix), F.array_join(some, ", ")))

    title = F.concat(F.lit("# "), F.upper("language"), F.lit(" "), F.upper("type"))
    if "qualified_name" in chunks.columns:
        title = F.concat(title, F.coalesce(F.concat(F.lit(": "), filled(F.col("qualified_name"))), F.lit("")))
    parts = [
        title,
        *part("context_text", lambda c: F.concat(F.lit("html/css context: "), c)),
        *part("file_hierarchy", lambda c: F.when(F.size(c) > 0, F.concat(F.lit("# Location: "), F.array_join(c, " > ")))),
        *part("domain_context", lambda c: F.concat(F.lit("# Purpose: "), filled(c))),
        *part("docstring", lambda c: F.concat(F.lit('"""'), filled(c), F.lit('"""'))),
        *part("signature", filled),
        *part("decorators", lambda c: F.when(F.size(c) > 0, F.array_join(c, "\n"))),
        F.col("code"),
        *part("dependencies", lambda c: listed("# Dependencies: ", c, 5)),
        *part("defines", lambda c: listed("# Defines: ", c)),
    ]
    return F.concat_ws("\n", *parts)


def collection(kind: Column) -> Column:
    """The collection that holds chunks of a type."""
    return F.when(kind.isin("function", "method", "lambda"), "functions").when(kind == "class", "classes").otherwise("modules")


def symbols(chunks: DataFrame) -> DataFrame:
    """(symbol, dst): what each chunk is called and defines."""
    return chunks.select(F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("defines", F.array().cast("array<string>"))))).alias("symbol"), F.col("id").alias("dst"))


def dependency_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst): a chunk and those that define one of its dependencies; equi-join on the symbol."""
    wants = chunks.select(F.col("id").alias("src"), F.explode("dependencies").alias("symbol"))
    return wants.join(symbols(chunks), "symbol").filter("src <> dst").select("src", "dst").distinct()


def children(chunks: DataFrame) -> DataFrame:
    """(id, children): of each class, the names of its members in the same file."""
    members = chunks.select(F.col("file_path").alias("f"), F.col("parent").alias("p"), F.col("name").alias("member"))
    classes = chunks.filter("type = 'class'")
    both = classes.join(members, (F.col("file_path") == F.col("f")) & (F.col("name") == F.col("p")))
    return both.groupBy("id").agg(F.array_sort(F.collect_list("member")).alias("children"))


def called_symbols(chunks: DataFrame) -> DataFrame:
    """(id, symbol): called names that the symbol index has."""
    calls = chunks.select("id", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), F.lit(1)))).alias("symbol"))
    return calls.join(symbols(chunks).select("symbol"), "symbol", "left_semi")


# Names of entry points.
ENTRY_POINTS = ["main", "__main__", "app", "application"]


def empty() -> Column:
    return F.array().cast("array<string>")


def has_lines(chunks: DataFrame) -> Column:
    """Lines of a chunk, by its places if it has them, else by its code."""
    if {"start_line", "end_line"} <= set(chunks.columns):
        return F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))
    return T.count_of(F.col("code"), "\n") + 1


def with_defaults(chunks: DataFrame) -> DataFrame:
    """chunks with docstring and signature filled in, and what their names and lines tell."""
    given = {c: F.col(c) if c in chunks.columns else F.lit(None).cast("string") for c in ("docstring", "signature")}
    return chunks.withColumns(
        {
            "docstring": F.coalesce(given["docstring"], F.lit("")),
            "signature": F.coalesce(given["signature"], T.signature_line(F.col("code"))),
            "line_count": has_lines(chunks).cast("int"),
            "has_tests": F.lower("name").contains("test"),
            "is_entry_point": F.col("name").isin(*ENTRY_POINTS),
        }
    )


def filled_in(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """chunks (id, ...) with dependencies and references found in the code where they have none; known: called_symbols() of all."""
    calls = known.groupBy(F.col("id").alias("of")).agg(F.array_sort(F.collect_set("symbol")).alias("calls"))
    own = F.col("references") if "references" in chunks.columns else empty()
    both = chunks.withColumn("references", own).join(calls, F.col("id") == F.col("of"), "left")

    def given(column: Column, found: Column) -> Column:
        return F.when(F.size(F.coalesce(column, empty())) > 0, column).otherwise(F.coalesce(found, empty()))

    return both.withColumns({"dependencies": given(F.col("dependencies"), T.dependencies(F.col("code"), F.col("language"))), "references": given(F.col("references"), F.col("calls"))}).drop("of", "calls")


def normalized(chunks: DataFrame) -> DataFrame:
    """chunks with what they lack: empty lists, a qualified name, and a context that is text as its summary."""
    out = chunks
    for name in ("dependencies", "references", "defines"):
        out = out.withColumn(name, F.coalesce(name, empty()) if name in out.columns else empty())
    own = [F.col(c) for c in ("qualified_name", "name") if c in out.columns]
    out = out.withColumn("qualified_name", F.coalesce(*own, F.lit("")))
    if dict(out.dtypes).get("context") == "string":
        out = out.withColumn("context", F.when(F.col("context").isNotNull(), F.struct(F.col("context").alias("summary"))))
    return out


# The columns of a stored payload, with what stands for missing ones.
PAYLOAD = {"id": None, "name": None, "type": None, "language": None, "file_path": None, "qualified_name": "", "code": None, "start_line": None, "end_line": None, "complexity": 0, "docstring": None, "signature": None, "dependencies": [], "embedding_quality": "unknown"}
NESTED = ["context", "metadata", "relationships", "analysis"]


def payload(chunks: DataFrame) -> DataFrame:
    """The columns that are stored beside a vector; never the vector or its text."""

    def column(name: str, default) -> Column:
        value = empty() if default == [] else F.lit(default)
        if name not in chunks.columns:
            return value.alias(name)
        return (F.col(name) if default is None else F.coalesce(F.col(name), value)).alias(name)

    return chunks.select(*[column(n, d) for n, d in PAYLOAD.items()], *[n for n in NESTED if n in chunks.columns])


def completed(chunks: DataFrame) -> DataFrame:
    """chunks with code metadata, analysis, relationships and context, in this order, as structs."""
    code, language, path = F.col("code"), F.col("language"), F.col("file_path")
    python, script = language == "python", language.isin("javascript", "typescript")
    metadata = F.struct(
        F.when(python, T.access_modifier(code)).alias("access_modifier"),
        F.when(python, T.is_abstract(code)).alias("is_abstract"),
        F.when(python, T.is_final(code)).alias("is_final"),
        F.when(script, T.export_type(code)).alias("export_type"),
        F.when(script, code.contains("async")).alias("is_async"),
    )
    analysis = F.struct(T.keyword_complexity(code).alias("complexity"), T.token_count(code).alias("token_count"), F.lit(768).alias("embedding_size"), T.semantic_hash(code).alias("semantic_hash"), has_lines(chunks).cast("int").alias("line_count"))
    context = F.struct(T.module_context(path).alias("module_context"), T.project_context(path).alias("project_context"), T.file_hierarchy(path).alias("file_hierarchy"), T.domain_context(path).alias("domain_context"))
    under = children(chunks).withColumnRenamed("id", "of")
    calls = F.when(python, F.array_distinct(T.called_functions(code))).otherwise(empty())
    references = F.coalesce("references", empty()) if "references" in chunks.columns else empty()
    both = chunks.join(under, F.col("id") == F.col("of"), "left")
    relationships = F.struct(
        T.import_lines_of(code, language).alias("imports"),
        F.coalesce("dependencies", empty()).alias("dependencies"),
        F.col("parent").alias("parent"),
        F.coalesce("children", empty()).alias("children"),
        references.alias("references"),
        calls.alias("called_functions"),
        F.coalesce("defines", empty()).alias("defined_symbols"),
    )
    kept = [c for c in chunks.columns if c not in NESTED]
    return both.select(*kept, metadata.alias("metadata"), analysis.alias("analysis"), relationships.alias("relationships"), context.alias("context"))

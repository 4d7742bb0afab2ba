"""Prompt assembly, query routing and source context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Words that send a query to the graph or to an agent.
ROUTE_WORDS = ["trace", "impact", "affect", "dependency", "related", "refactor"]
# The opening of every prompt.
INTRO = 'You are a senior Python developer who knows the codebase inside out.\nAnswer the question using ONLY the provided code snippets. If the answer isn\'t there, say "I don\'t know".'


def route(query: Column) -> Column:
    """vector for short plain questions, graph for traces and dependencies, else agent."""
    low = F.lower(query)
    plain = (T.token_count(query) <= 5) & ~T.any_of([low.contains(w) for w in ROUTE_WORDS])
    return F.when(plain, "vector").when(low.contains("trace") | low.contains("dependency"), "graph").otherwise("agent")


def rag_prompts(hits: DataFrame) -> DataFrame:
    """(query_id, prompt) from hits (query_id, query, rank, file_path, type, code); blank snippets are left out."""
    block = F.concat(F.lit("### Snippet "), F.col("rank").cast("string"), F.lit("\nFile: "), "file_path", F.lit("\nType: "), "type", F.lit("\n```python\n"), T.stripped(F.col("code")), F.lit("\n```"))
    some = F.when(T.stripped(F.col("code")) != "", F.struct("rank", block.alias("block")))
    both = hits.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(some)).alias("blocks"))
    context = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    prompt = F.concat(F.lit(INTRO + "\n\n### Relevant Code:\n"), context, F.lit("\n\n### Question:\n"), "query", F.lit("\n\n### Answer:"))
    return both.select("query_id", F.when(F.size("blocks") == 0, F.concat(F.lit("Question: "), "query", F.lit("\nAnswer: I don't know."))).otherwise(prompt).alias("prompt"))


def symbol_info(kind: Column, file: Column, line: Column) -> Column:
    return F.concat(F.initcap(kind), F.lit(" defined in "), F.element_at(F.split(file, "/"), -1), F.lit(":"), line.cast("string"))


def dependency_context(chunks: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """(id, context): the first dependencies of a chunk, with where each is defined if known."""
    first = symbols.groupBy("name").agg(F.min(F.struct("file", "line", "kind")).alias("s"))
    dep = chunks.select("id", F.posexplode(F.slice("dependencies", 1, most)).alias("at", "dep")).join(first, F.col("dep") == F.col("name"), "left")
    text = F.concat("dep", F.coalesce(F.concat(F.lit(": "), symbol_info(F.col("s.kind"), F.col("s.file"), F.col("s.line"))), F.lit("")))
    lines = dep.select("id", F.struct("at", text.alias("line")).alias("x")).groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lines.select("id", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("context"))


# What prompts say for a language and for a type of chunk.
LANGUAGE_ADVICE = {
    "python": "Focus on Python-specific patterns, Django conventions if applicable, and the object's role in the application.",
    "javascript": "Focus on JavaScript patterns, DOM manipulation if applicable, and the function's role in client-side logic.",
    "html": "Focus on the template's structure, included components, and its role in the page layout and user interface.",
    "css": "Focus on the styling rules, layout impact, and visual design role in the application.",
    "java": "Focus on Java patterns, object-oriented design, and the class/method's role in the application architecture.",
    "cpp": "Focus on C++ patterns, memory management considerations, and performance characteristics.",
    "go": "Focus on Go patterns, concurrency if applicable, and the function's role in the system.",
    "rust": "Focus on Rust patterns, ownership system, and safety characteristics.",
    None: "Focus on the code's purpose and behavior in the application.",
}
TYPE_ADVICE = {
    "class": "This is a class definition. Describe its responsibility and how it might be used.",
    "function": "This is a function. Describe what it does and its input/output behavior.",
    "method": "This is a method within a class. Describe its specific role and how it modifies object state.",
    "html_file": "This is a complete HTML template. Describe its overall structure and purpose in the UI.",
    "html_element": "This is an HTML element or component. Describe its role in the page layout.",
    "css_rule": "This is a CSS rule. Describe its styling purpose and visual impact.",
    None: "Describe the purpose and behavior of this code.",
}
# The openings and the end of summary prompts.
SUMMARY_INTRO = "You are an expert software developer specializing in {language} and web development.\nSummarize the following code chunk in one clear, concise sentence.\nFocus on its purpose, behavior, and role in the application."
DJANGO_INTRO = "You are an expert Python and Django developer.\nSummarize the following code chunk in one clear, concise sentence.\nFocus on its purpose, behavior, and role in a Django web application."
SUMMARY_END = "Summary (one sentence, no markdown, no prefix):"


def chosen(key: Column, values: dict[str | None, str]) -> Column:
    """The value of a key, or that of None."""
    pairs = F.create_map(*[F.lit(x) for k, v in values.items() if k for x in (k, v)])
    return F.coalesce(F.element_at(pairs, key), F.lit(values[None]))


def or_unknown(chunks: DataFrame, name: str, missing: str = "unknown") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(missing)) if name in chunks.columns else F.lit(missing)


def dependency_list() -> Column:
    return F.when(F.size("dependencies") > 0, F.array_join("dependencies", ", ")).otherwise("None")


def known_dependencies(chunks: DataFrame, symbols: DataFrame, most: int | None) -> DataFrame:
    """(of, details): a line for each of a chunk's (first) dependencies that the symbol index knows."""
    first = symbols.groupBy("name").agg(F.min(F.struct("file", "line", "kind")).alias("s"))
    own = F.slice("dependencies", 1, most) if most else F.col("dependencies")
    dep = chunks.select(F.col("id").alias("of"), F.posexplode(own).alias("at", "dep")).join(first.withColumnRenamed("name", "symbol"), F.col("dep") == F.col("symbol"))
    line = F.concat(F.lit("- "), "dep", F.lit(": "), symbol_info(F.col("s.kind"), F.col("s.file"), F.col("s.line")))
    lines = dep.select("of", F.struct("at", line.alias("line")).alias("x")).groupBy("of").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lines.select("of", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("details"))


def related(chunks: DataFrame) -> Column:
    """The first imports, calls and references of a chunk, or null."""
    if "relationships" not in chunks.columns:
        return F.lit(None).cast("string")
    parts = [F.when(F.size(f"relationships.{field}") > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(f"relationships.{field}", 1, 3), ", "))) for name, field in (("Imports", "imports"), ("Calls", "called_functions"), ("References", "references"))]
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def type_context(chunks: DataFrame) -> Column:
    """What a chunk's type and metadata tell."""
    base, fields = chosen(F.col("type"), TYPE_ADVICE), dict(chunks.dtypes).get("metadata", "")
    more = []
    for name, head in (("decorators", "Decorators: "), ("base_classes", "Inherits from: ")):
        if f"{name}:array" in fields:
            more.append(F.when(F.size(f"metadata.{name}") > 0, F.concat(F.lit(head), F.array_join(f"metadata.{name}", ", "))))
    if "is_abstract:boolean" in fields:
        more.append(F.when(F.col("metadata.is_abstract"), "This is an abstract class/method."))
    if "export_type:string" in fields:
        more.append(F.when(F.col("metadata.export_type") != "none", F.concat(F.lit("Export type: "), F.col("metadata.export_type"))))
    joined = F.nullif(F.concat_ws("; ", *more), F.lit("")) if more else F.lit(None).cast("string")
    return F.concat_ws(" ", base, joined)


def summary_prompts(chunks: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """(id, prompt): asks for a one-sentence summary, with domain, place, dependencies and advice by language and type."""
    both = chunks.join(known_dependencies(chunks, symbols, most), F.col("id") == F.col("of"), "left")
    path, language = F.col("file_path"), or_unknown(chunks, "language")
    blocks = F.concat_ws("\n", F.concat(F.lit("Dependency details:\n"), "details"), F.concat(F.lit("Relationships:\n"), related(chunks)))
    before, after = SUMMARY_INTRO.split("{language}")
    prompt = F.concat(
        F.lit(before), language, F.lit(f"{after}\n\nModule: "), T.module_context(path), F.lit("\nDomain: "), T.prompt_domain(path), F.lit("\nProject: "), T.project_context(path),
        F.lit("\n\nFile: "), path, F.lit("\nType: "), or_unknown(chunks, "type"), F.lit("\nName: "), or_unknown(chunks, "name"), F.lit("\nQualified Name: "), or_unknown(chunks, "qualified_name"),
        F.lit("\nLocation: Lines "), or_unknown(chunks, "start_line", "?"), F.lit("-"), or_unknown(chunks, "end_line", "?"), F.lit("\n\n"), type_context(chunks),
        F.lit("\n\nDependencies: "), dependency_list(), F.lit("\n"), F.when(blocks == "", "No additional dependency or relationship info.").otherwise(blocks),
        F.lit("\n\n"), chosen(language, LANGUAGE_ADVICE), F.lit("\n\nCode:\n```"), language, F.lit("\n"), T.stripped(F.col("code")), F.lit(f"\n```\n\n{SUMMARY_END}"),
    )
    return both.select("id", prompt.alias("prompt"))


def django_prompts(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, prompt): the summary prompt for chunks of a Django project; all known dependencies are explained."""
    both = chunks.join(known_dependencies(chunks, symbols, None), F.col("id") == F.col("of"), "left")
    path = F.col("file_path")
    prompt = F.concat(
        F.lit(f"{DJANGO_INTRO}\n\nModule: "), T.module_context(path), F.lit("\nDomain context: "), T.domain_context(path), F.lit("\nFile: "), path, F.lit("\nType: "), or_unknown(chunks, "type"),
        F.lit("\nName: "), or_unknown(chunks, "name"), F.lit("\nDependencies: "), dependency_list(), F.lit("\n\n"), F.coalesce("details", F.lit("No additional dependency info.")),
        F.lit("\n\nCode:\n```"), or_unknown(chunks, "language"), F.lit("\n"), T.stripped(F.col("code")), F.lit(f"```\n{SUMMARY_END}"),
    )
    return both.select("id", prompt.alias("prompt"))


def around(lines: Column, at: Column, reach: int) -> Column:
    """Lines from at - reach to at + reach, counted from 1."""
    first = F.greatest(at - reach, F.lit(1))
    return F.slice(lines, first, at + reach - first + 1)

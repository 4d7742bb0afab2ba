"""Queries that assemble prompts and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import prompts
from lodestone.plans.code import path_case
from lodestone.plans.search import SPLIT, CANDIDATES, candidates
from lodestone.plans.shared import CHUNKS_SQL, chunks, query
from lodestone.operators import search
from lodestone.operators.tables import stored

INTRO_SQL = prompts.INTRO.replace("'", "''")


@query(f"""WITH {CANDIDATES}, best AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM relevance) WHERE rank <= 5)
SELECT query_id, '{INTRO_SQL}' || chr(10) || chr(10) || '### Relevant Code:' || chr(10) || string_agg('### Snippet ' || rank || chr(10) || 'File: ' || source || chr(10) || 'Type: file' || chr(10) || '```python' || chr(10) ||
regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') || chr(10) || '```', chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || '### Question:' || chr(10) || b.text || chr(10) || chr(10) || '### Answer:' AS prompt
FROM best JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = query_id GROUP BY query_id, b.text""")
def rag_prompt(load, spark):
    """The prompt of each question from its five most relevant documents."""
    best = search.best(candidates(load).withColumnRenamed("relevance", "score"), 5, "query_id").select("query_id", "id", "rank")
    best = search.small(stored(best, "best"))  # five rows for each question, sent to the documents
    docs = load("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.lit("file").alias("type"), F.col("text").alias("code"))
    asked = load("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return prompts.rag_prompts(best.join(docs, "id").join(asked, "query_id"))


ROUTE_SQL = " OR ".join(f"contains(lower(text), '{w}')" for w in prompts.ROUTE_WORDS)


@query(f"""SELECT conv_id, turn, CASE WHEN len({SPLIT.format('text')}) <= 5 AND NOT ({ROUTE_SQL}) THEN 'vector' WHEN contains(lower(text), 'trace') OR contains(lower(text), 'dependency') THEN 'graph' ELSE 'agent' END AS route FROM conversations""")
def query_router(load, spark):
    """P15."""
    return load("conversations").select("conv_id", "turn", prompts.route(F.col("text")).alias("route"))


@query("""SELECT doc_id, array_to_string(list_slice(l, greatest(m - 1, 1), m + 1), chr(10)) AS context FROM (SELECT doc_id, string_split(text, chr(10)) AS l, (len(string_split(text, chr(10))) + 1) // 2 AS m FROM documents)""")
def line_context(load, spark):
    """The lines around one line, here each document's middle."""
    lines = load("documents").select("doc_id", F.split("text", "\n").alias("l"))
    return lines.select("doc_id", F.array_join(prompts.around(F.col("l"), F.floor((F.size("l") + 1) / 2).cast("int"), 1), "\n").alias("context"))


@query(f"""WITH c AS (SELECT * FROM {CHUNKS_SQL}), first AS (SELECT name, min({{'file': file_path, 'line': 1, 'kind': type}}) AS s FROM c GROUP BY name),
d AS (SELECT id, unnest(range(1, len(dependencies) + 1)) AS i, dependencies FROM c), e AS (SELECT id, i, dependencies[i] AS dep FROM d WHERE i <= 5)
SELECT id, string_agg(dep || coalesce(': ' || upper(s.kind[1]) || s.kind[2:] || ' defined in ' || string_split(s.file, '/')[-1] || ':' || s.line, ''), chr(10) ORDER BY i) AS context FROM e LEFT JOIN first ON name = dep GROUP BY id""")
def dependency_context(load, spark):
    """Where a chunk's dependencies are defined."""
    c = chunks(load)
    symbols = c.select("name", F.col("file_path").alias("file"), F.lit(1).alias("line"), F.col("type").alias("kind"))
    return prompts.dependency_context(c, symbols)


def _sql(text: str) -> str:
    """Text as a DuckDB literal, line ends included."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _chosen(column: str, values: dict) -> str:
    return f"CASE {column} {' '.join(f'WHEN {_sql(k)} THEN {_sql(v)}' for k, v in values.items() if k)} ELSE {_sql(values[None])} END"


MODULE = "CASE WHEN contains(file_path, '/') THEN string_split(file_path, '/')[-2] || ' module' ELSE 'root module' END"
PROJECT = """CASE WHEN list_contains(string_split(file_path, '/'), 'migrations') THEN 'Database changes' WHEN ends_with(file_path, '.py') THEN string_split(file_path, '/')[1] || ' Backend App'
WHEN ends_with(file_path, '.html') OR ends_with(file_path, '.css') THEN 'Project Templates' WHEN ends_with(file_path, '.js') OR ends_with(file_path, '.mjs') THEN 'Javascript Frontend' ELSE 'Project codebase' END"""
KNOWN = f"""c AS (SELECT * FROM {CHUNKS_SQL}), first AS (SELECT name, min({{'file': file_path, 'line': 1, 'kind': type}}) AS s FROM c GROUP BY name), d AS (SELECT id, unnest(range(1, len(dependencies) + 1)) AS i, dependencies FROM c),
k AS (SELECT d.id, string_agg('- ' || dependencies[i] || ': ' || upper(s.kind[1]) || s.kind[2:] || ' defined in ' || string_split(s.file, '/')[-1] || ':1', chr(10) ORDER BY i) AS details FROM d JOIN first ON name = dependencies[i] WHERE i <= 5 GROUP BY d.id)"""
DEPENDS = "CASE WHEN len(dependencies) > 0 THEN array_to_string(dependencies, ', ') ELSE 'None' END"
BARE = r"regexp_replace(code, '^\s+|\s+$', '', 'g')"


def symbols_of(c):
    return c.select("name", F.col("file_path").alias("file"), F.lit(1).alias("line"), F.col("type").alias("kind"))


@query(f"""WITH {KNOWN} SELECT c.id, {_sql(prompts.SUMMARY_INTRO.split('{language}')[0])} || language || {_sql(prompts.SUMMARY_INTRO.split('{language}')[1])} || {_sql(chr(10) * 2 + 'Module: ')} || {MODULE} || {_sql(chr(10) + 'Domain: ')} || {path_case(T.PROMPT_DOMAINS, 'General code')}
|| {_sql(chr(10) + 'Project: ')} || {PROJECT} || {_sql(chr(10) * 2 + 'File: ')} || file_path || {_sql(chr(10) + 'Type: ')} || type || {_sql(chr(10) + 'Name: ')} || name || {_sql(chr(10) + 'Qualified Name: unknown' + chr(10) + 'Location: Lines ?-?' + chr(10) * 2)} || {_chosen('type', prompts.TYPE_ADVICE)}
|| {_sql(chr(10) * 2 + 'Dependencies: ')} || {DEPENDS} || chr(10) || coalesce({_sql('Dependency details:' + chr(10))} || details, 'No additional dependency or relationship info.') || {_sql(chr(10) * 2)} || {_chosen('language', prompts.LANGUAGE_ADVICE)}
|| {_sql(chr(10) * 2 + 'Code:' + chr(10) + '```')} || language || chr(10) || {BARE} || {_sql(chr(10) + '```' + chr(10) * 2 + prompts.SUMMARY_END)} AS prompt FROM c LEFT JOIN k USING (id)""")
def summary_prompts(load, spark):
    """S3: prompts for one-sentence summaries, by language and type."""
    c = chunks(load)
    return prompts.summary_prompts(c, symbols_of(c))


@query(f"""WITH {KNOWN.replace(' WHERE i <= 5', '')} SELECT c.id, {_sql(prompts.DJANGO_INTRO + chr(10) * 2 + 'Module: ')} || {MODULE} || {_sql(chr(10) + 'Domain context: ')} || {path_case(T.INDEX_DOMAINS, 'General application code')} || {_sql(chr(10) + 'File: ')} || file_path
|| {_sql(chr(10) + 'Type: ')} || type || {_sql(chr(10) + 'Name: ')} || name || {_sql(chr(10) + 'Dependencies: ')} || {DEPENDS} || {_sql(chr(10) * 2)} || coalesce(details, 'No additional dependency info.')
|| {_sql(chr(10) * 2 + 'Code:' + chr(10) + '```')} || language || chr(10) || {BARE} || {_sql('```' + chr(10) + prompts.SUMMARY_END)} AS prompt FROM c LEFT JOIN k USING (id)""")
def django_prompts(load, spark):
    """The summary prompt for a Django project."""
    c = chunks(load)
    return prompts.django_prompts(c, symbols_of(c))

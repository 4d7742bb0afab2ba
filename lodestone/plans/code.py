"""Queries over chunks: scalar code analysis, dependencies, enhancement, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import enhance
from lodestone.plans.shared import CHUNKS_SQL, chunks, query
from lodestone.sources import tables

HTML_CHUNKS = r"""
SELECT page_id, 'html_file' AS type, url AS file_path, len(html) - len(replace(html, chr(10), '')) + 1 AS end_line, md5(html) AS content_hash
FROM pages WHERE trim(regexp_replace(html, '\s+', ' ', 'g')) <> ''
"""


def counted(needles: list[str], column: str = "text") -> str:
    """DuckDB: the sum of substring counts."""
    return " + ".join(f"(length({column}) - length(replace({column}, '{n}', ''))) // {len(n)}" for n in needles)


def worded(words: str, column: str = "text") -> str:
    """DuckDB: how many whole words are among some."""
    names = ", ".join(f"'{w}'" for w in words.split())
    return f"len(list_filter(regexp_extract_all({column}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({names})))"


@query(r"""WITH e AS (SELECT page_id, html, unnest(list_concat(regexp_extract_all(html, '(?s)<div[^>]*>.*?</div>'), regexp_extract_all(html, '(?s)<article[^>]*>.*?</article>'))) AS code FROM pages),
kept AS (SELECT page_id, code FROM e WHERE len(trim(code, E' \t\n\r')) > 50),
named AS (SELECT page_id, 'html_element' AS type, CASE WHEN regexp_matches(code, '^<[a-z]+ class="') THEN regexp_extract(code, '^<[a-z]+ class="([^"]*)"', 1) ELSE regexp_extract(code, '^<([a-z]+)', 1) END AS name, md5(code) AS hash FROM kept
UNION ALL SELECT page_id, 'html_file', string_split(url, '/')[-1], md5(html) FROM pages WHERE page_id NOT IN (SELECT page_id FROM kept) AND trim(html, E' \t\n\r') <> '')
SELECT page_id, type, name, hash, count(*) AS n FROM named GROUP BY ALL""")
def html_element_chunks(load, spark):
    """The larger elements of every page, by a table function of SQL."""
    tables.register(spark)
    found = spark.sql("SELECT p.page_id, c.type, c.name, md5(c.code) AS hash FROM {pages} p, LATERAL parse_chunks(p.url, 'html', p.html) c WHERE c.error IS NULL", pages=load("pages"))
    return found.groupBy("page_id", "type", "name", "hash").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, list_sort(regexp_extract_all(html, '(?s)<style>\s*([^{}<]*[^{}<\s])\s*\{', 1)) AS rules, list_sort(list_transform(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1), lambda s: md5(s))) AS scripts FROM pages""")
def page_sheets_and_scripts(load, spark):
    """The style rules and scripts within every page, by the same function."""
    tables.register(spark)
    parts = load("pages").select("page_id", "url", F.concat_ws("\n", F.regexp_extract_all("html", F.lit("(?s)<style>(.*?)</style>"), F.lit(1))).alias("css"), F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), F.lit(1)).alias("js"))
    rules = spark.sql("SELECT p.page_id, c.name FROM {parts} p, LATERAL parse_chunks(p.url, 'css', p.css) c WHERE c.error IS NULL", parts=parts).groupBy("page_id").agg(F.array_sort(F.collect_list("name")).alias("rules"))
    none = F.array().cast("array<string>")
    return parts.join(rules, "page_id", "left").select("page_id", F.coalesce("rules", none).alias("rules"), F.array_sort(F.transform("js", lambda s: F.md5(s))).alias("scripts"))


@query(HTML_CHUNKS)
def html_chunk_fallback(load, spark):
    """A page as one whole-file chunk, as parsers fall back to."""
    pages = load("pages").filter(T.stripped(F.col("html")) != "")
    return pages.select("page_id", F.lit("html_file").alias("type"), F.col("url").alias("file_path"), (T.count_of(F.col("html"), "\n") + 1).cast("long").alias("end_line"), T.content_hash(F.col("html")).alias("content_hash"))


@query(r"""SELECT doc_id, 'file' AS type, 1 AS start_line, length(text) - length(replace(text, chr(10), '')) + 1 AS end_line, length(text) AS n_chars
FROM documents WHERE regexp_replace(text, '\s+', '', 'g') <> ''""")
def generic_file_chunks(load, spark):
    """C20: one chunk for a whole file; blank files have none."""
    docs = load("documents").filter(T.stripped(F.col("text")) != "")
    return docs.select("doc_id", F.lit("file").alias("type"), F.lit(1).alias("start_line"), (T.count_of(F.col("text"), "\n") + 1).cast("long").alias("end_line"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src3'")
def payload_filter_eq(load, spark):
    """Conjunction of payload equalities, pushed into the scan."""
    return load("documents").filter((F.col("lang") == "en") & (F.col("source") == "src3")).select("doc_id", "lang", "source")


@query(r"""SELECT DISTINCT doc_id, t AS term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents)
WHERE length(t) BETWEEN 2 AND 15 AND t IN ('the', 'thorin', 'und', 'des', 'license')""")
def fulltext_token_match(load, spark):
    """Token match under the index's length bounds, on lower-cased tokens."""
    wanted = F.array(*map(F.lit, ("the", "thorin", "und", "des", "license")))
    found = F.array_intersect(F.filter(T.terms(F.col("text")), lambda t: F.length(t).between(2, 15)), wanted)
    return load("documents").select("doc_id", F.explode(found).alias("term"))


@query("SELECT doc_id, length(text) // 4 AS n_tokens FROM documents WHERE length(text) // 4 <= 8192")
def size_gate(load, spark):
    """Texts whose token estimate fits."""
    return load("documents").filter(T.fits(F.col("text"))).select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("n_tokens"))


@query("SELECT doc_id, md5(text) AS content_hash FROM documents")
def content_hash(load, spark):
    """E2."""
    return load("documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(r"SELECT doc_id, substr(md5(trim(regexp_replace(regexp_replace(text, '(?m)#.*$', '', 'g'), '\s+', ' ', 'g'))), 1, 10) AS semantic_hash FROM documents")
def semantic_hash(load, spark):
    """E3."""
    return load("documents").select("doc_id", T.semantic_hash(F.col("text")).alias("semantic_hash"))


@query(r"SELECT doc_id, t AS term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents) GROUP BY ALL")
def tokenize_terms(load, spark):
    """Terms of every document with their counts."""
    return load("documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(r"""SELECT lang, count(*) AS n, sum(length(text) // 4) :: BIGINT AS estimated, sum(len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> ''))) :: BIGINT AS split_tokens,
max(length(text) // 4) AS most FROM documents GROUP BY lang""")
def token_stats(load, spark):
    """Token estimates and whitespace counts by language."""
    docs = load("documents").select("lang", T.token_estimate(F.col("text")).alias("e"), T.token_count(F.col("text")).alias("s"))
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum("e").alias("estimated"), F.sum("s").alias("split_tokens"), F.max("e").cast("long").alias("most"))


@query(f"SELECT doc_id, greatest(1 + {counted(T.KEYWORDS)} + {counted(T.LOOPS)} - (length(text) - length(replace(text, 'else if', ''))) // 7, 1) AS complexity FROM documents")
def keyword_complexity(load, spark):
    """E9."""
    return load("documents").select("doc_id", T.keyword_complexity(F.col("text")).cast("long").alias("complexity"))


@query(f"SELECT doc_id, 1 + {counted(T.EXTRACTOR_KEYWORDS)} AS complexity FROM documents")
def extractor_complexity(load, spark):
    """E11."""
    return load("documents").select("doc_id", T.extractor_complexity(F.col("text")).cast("long").alias("complexity"))


@query(rf"""SELECT doc_id, CASE WHEN regexp_replace(text, '\s+', '', 'g') = '' THEN 0 ELSE {worded('def class function if else elif for while try except finally import from')}
+ len(regexp_extract_all(text, '@[\p{{L}}\p{{N}}_]+')) + {counted(['='])} - ({counted(['=='])}) - ({counted(['!='])}) + {counted(['(', '{', '['])} END AS complexity FROM documents""")
def syntax_complexity(load, spark):
    """E12."""
    return load("documents").select("doc_id", T.syntax_complexity(F.col("text")).cast("long").alias("complexity"))


@query(r"SELECT doc_id, regexp_replace(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1], '^\s+|\s+$', '', 'g') AS signature FROM documents")
def signature_line(load, spark):
    """E13."""
    return load("documents").select("doc_id", T.signature_line(F.col("text")).alias("signature"))


@query(f"""SELECT doc_id, list_filter(['language:' || lang, 'type:file', 'complexity:' || CASE WHEN c >= 10 THEN 'high' WHEN c >= 5 THEN 'medium' ELSE 'low' END,
'size:' || CASE WHEN n > 50 THEN 'large' WHEN n > 20 THEN 'medium' ELSE 'small' END, CASE WHEN contains(text, 'import ') THEN 'has_dependencies' END], lambda t: t IS NOT NULL) AS tags
FROM (SELECT doc_id, lang, text, 1 + {counted(T.EXTRACTOR_KEYWORDS)} AS c, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents)""")
def tag_chunks(load, spark):
    """E14."""
    code = F.col("text")
    found = T.tags(F.col("lang"), F.lit("file"), T.extractor_complexity(code), T.count_of(code, "\n") + 1, code.contains("import "))
    return load("documents").select("doc_id", found.alias("tags"))


@query(rf"""SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'),
lambda w: regexp_full_match(w, '[A-Z][a-zA-Z_][\p{{L}}\p{{N}}_]*') AND w NOT IN ({', '.join(f"'{w}'" for w in T.COMMON_SYMBOLS)})))) AS symbols FROM documents""")
def capitalized_symbols(load, spark):
    """E18."""
    return load("documents").select("doc_id", F.array_sort(T.capitalized_symbols(F.col("text"))).alias("symbols"))


@query(r"""SELECT page_id, list_sort(list_distinct(list_transform(list_concat(
regexp_extract_all(html, '(?i)<script[^>]*src=["'']([^"'']+)["''][^>]*>', 1), regexp_extract_all(html, '(?i)<link[^>]*href=["'']([^"'']+\.css[^"'']*)[^>]*>', 1)), lambda p: string_split(p, '/')[1]))) AS dependencies FROM pages""")
def html_dependencies(load, spark):
    """E21."""
    return load("pages").select("page_id", F.array_sort(T.html_dependencies(F.col("html"))).alias("dependencies"))


EXTRACTED = rf"""SELECT id, list_slice(list_sort(list_distinct(CASE language WHEN 'python' THEN list_concat(
  list_transform(regexp_extract_all(code, '(?m)^\s*import\s+([a-zA-Z_]\w*)', 1), lambda x: x), regexp_extract_all(code, '(?m)^\s*from\s+([a-zA-Z_]\w*)[\w.]*\s+import', 1),
  list_filter(regexp_extract_all(code, '\b[A-Z][a-zA-Z_]\w*\b'), lambda w: w NOT IN ({', '.join(f"'{w}'" for w in T.COMMON_SYMBOLS)})))
WHEN 'javascript' THEN list_concat(list_filter(list_concat(regexp_extract_all(code, '\b([A-Z]\w*)\b', 1), regexp_extract_all(code, '\b([A-Za-z_]\w*)\s*\(', 1)), lambda w: w NOT IN ({', '.join(f"'{w}'" for w in T.JS_BUILTINS)})),
  list_transform(regexp_extract_all(code, 'import [^\n'']*''([^'']+)''', 1), lambda p: string_split(p, '/')[1]))
WHEN 'html' THEN list_transform(list_concat(regexp_extract_all(code, '<script src="([^"]+)"', 1), regexp_extract_all(code, '<link href="([^"]+)"', 1)), lambda p: string_split(p, '/')[1])
WHEN 'css' THEN list_transform(list_concat(regexp_extract_all(code, '@import "([^"]+)"', 1), list_filter(regexp_extract_all(code, 'url\(([^)]+)\)', 1), lambda u: contains(u, '.'))), lambda p: string_split(p, '/')[1])
ELSE [] :: VARCHAR[] END)), 1, 10) AS dependencies FROM {CHUNKS_SQL}"""


@query(EXTRACTED)
def extracted_dependencies(load, spark):
    """Dependencies found in code, by language."""
    return chunks(load).select("id", T.dependencies(F.col("code"), F.col("language")).alias("dependencies"))


@query(rf"""SELECT id, list_filter(regexp_extract_all(code, '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1), lambda n: n NOT IN ({', '.join(f"'{w}'" for w in T.NO_CALLS)})) AS called
FROM {CHUNKS_SQL} WHERE language = 'python'""")
def called_functions(load, spark):
    """E26."""
    return chunks(load).filter("language = 'python'").select("id", T.called_functions(F.col("code")).alias("called"))


@query(rf"""WITH calls AS (SELECT DISTINCT id, unnest(regexp_extract_all(code, '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1)) AS symbol FROM {CHUNKS_SQL}),
names AS (SELECT name AS symbol FROM {CHUNKS_SQL} UNION SELECT unnest(defines) FROM {CHUNKS_SQL})
SELECT id, symbol FROM calls SEMI JOIN names USING (symbol)""")
def called_symbols(load, spark):
    """Called names that the symbol index knows."""
    return enhance.called_symbols(chunks(load))


@query(r"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
lambda x: starts_with(x, 'The ') OR starts_with(x, 'Licensed ')) AS lines FROM documents""")
def import_lines(load, spark):
    """Stripped lines that begin in one of the given ways (prose stands in for import lines)."""
    return load("documents").select("doc_id", T.import_lines(F.col("text"), ["The ", "Licensed "]).alias("lines"))


@query(f"""SELECT id, CASE WHEN starts_with(name, '__') THEN 'private' WHEN starts_with(name, '_') THEN 'protected' ELSE 'public' END AS access_modifier,
contains(code, 'abstract') OR contains(code, 'ABC') AS is_abstract, contains(code, 'final') AS is_final, contains(code, 'async ') AS is_async,
CASE WHEN contains(code, 'export default') THEN 'default' WHEN contains(code, 'export') THEN 'named' ELSE 'none' END AS export_type FROM
(SELECT id, name, code FROM {CHUNKS_SQL} UNION ALL SELECT doc_id :: VARCHAR, source, text FROM documents)""")
def code_flags(load, spark):
    """E28, E29."""
    both = chunks(load).select("id", "name", "code").unionByName(load("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.col("text").alias("code")))
    code = F.col("code")
    return both.select("id", T.access_modifier(F.col("name")).alias("access_modifier"), T.is_abstract(code).alias("is_abstract"), T.is_final(code).alias("is_final"), T.is_async(code).alias("is_async"), T.export_type(code).alias("export_type"))


def path_case(rules, otherwise: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower(file_path), '{n}')" for n in needles) + f" THEN '{name}'" for needles, name in rules)
    return f"CASE {whens} ELSE '{otherwise}' END"


@query(f"""SELECT id, {path_case(T.INDEX_DOMAINS, 'General application code')} AS domain, {path_case(T.PROMPT_DOMAINS, 'General code')} AS prompt_domain,
CASE WHEN contains(file_path, '/') THEN string_split(file_path, '/')[-2] || ' module' ELSE 'root module' END AS module_context,
CASE WHEN list_contains(string_split(file_path, '/'), 'migrations') THEN 'Database changes' WHEN ends_with(file_path, '.py') THEN string_split(file_path, '/')[1] || ' Backend App'
WHEN ends_with(file_path, '.html') OR ends_with(file_path, '.css') THEN 'Project Templates' WHEN ends_with(file_path, '.js') OR ends_with(file_path, '.mjs') THEN 'Javascript Frontend' ELSE 'Project codebase' END AS project_context
FROM (SELECT id, file_path FROM {CHUNKS_SQL} UNION ALL SELECT doc_id :: VARCHAR, source || '/' || lang FROM documents)""")
def domain_context(load, spark):
    """Contexts that follow from a path."""
    docs = load("documents").select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("/", "source", "lang").alias("file_path"))
    path = F.col("file_path")
    return chunks(load).select("id", "file_path").unionByName(docs).select("id", T.domain_context(path).alias("domain"), T.prompt_domain(path).alias("prompt_domain"), T.module_context(path).alias("module_context"), T.project_context(path).alias("project_context"))


WORDS_RE = r"[\p{L}\p{N}_]"
FEATURES = rf"""SELECT id, has_classes, has_functions, has_variables, {', '.join(T.CODE_FLAGS)},
has_classes :: INT + has_functions :: INT + has_variables :: INT + {' + '.join(f'{n} :: INT' for n in T.CODE_FLAGS)} AS structural_score, language_match, line_count, branch_words
FROM (SELECT id, regexp_matches(code, '(^|[^\p{{L}}\p{{N}}_])class\s+{WORDS_RE}') AS has_classes, regexp_matches(code, '(^|[^\p{{L}}\p{{N}}_])(def|function)\s+{WORDS_RE}') AS has_functions,
contains(code, '=') AND NOT (contains(code, '==') AND contains(code, '!=')) AS has_variables,
{', '.join('(' + ' OR '.join("contains(code, '" + n.replace("'", "''") + "')" for n in needles) + ') AS ' + name for name, needles in T.CODE_FLAGS.items())},
CASE lower(language) WHEN 'python' THEN {' + '.join(f"contains(code, '{h}') :: INT" for h in T.HINTS['python'])} >= 2
WHEN 'javascript' THEN {' + '.join(f"contains(code, '{h}') :: INT" for h in T.HINTS['javascript'])} >= 2 ELSE true END AS language_match,
len(list_filter(string_split(code, chr(10)), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) :: INT AS line_count, {worded('if for while def class', 'code')} :: INT AS branch_words
FROM (SELECT id, language, code FROM {CHUNKS_SQL} UNION ALL SELECT doc_id :: VARCHAR, lang, text FROM documents))"""


@query(FEATURES)
def code_features(load, spark):
    """E36."""
    both = chunks(load).select("id", "language", "code").unionByName(load("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("language"), F.col("text").alias("code")))
    return both.select("id", *[c.alias(name) for name, c in T.code_features(F.col("code"), F.col("language")).items()])


@query(r"""SELECT line, count(*) AS n FROM (SELECT regexp_replace(string_split(regexp_replace(l, '^\s+|\s+$', '', 'g'), '=')[1], '^\s+|\s+$', '', 'g') AS line FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents))
WHERE line NOT IN ('{', '}', '[', ']', ';', '(', ')', '.', ',', ':', '') GROUP BY line""")
def line_histogram(load, spark):
    """How often each line stands, cut at an equals sign; lone punctuation left out."""
    line = T.stripped(F.get(F.split(T.stripped(F.col("l")), "="), F.lit(0)))
    lines = load("documents").select(F.explode(F.split("text", "\n")).alias("l")).select(line.alias("line"))
    return lines.filter(~F.col("line").isin("{", "}", "[", "]", ";", "(", ")", ".", ",", ":", "")).groupBy("line").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, concat_ws(chr(10), '# ' || upper(lang) || ' FILE: ' || source || '.' || doc_id, '# Location: ' || source || ' > ' || lang, text) AS embedding_text FROM documents""")
def embedding_text(load, spark):
    """the enriched text of a chunk; absent parts leave no line."""
    docs = load("documents").select(
        "doc_id",
        F.lit("file").alias("type"),
        F.col("lang").alias("language"),
        F.concat(F.col("source"), F.lit("."), F.col("doc_id").cast("string")).alias("qualified_name"),
        F.array("source", "lang").alias("file_hierarchy"),
        F.col("text").alias("code"),
    )
    return docs.select("doc_id", enhance.embedding_text(docs).alias("embedding_text"))


@query(f"SELECT id, concat_ws(' ', nullif(name, ''), nullif(parent, ''), nullif(code, '')) AS rerank_text FROM {CHUNKS_SQL}")
def rerank_text(load, spark):
    """non-empty fields joined."""
    return chunks(load).select("id", enhance.joined_fields("name", "parent", "code").alias("rerank_text"))


@query(f"""SELECT id, CASE WHEN type IN ('function', 'method', 'lambda') THEN 'functions' WHEN type = 'class' THEN 'classes' ELSE 'modules' END AS collection FROM {CHUNKS_SQL}""")
def collection_routing(load, spark):
    """F8, H8."""
    return chunks(load).select("id", enhance.collection(F.col("type")).alias("collection"))


@query(f"""WITH c AS (SELECT * FROM {CHUNKS_SQL}), d AS (SELECT id, unnest(dependencies) AS dep FROM c), known AS (SELECT id, name AS symbol FROM c UNION SELECT id, unnest(defines) FROM c)
SELECT DISTINCT d.id AS src, k.id AS dst FROM d JOIN known k ON d.dep = k.symbol WHERE d.id <> k.id""")
def dependency_graph(load, spark):
    """G1: edges from a chunk to the chunks that define what it depends on."""
    return enhance.dependency_edges(chunks(load))


@query(f"""WITH c AS (SELECT * FROM {CHUNKS_SQL}) SELECT p.id, list_sort(list(m.name)) AS children FROM c p JOIN c m ON p.file_path = m.file_path AND m.parent = p.name WHERE p.type = 'class' GROUP BY p.id""")
def child_chunks(load, spark):
    """The members of each class, from the same file."""
    return enhance.children(chunks(load))


@query(rf"""SELECT id, '' AS docstring, regexp_replace(string_split(regexp_replace(code, '^\s+|\s+$', '', 'g'), chr(10))[1], '^\s+|\s+$', '', 'g') AS signature, (length(code) - length(replace(code, chr(10), '')) + 1) :: INT AS line_count,
contains(lower(name), 'test') AS has_tests, name IN ('main', '__main__', 'app', 'application') AS is_entry_point FROM {CHUNKS_SQL}""")
def metadata_defaults(load, spark):
    """What chunks lack, filled in from their code and names."""
    return enhance.with_defaults(chunks(load)).select("id", "docstring", "signature", "line_count", "has_tests", "is_entry_point")


@query(rf"""SELECT id, CASE WHEN language = 'python' THEN list_filter(l, lambda x: starts_with(x, 'import ') OR starts_with(x, 'from ')) WHEN language IN ('javascript', 'typescript')
THEN list_filter(l, lambda x: starts_with(x, 'import ') OR starts_with(x, 'export ') OR starts_with(x, 'require(')) ELSE [] :: VARCHAR[] END AS imports
FROM (SELECT id, language, list_transform(string_split(code, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM {CHUNKS_SQL})""")
def code_import_lines(load, spark):
    """Import lines by language."""
    return chunks(load).select("id", T.import_lines_of(F.col("code"), F.col("language")).alias("imports"))


DETECTED = r"list_sort(list_distinct(list_concat(regexp_extract_all(code, '(?:import|from)\s+([\w.]+)', 1), regexp_extract_all(code, '(\w+)\.\w+\(', 1))))"


@query(f"SELECT id, {DETECTED} AS detected FROM {CHUNKS_SQL}")
def detected_dependencies(load, spark):
    """Names that code imports or calls members of."""
    return chunks(load).select("id", T.detected_dependencies(F.col("code")).alias("detected"))


CALLS = rf"""calls AS (SELECT DISTINCT id, unnest(regexp_extract_all(code, '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1)) AS symbol FROM c), names AS (SELECT name AS symbol FROM c UNION SELECT unnest(defines) FROM c),
known AS (SELECT id, list_sort(list(symbol)) AS refs FROM calls SEMI JOIN names USING (symbol) GROUP BY id)"""


@query(f"""WITH c AS (SELECT * FROM {CHUNKS_SQL}), {CALLS}, found AS ({EXTRACTED})
SELECT c.id, CASE WHEN len(c.dependencies) > 0 THEN c.dependencies ELSE found.dependencies END AS dependencies, coalesce(refs, [] :: VARCHAR[]) AS refs FROM c JOIN found USING (id) LEFT JOIN known USING (id)""")
def filled_dependencies(load, spark):
    """dependencies and references from the code, where a chunk has none."""
    c = chunks(load)
    return enhance.filled_in(c, enhance.called_symbols(c)).select("id", "dependencies", F.col("references").alias("refs"))


@query(f"""SELECT id, name, type, language, file_path, name AS qualified_name, code, 0 AS complexity, CAST(NULL AS VARCHAR) AS docstring, CAST(NULL AS VARCHAR) AS signature,
dependencies, 'unknown' AS embedding_quality FROM {CHUNKS_SQL}""")
def payload_projection(load, spark):
    """normalised chunks as they are stored beside vectors."""
    rows = enhance.payload(enhance.normalized(chunks(load)))
    return rows.drop("start_line", "end_line").withColumns({c: F.col(c).cast("string") for c in ("docstring", "signature")})


@query(rf"""WITH c AS (SELECT * FROM {CHUNKS_SQL}), kids AS (SELECT p.id, list_sort(list(m.name)) AS children FROM c p JOIN c m ON p.file_path = m.file_path AND m.parent = p.name WHERE p.type = 'class' GROUP BY p.id)
SELECT c.id, CASE WHEN language = 'python' THEN CASE WHEN starts_with(code, '__') THEN 'private' WHEN starts_with(code, '_') THEN 'protected' ELSE 'public' END END AS access_modifier,
language = 'python' AND (contains(code, 'abstract') OR contains(code, 'ABC')) AS is_abstract, language = 'javascript' AND contains(code, 'async') AS is_async,
greatest(1 + {counted(T.KEYWORDS, 'code')} + {counted(T.LOOPS, 'code')} - (length(code) - length(replace(code, 'else if', ''))) // 7, 1) AS complexity, len(list_filter(string_split_regex(code, '\s+'), lambda t: t <> '')) AS token_count,
substr(md5(trim(regexp_replace(regexp_replace(code, '(?m)#.*$', '', 'g'), '\s+', ' ', 'g'))), 1, 10) AS semantic_hash, length(code) - length(replace(code, chr(10), '')) + 1 AS line_count,
coalesce(children, [] :: VARCHAR[]) AS children, CASE WHEN contains(file_path, '/') THEN string_split(file_path, '/')[-2] || ' module' ELSE 'root module' END AS module_context, string_split(file_path, '/') AS hierarchy
FROM c LEFT JOIN kids USING (id)""")
def chunk_completion(load, spark):
    """code metadata, analysis, relationships and context of every chunk."""
    rows = enhance.completed(chunks(load))
    analysis = [F.col(f"analysis.{c}").cast("long").alias(c) for c in ("complexity", "token_count", "line_count")]
    flags = [F.coalesce(f"metadata.{c}", F.lit(False)).alias(c) for c in ("is_abstract", "is_async")]
    return rows.select("id", "metadata.access_modifier", *flags, *analysis, "analysis.semantic_hash", "relationships.children", "context.module_context", F.col("context.file_hierarchy").alias("hierarchy"))

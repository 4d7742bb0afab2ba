"""Queries over the corpus as a store: dedup, statistics, joins with done work, incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import dedup, near, store
from lodestone.plans.shared import CHUNKS_SQL, chunks, query
from lodestone.sources import files
from lodestone.streaming import ingest, stateful


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def resumable_antijoin(load, spark):
    """What is still to do."""
    return dedup.remaining(load("documents").select("doc_id", "lang"), load("labels"), "doc_id")


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'new' END, CASE quality WHEN 1 THEN 'stored-good' WHEN 0 THEN 'stored-bad' END) AS state FROM documents LEFT JOIN labels USING (doc_id)""")
def resume_merge(load, spark):
    """New results beside stored ones, all rows kept."""
    own = load("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "new").alias("state"))
    stored = load("labels").select("doc_id", F.when(F.col("quality") == 1, "stored-good").when(F.col("quality") == 0, "stored-bad").alias("state"))
    return dedup.merged(own, stored, "doc_id", "state")


@query("""WITH d AS (SELECT doc_id, md5(text) AS h, quality FROM documents LEFT JOIN labels USING (doc_id)),
last AS (SELECT h, arg_max('quality ' || quality, doc_id) AS v FROM d WHERE quality IS NOT NULL GROUP BY h) SELECT doc_id, v AS summary FROM d LEFT JOIN last USING (h)""")
def hash_match_update(load, spark):
    """Summaries carried over to rows with the same content hash, the last one winning."""
    docs = load("documents").select("doc_id", T.content_hash(F.col("text")).alias("h"))
    source = docs.join(load("labels"), "doc_id").select("doc_id", "h", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("summary"))
    return dedup.carried(docs.withColumn("summary", F.lit(None).cast("string")), source, "h", "summary", "doc_id").select("doc_id", "summary")


@query("SELECT lang, count(*) AS n_files FROM documents GROUP BY lang")
def files_by_language(load, spark):
    """H1, A1."""
    return load("documents").groupBy("lang").agg(F.count("*").alias("n_files"))


@query("""SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))""")
def chunk_distribution(load, spark):
    """H2: two group-bys in one pass."""
    docs = load("documents").select("lang", "source")
    return docs.groupingSets([["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS total, count(*) - count(DISTINCT md5(text)) AS duplicates, count(DISTINCT md5(text)) AS enhanced, count(*) FILTER (length(text) // 4 > 8192) AS too_large FROM documents""")
def preprocess_stats(load, spark):
    """H3."""
    by_hash = load("documents").groupBy(T.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("n"), F.count_if(~T.fits(F.col("text"))).alias("large"))
    return by_hash.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("duplicates"), F.count("*").alias("enhanced"), F.coalesce(F.sum("large"), F.lit(0)).alias("too_large"))


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (value >= 0.5) AS success, count(*) FILTER (value < 0.5) AS failed, round(sum(value) / count(*), 6) AS avg_time,
round(100.0 * count(*) FILTER (value >= 0.5) / count(*), 6) AS success_rate FROM events GROUP BY event_type""")
def embed_stats(load, spark):
    """Run statistics from a log."""
    good = F.col("value") >= 0.5
    return (
        load("events")
        .groupBy("event_type")
        .agg(F.count("*").alias("total"), F.count_if(good).alias("success"), F.count_if(F.col("value") < 0.5).alias("failed"), F.round(F.sum("value") / F.count("*"), 6).alias("avg_time"), F.round(F.lit(100.0) * F.count_if(good) / F.count("*"), 6).alias("success_rate"))
    )


@query("SELECT md5(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def exact_dedup(load, spark):
    """The first row of each content."""
    docs = load("documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return dedup.first_of_each(docs, F.col("content_hash"), "doc_id").select("content_hash", "doc_id")


NEAR_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s JOIN n USING (doc_id) GROUP BY ALL),
head AS (SELECT h, min(doc_id) AS doc_id FROM sets GROUP BY h),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT doc_id FROM head) AND b.doc_id IN (SELECT doc_id FROM head) GROUP BY ALL)
SELECT a AS doc_a, b AS doc_b, round(o / (x.n + y.n - o), 6) AS jaccard FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
"""


@query(NEAR_SQL)
def near_duplicates(load, spark):
    """Pairs of different texts whose word 5-gram sets have a Jaccard similarity of 0.75 or more."""
    return near.pairs(load("documents").select("doc_id", "text"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
sets AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY doc_id)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS head FROM sets
""")
def near_duplicate_members(load, spark):
    """For each document the one that stands for its equal set in near_duplicates."""
    return near.members(load("documents").select("doc_id", "text"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS page FROM events")
def json_field(load, spark):
    """Fields of nested JSON text; bad JSON gives null."""
    return load("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


@query("SELECT label AS collection, count(*) AS points, max(len(embedding)) AS dim, 'cosine' AS distance FROM embeddings GROUP BY label")
def collection_stats(load, spark):
    """H9."""
    return load("embeddings").groupBy(F.col("label").alias("collection")).agg(F.count("*").alias("points"), F.max(F.size("embedding")).cast("long").alias("dim"), F.lit("cosine").alias("distance"))


@query("""SELECT doc_id, source, CASE WHEN source IN ('src1', 'src2') THEN 'synced' ELSE 'stored' END AS origin FROM documents WHERE NOT (source IN ('src1', 'src2') AND doc_id % 3 = 0)""")
def incremental_sync(load, spark):
    """Q8: all rows of the files in a new delivery replaced by those of the delivery."""
    docs = load("documents").select("doc_id", "source")
    news = docs.filter(F.col("source").isin("src1", "src2") & (F.col("doc_id") % 3 != 0)).withColumn("origin", F.lit("synced"))
    return dedup.synced(docs.withColumn("origin", F.lit("stored")), news, "source")


@query("""SELECT doc_id, quality, toxic, 'stored' AS origin FROM labels WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, quality, toxic, 'new' FROM labels WHERE doc_id % 2 = 0""")
def upsert_latest(load, spark):
    """Rows by key, the new ones winning."""
    labels = load("labels").select("doc_id", "quality", "toxic")
    news = labels.filter("doc_id % 2 = 0").withColumn("origin", F.lit("new"))
    return dedup.upserted(labels.withColumn("origin", F.lit("stored")), news, "doc_id")


@query("SELECT doc_id, 'first' AS origin FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'second' FROM labels WHERE doc_id % 2 = 1")
def insert_or_ignore(load, spark):
    """New keys are added, known ones ignored."""
    labels = load("labels").select("doc_id")
    return dedup.inserted(labels.filter("doc_id % 2 = 0").withColumn("origin", F.lit("first")), labels.withColumn("origin", F.lit("second")), "doc_id")


@query("SELECT md5(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1")
def streaming_dedup(load, spark):
    """A file stream of documents, counted by content hash; the whole table is one run of the stream."""
    return ingest.counted_by_hash(spark, load.path("documents"))


@query("SELECT DISTINCT md5(text) AS content_hash FROM documents")
def streaming_first_seen(load, spark):
    """Each content once, by deduplication within the stream."""
    return ingest.different(spark, load.path("documents"))


@query("SELECT md5(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def streaming_keep_first(load, spark):
    """The first document of each content, by custom state that is found again when the query starts anew."""
    return stateful.first_of_each_content(spark, load.path("documents"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def streaming_windows(load, spark):
    """Event-time windows over the log, with a watermark."""
    return ingest.windowed(spark, load.path("events"))


@query(f"""SELECT language, type, count(*) AS n FROM {CHUNKS_SQL} GROUP BY language, type""")
def chunk_statistics(load, spark):
    """H2, B1: the statistics of a chunk file."""
    return chunks(load).groupBy("language", "type").agg(F.count("*").alias("n"))


@query(f"""SELECT name, list_sort(list(file_path || ':' || kind)) AS places FROM (SELECT name, file_path, type AS kind FROM {CHUNKS_SQL}) GROUP BY name""")
def symbol_multimap(load, spark):
    """All places of each symbol."""
    own = chunks(load).select("name", F.col("file_path").alias("path"), F.lit(1).alias("line"), F.col("type").alias("kind"), F.col("parent").alias("scope"))
    return files.multimap(own).select("name", F.array_sort(F.transform("places", lambda p: F.concat(p["file"], F.lit(":"), p["kind"]))).alias("places"))


@query("""WITH l AS (SELECT event_type, CASE event_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'index' ELSE 'query' END AS kind, value AS seconds, value >= 0.5 AS ok, user_id AS n FROM events),
s AS (SELECT event_type, count(*) FILTER (kind = 'search') AS searches, sum(seconds) FILTER (kind = 'search') AS searched, sum(n) FILTER (kind = 'index') AS indexed, sum(seconds) FILTER (kind = 'index') AS indexing,
count(*) FILTER (kind = 'index' AND NOT ok) AS errors, count(*) FILTER (kind = 'query') AS asked, count(*) FILTER (kind = 'query' AND ok) AS answered FROM l GROUP BY event_type)
SELECT event_type, searches AS searches_performed, round(coalesce(searched, 0), 6) AS search_time_total, round(coalesce(searched / nullif(searches, 0), 0), 6) AS average_search_time, coalesce(indexed, 0) :: BIGINT AS chunks_indexed,
round(coalesce(indexing / nullif(indexed, 0), 0), 6) AS average_indexing_time, errors AS indexing_errors, round(coalesce(answered / nullif(asked, 0), 0), 6) AS query_success_rate FROM s""")
def performance_report(load, spark):
    """Figures of a log of searches, indexing and queries."""
    kind = F.element_at(F.array(F.lit("search"), F.lit("index"), F.lit("query")), (F.col("event_id") % 3 + 1).cast("int"))
    log = load("events").select("event_type", kind.alias("kind"), F.col("value").alias("seconds"), (F.col("value") >= 0.5).alias("ok"), F.col("user_id").alias("n"))
    return store.performance(log, "event_type")


@query("""WITH p AS (SELECT DISTINCT source AS project, length(source) % 4 + 1 AS done FROM documents), steps(nth, step) AS (VALUES (0, 'parsed'), (1, 'preprocessed'), (2, 'embedded'), (3, 'indexed'))
SELECT project, step, nth FROM p, steps WHERE nth >= done""")
def pipeline_pending(load, spark):
    """The steps that each project still has to run."""
    projects = load("documents").select(F.col("source").alias("project")).distinct()
    control = projects.select("project", F.posexplode(F.array(*map(F.lit, store.STEPS))).alias("nth", "step")).select("project", "step", (F.col("nth") < F.length("project") % 4 + 1).alias("done"))
    return store.pending(control, projects)


@query("""SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS with_embedding, count(*) AS total, count(*) FILTER (l.doc_id IS NULL) AS to_embed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def embedding_progress(load, spark):
    """Q5: how many rows are done."""
    return store.progress(load("documents").select("doc_id"), load("labels").select("doc_id").distinct(), "doc_id")


@query("""SELECT doc_id, doc_id % 10 <> 0 AS good, CASE WHEN doc_id % 10 = 0 THEN [] ELSE [doc_id, 1.5] :: DOUBLE[] END AS embedding FROM documents""")
def stored_embeddings(load, spark):
    """Q3, Q4: vectors from JSON text; text that is none gives null."""
    d = F.col("doc_id")
    rows = load("documents").select("doc_id").withColumn("embedding", F.when(d % 20 == 0, "[1.5, oops").when(d % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("["), d.cast("string"), F.lit(", 1.5]"))))
    found = store.parsed_vectors(store.with_column(rows, "embedding", "string"))
    return found.select("doc_id", F.col("embedding").isNotNull().alias("good"), F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"))


@query(f"""SELECT count(*) AS total_chunks, count(DISTINCT language) AS languages, count(DISTINCT type) AS types, count(*) FILTER (language = 'python') AS python_chunks FROM {CHUNKS_SQL}""")
def envelope_statistics(load, spark):
    """The statistics in the envelope of a chunk file."""
    row = files.statistics(chunks(load))
    return row.select("total_chunks", F.size("by_language").cast("long").alias("languages"), F.size("by_type").cast("long").alias("types"), F.element_at("by_language", "python").alias("python_chunks"))

"""A project's tables as a store: states of its steps, catalog, schema changes, stored vectors, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from lodestone.operators import dedup

# The steps of the whole pipeline, in order.
STEPS = ["parsed", "preprocessed", "embedded", "indexed"]


def states(spark: SparkSession) -> DataFrame:
    """A control table (project, step, done) without rows."""
    return spark.createDataFrame([], "project string, step string, done boolean")


def marked(control: DataFrame, project: str, step: str, done: bool = True) -> DataFrame:
    """The control table with one step's state set."""
    if step not in STEPS:
        raise ValueError(f"no such step: {step}")
    news = control.sparkSession.createDataFrame([(project, step, done)], "project string, step string, done boolean")
    return control.join(news.select("project", "step"), ["project", "step"], "left_anti").unionByName(news)


def pending(control: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, step, nth) of the steps that projects (project) still have to run, in order."""
    steps = projects.select("project").distinct().select("project", F.posexplode(F.array(*map(F.lit, STEPS))).alias("nth", "step"))
    return steps.join(control.filter("done"), ["project", "step"], "left_anti").select("project", "step", "nth")


def matching(ours: list[str], theirs: list[str]) -> list[str]:
    """Names of tables that two catalogs have in common."""
    return sorted(set(ours) & set(theirs))


def with_column(df: DataFrame, name: str, kind: DataType | str) -> DataFrame:
    """df with a column of nulls, unless it has it."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def parsed_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """df with vectors read from JSON text; bad or missing text gives null."""
    return df.withColumn(column, F.from_json(column, "array<double>", {"mode": "PERMISSIVE"}))


def progress(chunks: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """One row: with_embedding, total, to_embed."""
    left = dedup.remaining(chunks.select(key), done, key).agg(F.count("*").alias("to_embed"))
    return chunks.agg(F.count("*").alias("total")).join(F.broadcast(left)).select((F.col("total") - F.col("to_embed")).alias("with_embedding"), "total", "to_embed")


def performance(log: DataFrame, *by: str) -> DataFrame:
    """Figures of a log (kind: search, index or query; seconds; ok; n): totals, averages and the share of queries that were answered."""

    def of(kind: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))

    searches, asked = of("search", F.lit(1)), of("query", F.lit(1))
    figures = {
        "searches_performed": searches,
        "search_time_total": F.round(of("search", F.col("seconds")), 6),
        "average_search_time": F.round(F.coalesce(of("search", F.col("seconds")) / F.nullif(searches, F.lit(0)), F.lit(0.0)), 6),
        "chunks_indexed": of("index", F.col("n")),
        "average_indexing_time": F.round(F.coalesce(of("index", F.col("seconds")) / F.nullif(of("index", F.col("n")), F.lit(0)), F.lit(0.0)), 6),
        "indexing_errors": of("index", F.when(F.col("ok"), 0).otherwise(1)),
        "query_success_rate": F.round(F.coalesce(of("query", F.col("ok").cast("int")) / F.nullif(asked, F.lit(0)), F.lit(0.0)), 6),
    }
    return log.groupBy(*by).agg(*[c.alias(name) for name, c in figures.items()])

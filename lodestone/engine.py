"""The pipeline as an API: ingest, preprocess, embed, validate, index, retrieve, enrich; each step reads and writes tables."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import dedup, enhance, prompts, providers, rerank, search, store, validate
from lodestone.operators.tables import stored
from lodestone.sources import files, parse

TABLES = ("chunks", "symbols", "prepared", "embedded", "points", "enriched")


@dataclass(frozen=True)
class Settings:
    """Where a project's tables are, and the limits of its steps."""

    home: str
    dim: int = 64
    most_tokens: int = 8192
    ignored: list[str] = field(default_factory=list)
    least_quality: float = 0.1
    dense_weight: float = 1.0
    sparse_weight: float = 1.0
    dense_prefetch: int = 50
    sparse_prefetch: int = 30
    prefix: str = ""

    def path(self, table: str) -> str:
        return f"{self.home.rstrip('/')}/{table}"

    def saved(self) -> str:
        """The settings as JSON."""
        return json.dumps(dataclasses.asdict(self), indent=2)

    @classmethod
    def loaded(cls, text: str, **changes) -> Settings:
        """Settings from JSON; unknown names are ignored."""
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**({k: v for k, v in json.loads(text).items() if k in known} | changes))

    @classmethod
    def from_env(cls, home: str, prefix: str = "LODESTONE_") -> Settings:
        """Settings with the numbers and words that the environment gives."""
        given = {f.name: os.environ[prefix + f.name.upper()] for f in dataclasses.fields(cls) if prefix + f.name.upper() in os.environ and f.name not in ("home", "ignored")}
        kinds = {"int": int, "float": float, "str": str}
        return cls(home, **{f.name: kinds[f.type](given[f.name]) for f in dataclasses.fields(cls) if f.name in given})


class Engine:
    """One project."""

    def __init__(self, spark: SparkSession, settings: Settings, embed: providers.Embed | None = None, generate: providers.Generate = providers.echo, score: providers.Score | None = None):
        self.spark, self.settings = spark, settings
        self.embed_texts, self.generate, self.score = embed or providers.hashed_embedding(settings.dim), generate, score

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.settings.path(name))

    def exists(self, name: str) -> bool:
        return files.exists(self.spark, self.settings.path(name))

    # ------------------------------------------------------------ steps

    def ingest(self, root: str) -> DataFrame:
        """Parse the project's files into chunks; symbols and files that don't parse are tables beside them."""
        found = files.project(self.spark, root, self.settings.ignored)
        parsed = stored(parse.outcomes(found), "parsed")
        parsed.filter(F.col("error").isNull()).drop("error").write.mode("overwrite").parquet(self.settings.path("chunks"))
        parsed.filter(F.col("error").isNotNull()).select("file_path", "language", "error").write.mode("overwrite").parquet(self.settings.path("parse_errors"))
        chunks = self.table("chunks")
        names = chunks.select(F.explode(F.array_distinct(F.concat(F.array("name"), "defines"))).alias("name"), F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.col("type").alias("kind"), F.col("parent").alias("scope"))
        names.write.mode("overwrite").parquet(self.settings.path("symbols"))
        return self.mark("parsed", chunks)

    def parse_file(self, path: str, content: str) -> list[dict]:
        """The chunks of one file."""
        language = {s: name for s, name in files.LANGUAGES.items()}.get("." + path.rsplit(".", 1)[-1].lower(), "text")
        return parse.parsed(path, language, content)

    def preprocess(self) -> DataFrame:
        """First chunk of each content, completed, with its embedding text, if that fits."""
        chunks = enhance.normalized(self.table("chunks"))
        chunks = enhance.filled_in(chunks, enhance.called_symbols(chunks))
        rows = chunks.withColumn("file_hierarchy", T.file_hierarchy(F.col("file_path"))).withColumn("domain_context", T.domain_context(F.col("file_path")))
        first = dedup.first_of_each(rows, T.content_hash(F.col("code")), "id")
        rich = first.withColumn("embedding_text", enhance.embedding_text(first)).withColumn("collection", enhance.collection(F.col("type")))
        rich.filter(T.fits(F.col("embedding_text"), self.settings.most_tokens)).write.mode("overwrite").parquet(self.settings.path("prepared"))
        return self.mark("preprocessed", self.table("prepared"))

    def embed(self) -> DataFrame:
        """Embed what isn't embedded yet, and append what passes the gate."""
        todo = self.table("prepared").filter(F.trim("embedding_text") != "")
        if self.exists("embedded"):
            todo = dedup.remaining(todo, self.table("embedded"), "id")
        rows = validate.ready(providers.embedded(todo, "embedding_text", self.embed_texts))
        good = rows.filter(validate.gate(self.settings.dim) == "Valid embedding").drop("v", "mean", "variance", "norm", "entropy")
        good.write.mode("append").parquet(self.settings.path("embedded"))
        return self.mark("embedded", self.table("embedded"))

    def validate(self, report: str | None = None, most: int | None = 10) -> DataFrame:
        """All embedded chunks with the scores of the six validators; a report of the first ones."""
        rows = validate.validated(self.table("embedded"), self.settings.dim)
        if report:
            files.write_report(rows.select("id", "embedding", "overall", "passed", "scores", "rejection_reasons", "recommendations"), report, most)
        return rows

    def index(self) -> DataFrame:
        """Append what is embedded, and embed what isn't, to its collection."""
        return self.upload(self.embed())

    def index_embedded(self, path: str) -> DataFrame | None:
        """Append chunks that come with their embeddings; None without the file."""
        rows = files.embedded_file(self.spark, path, self.settings.dim)
        if rows is None:
            return None
        return self.upload(rows if "collection" in rows.columns else rows.withColumn("collection", enhance.collection(F.col("type"))))

    def upload(self, rows: DataFrame) -> DataFrame:
        new = dedup.remaining(rows, self.table("points"), "id") if self.exists("points") else rows
        new.write.mode("append").partitionBy("collection").parquet(self.settings.path("points"))
        return self.mark("indexed", self.table("points"))

    def hybrid_setup(self) -> DataFrame:
        """The BM25 index of all points, written beside them for hybrid search."""
        search.counted(self.bodies(self.table("points"))).write.mode("overwrite").parquet(self.settings.path("terms"))
        return self.table("terms")

    def enrich(self, django: bool = False) -> DataFrame:
        """Points with a one-sentence summary from the language model; done ones are kept."""
        chunks = self.table("points").drop("embedding")
        if self.exists("enriched"):
            chunks = dedup.remaining(chunks, self.table("enriched"), "id")
        symbols = self.table("symbols").withColumnRenamed("path", "file")
        asked = (prompts.django_prompts if django else prompts.summary_prompts)(chunks, symbols)
        providers.generated(asked, "prompt", self.generate, "summary").write.mode("append").parquet(self.settings.path("enriched"))
        return self.table("enriched")

    def batch(self, path: str, out: str, form: str = "json") -> DataFrame:
        """Answers to the prompts in text files, written as JSON lines, CSV, text or Parquet."""
        found = providers.answered(files.prompts(self.spark, path), self.generate)
        files.write_results(found, out, form)
        return found

    def run(self, root: str) -> list[str]:
        """The steps of the whole pipeline that are still to do; their names."""
        steps: dict[str, Callable[[], object]] = {"parsed": lambda: self.ingest(root), "preprocessed": self.preprocess, "embedded": self.embed, "indexed": self.index}
        project = self.spark.createDataFrame([(self.settings.home,)], "project string")
        todo = [r["step"] for r in store.pending(self.states(), project).orderBy("nth").collect()]
        for step in todo:
            steps[step]()
        return todo

    # ------------------------------------------------------------ states and health

    def states(self) -> DataFrame:
        return self.table("states") if self.exists("states") else store.states(self.spark)

    def mark(self, step: str, out: DataFrame) -> DataFrame:
        """Note that a step is done; its result."""
        control = store.marked(self.states(), self.settings.home, step)
        rows = [tuple(r) for r in control.collect()]  # a row for each step of this project
        self.spark.createDataFrame(rows, control.schema).write.mode("overwrite").parquet(self.settings.path("states"))
        return out

    def health(self) -> dict[str, int]:
        """Rows of each table that is there."""
        return {name: self.table(name).count() for name in TABLES if self.exists(name)}

    def providers_health(self) -> dict[str, bool]:
        """Whether each provider answers."""

        def answers(call: Callable[[], object]) -> bool:
            try:
                return bool(call())
            except Exception:  # whatever a service raises, it isn't there
                return False

        return {"embed": answers(lambda: len(self.embed_texts(["ping"])[0]) == self.settings.dim), "generate": answers(lambda: self.generate(["ping"])), "score": self.score is not None and answers(lambda: self.score([("ping", "ping")]))}

    # ------------------------------------------------------------ questions

    @staticmethod
    def bodies(points: DataFrame) -> DataFrame:
        return points.select("id", F.concat_ws("\n", "code", "docstring", "qualified_name", "signature").alias("text"))

    def terms(self, points: DataFrame) -> DataFrame:
        """The written BM25 index of these points, or one made now."""
        if self.exists("terms"):
            return self.table("terms").join(points.select("id"), "id", "left_semi")
        return search.index(self.bodies(points))

    def retrieve(self, questions: list[str], most: int = 10, collection: str | None = None, sparse: bool = True, **filters) -> DataFrame:
        """(query_id, id, relevance, semantic, score, rank): hybrid search, then the reranker.

        How many candidates each leg fetches follows from the number of points; without the sparse leg
        (or if it fails) the dense one stands alone.  collection: part of the names of collections.
        """
        asked = self.spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(zip(questions, self.embed_texts(questions), strict=True))], "query_id long, text string, query array<double>")
        points = self.table("points").filter(search.filters(**filters))
        points = points.filter(F.col("collection").contains(collection)) if collection else points
        many = points.count()
        legs = [(search.dense(points.select("id", F.col("embedding").alias("vector")), asked.select("query_id", "query"), search.prefetch(many, most, self.settings.dense_prefetch)), self.settings.dense_weight)]
        if sparse:
            try:
                legs.append((stored(search.sparse(self.terms(points), asked.select("query_id", "text"), search.prefetch(many, most, self.settings.sparse_prefetch)), "sparse"), self.settings.sparse_weight))
            except Exception as error:  # search goes on with what works
                print(f"dense search only: {error}")
        pairs = stored(search.fused(legs, max(50, most)).select("query_id", "id"), "hits")
        body = points.select("id", enhance.joined_fields("qualified_name", "name", "docstring", "code", "signature").alias("text"))
        hits = rerank.relevances(pairs, asked.select("query_id", "text"), body)
        both = hits.join(points.select("id", "embedding"), "id").join(asked.select("query_id", F.col("query").alias("vector")), "query_id")
        scored = both.select("query_id", "id", "relevance", F.round(V.cosine(F.col("embedding"), F.col("vector")), 6).alias("semantic"))
        ranked = rerank.reranked(scored, self.settings.least_quality).filter(F.col("rank") <= most)
        if self.score is None:
            return ranked
        texts = ranked.join(body, "id").join(asked.select("query_id", F.col("text").alias("query")), "query_id")
        crossed = providers.cross_encoded(texts, self.score).drop("query", "text", "rank")
        return search.best(crossed, most, "query_id", score="cross_score")

    def prompts(self, questions: list[str], most: int = 5) -> DataFrame:
        """(query_id, prompt) of each question, from what it retrieves."""
        hits = self.retrieve(questions, most).select("query_id", "id", "rank")
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
        return prompts.rag_prompts(hits.join(self.table("points").select("id", "file_path", "type", "code"), "id").join(asked, "query_id"))

    def answer(self, questions: list[str], most: int = 5) -> DataFrame:
        return providers.generated(self.prompts(questions, most), "prompt", self.generate)

"""A training-corpus pipeline over ``documents``, in five stages.

Each stage is a function of (spark, docs, sf_dir) over all that the stage before kept; its result is
written as Parquet and read again as the next one's docs.  All but the last return the columns of
documents.  The token shards stay where the session's ``spark.lodestone.output.dir`` says, in a new
folder of each run; where it is unset they go when the driver ends.

Defined cases, in each stage: an empty table gives an empty one; columns beside those of documents go
through as they are, whatever they are called; a text that is null or empty goes with the language
stage; repeated rows become one in the join; documents with a null doc_id are told apart by their text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, language_id, mixing, ngram_join, token_shards
from lodestone.llm.shared import shared_table, temporary

REMEMBERED = 100_000  # parts of words that a worker's encoder keeps: workers go on to other stages with them
LEAST_SCORE = 0.5  # below it no language is likelier than all others together
OUTPUT = "spark.lodestone.output.dir"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of no likely one, go; a null lang becomes the predicted one."""
    tag = "_".join(["tag", *docs.columns])  # no column of docs can be called so
    tagged = language_id.tagged(docs, language_id.learned(docs), (f"{tag}_lang", f"{tag}_score"))
    known = (F.col(f"{tag}_lang") != language_id.UNKNOWN) & (F.col(f"{tag}_score") >= LEAST_SCORE)
    found = F.coalesce("lang", F.col(f"{tag}_lang")).alias("lang")
    return tagged.filter(known).select(*[found if c == "lang" else c for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too much of a benchmark item go."""
    return decontamination.without_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards; what the files hold of each document."""
    from lodestone.llm.queries import vocabulary

    place = spark.conf.get(OUTPUT, None)
    folder = place and f"{place.rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return token_shards.export(docs, vocabulary(), folder=folder, remembered=REMEMBERED)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token shards", write_tokens),
]
#: Learned language models and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; what a stage writes besides its result goes when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark):  # the results of all stages but the last go at the end
        for i, (_, stage) in enumerate(STAGES):
            with temporary(spark):
                docs = shared_table(stage(spark, docs, sf_dir), f"stage-{i}", outer=2 if i + 1 == len(STAGES) else 1)
    return docs

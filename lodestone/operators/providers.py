"""Models behind small protocols; the defaults work offline and give the same result every time."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
Generate = Callable[[list[str]], list[str]]
Score = Callable[[list[tuple[str, str]]], list[float]]
Count = Callable[[list[str]], list[int]]
FAILED = "Context generation failed."


def hashed_embedding(dim: int = 64) -> Embed:
    """Feature hashing of words, made unit length; a blank text has the zero vector."""

    def one(text: str) -> list[float]:
        v = [0.0] * dim
        for word in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v] if size else v

    return lambda texts: [one(t or "") for t in texts]


def echo(texts: list[str]) -> list[str]:
    """The first line of each prompt."""
    return [(t or "").split("\n")[0] for t in texts]


@dataclass(frozen=True)
class Client:
    """What a service needs to know; providers of services are made from it."""

    url: str = ""
    model: str = ""
    provider: str = "ollama"
    temperature: float = 0.3
    most_tokens: int = 256
    timeout: int = 30
    tries: int = 3

    def __post_init__(self):
        if self.provider not in ("ollama", "openai"):  # an unknown provider falls back to the first
            object.__setattr__(self, "provider", "ollama")


def retried(call: Callable, tries: int = 3, wait: float = 1.0, errors: tuple[type[Exception], ...] = (OSError, TimeoutError)) -> Callable:
    """call, tried again after a network error, after 1, 2, 4 ... times wait seconds; the last error is raised."""

    def again(*args):
        for k in range(tries):
            try:
                return call(*args)
            except errors:
                if k + 1 == tries:
                    raise
                time.sleep(wait * 2**k)

    return again


def overlap_score(pairs: list[tuple[str, str]]) -> list[float]:
    """The offline cross-encoder: cosine of the word sets of query and text."""

    def one(a: set[str], b: set[str]) -> float:
        return len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0

    return [one(set(re.findall(r"\w+", (q or "").lower())), set(re.findall(r"\w+", (t or "").lower()))) for q, t in pairs]


def cross_encoded(pairs: DataFrame, score: Score | None = overlap_score, batch: int = 32) -> DataFrame:
    """pairs (query, text, ...) with a model's score of each (cross_score); without a model null, so fusion leaves it out."""
    if score is None:
        return pairs.withColumn("cross_score", F.lit(None).cast("double"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own, out = list(zip(part["query"], part["text"], strict=True)), []
            for i in range(0, len(own), batch):
                out += score(own[i : i + batch])
            yield part.assign(cross_score=[float(x) for x in out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(work, f"{schema}, cross_score double")


def estimated(texts: list[str]) -> list[int]:
    """A token for four characters."""
    return [len(t or "") // 4 for t in texts]


def tokenizer_count(path: str) -> Count:
    """Counts by a tokenizer's vocabulary file; it is read once by each worker."""
    held: list = []

    def count(texts: list[str]) -> list[int]:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return [len(e.ids) for e in held[0].encode_batch([t or "" for t in texts], add_special_tokens=False)]

    return count


def token_counts(rows: DataFrame, text: str, counts: dict[str, Count]) -> DataFrame:
    """rows with a column of token counts for each named model."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(**{name: count(part[text].tolist()) for name, count in counts.items()})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(work, ", ".join([schema, *(f"`{name}` long" for name in counts)]))


class PromptFailed(RuntimeError):
    """A prompt that the provider could not answer."""


def answered(prompts: DataFrame, generate: Generate, delay: float = 0.0) -> DataFrame:
    """prompts (prompt, ...) with their responses, one after another in each task; the first failure stops the run."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for prompt in part["prompt"]:
                try:
                    out.append(generate([prompt])[0].strip())
                except Exception as error:
                    raise PromptFailed(f"Error processing prompt: {error}") from error
                time.sleep(delay)
            yield part.assign(response=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(work, f"{schema}, response string")


def embedded(rows: DataFrame, text: str, embed: Embed, column: str = "embedding") -> DataFrame:
    """rows with the embedding of a text column; batches go to the provider as Arrow brings them."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(**{column: embed(part[text].tolist())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column)
    return rows.drop(column).mapInPandas(work, f"{schema}, `{column}` array<double>")


def generated(rows: DataFrame, prompt: str, generate: Generate, column: str = "response", batch: int = 4) -> DataFrame:
    """rows with the provider's answers, asked in small batches; a batch that fails gets FAILED."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[str] = []
            asked = part[prompt].tolist()
            for i in range(0, len(asked), batch):
                try:
                    out += generate(asked[i : i + batch])
                except Exception:  # whatever a provider raises, the row says so
                    out += [FAILED] * len(asked[i : i + batch])
            yield part.assign(**{column: out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column)
    return rows.drop(column).mapInPandas(work, f"{schema}, `{column}` string")

"""python -m lodestone HOME COMMAND [ARGUMENTS]

ingest ROOT | preprocess | embed | validate_embeddings [REPORT] | index | index_embedded FILE | hybrid_setup |
enrich | batch PROMPTS OUT | run ROOT | rag QUESTION... | advanced_rag QUESTION... | ask QUESTION... | health | api [PORT]
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import SparkSession

from lodestone import server
from lodestone.engine import Engine, Settings


def rows(table) -> int | None:
    return None if table is None else table.count()


COMMANDS: dict[str, Callable[[Engine, list[str]], object]] = {
    "ingest": lambda engine, rest: rows(engine.ingest(rest[0])),
    "preprocess": lambda engine, rest: rows(engine.preprocess()),
    "embed": lambda engine, rest: rows(engine.embed()),
    "validate_embeddings": lambda engine, rest: {str(r["passed"]): r["count"] for r in engine.validate(*rest[:1]).groupBy("passed").count().collect()},
    "index": lambda engine, rest: rows(engine.index()),
    "index_embedded": lambda engine, rest: rows(engine.index_embedded(rest[0])),
    "hybrid_setup": lambda engine, rest: rows(engine.hybrid_setup()),
    "enrich": lambda engine, rest: rows(engine.enrich()),
    "batch": lambda engine, rest: rows(engine.batch(rest[0], rest[1])),
    "run": lambda engine, rest: engine.run(rest[0]),
    "rag": lambda engine, rest: engine.answer(rest).show(truncate=False),
    "advanced_rag": lambda engine, rest: engine.retrieve(rest).show(truncate=False),
    "ask": lambda engine, rest: engine.answer(rest).show(truncate=False),
    "api": lambda engine, rest: server.server(engine, *map(int, rest[:1])).serve_forever(),
    "health": lambda engine, rest: engine.health() | engine.providers_health(),
}


def main(given: list[str] | None = None) -> object:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("home")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("rest", nargs="*")
    args = parser.parse_args(given)
    engine = Engine(SparkSession.builder.appName("lodestone").getOrCreate(), Settings.from_env(args.home))
    out = COMMANDS[args.command](engine, args.rest)
    if out is not None:
        print(out)
    return out


if __name__ == "__main__":
    main()

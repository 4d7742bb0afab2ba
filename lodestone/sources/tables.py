"""Table functions of SQL over source files: chunks of each file by LATERAL, figures of each group of files by PARTITION BY.

register(spark) makes them known to the session:

    SELECT f.file_path, c.* FROM files f, LATERAL parse_chunks(f.file_path, f.language, f.content) c
    SELECT * FROM parse_figures(TABLE(SELECT language, file_path, content FROM files) PARTITION BY language)
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lodestone.sources import parse

CHUNK_ROW = ["type", "name", "qualified_name", "parent", "signature", "complexity", "start_line", "end_line", "code"]


@udtf(returnType="type string, name string, qualified_name string, parent string, signature string, complexity int, start_line int, end_line int, code string, error string", useArrow=True)
class ParseChunks:
    """A row for each chunk of one file; of a file that doesn't parse, one row with nothing but the error; none of a null or blank file."""

    def eval(self, file_path: str, language: str, content: str):
        try:
            for c in parse.generated(file_path or "", language, content or ""):
                yield (*(c[k] for k in CHUNK_ROW), None)
        except parse.FAILURES as error:
            yield (*[None] * len(CHUNK_ROW), f"{type(error).__name__}: {error}")


@udtf(returnType="language string, files int, failed int, chunks int, longest int")
class ParseFigures:
    """One row for each partition of rows (language, file_path, content): files, those that don't parse, chunks, and lines of the longest chunk."""

    def __init__(self):
        self.language, self.files, self.failed, self.chunks, self.longest = None, 0, 0, 0, 0

    def eval(self, row):
        self.language, self.files = row["language"], self.files + 1
        try:
            for c in parse.generated(row["file_path"] or "", row["language"], row["content"] or ""):
                self.chunks += 1
                self.longest = max(self.longest, c["end_line"] - c["start_line"] + 1)
        except parse.FAILURES:
            self.failed += 1

    def terminate(self):
        if self.files:
            yield self.language, self.files, self.failed, self.chunks, self.longest


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    spark.udtf.register("parse_chunks", ParseChunks)
    spark.udtf.register("parse_figures", ParseFigures)

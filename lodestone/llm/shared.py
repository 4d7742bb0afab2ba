"""Tables that stages of one operator share, written where every executor can read them.

The place is ``spark.checkpoint.dir``.  Only where a local session names none (tests, local runs) a
folder of this process is set; on a cluster it must be named.  Lineage ends at the written files, so losing an executor costs no
more than the tasks of the running stage.  Tables written within temporary() go when it ends; others
stay for the reader of a result, until the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str, outer: int = 0) -> str:
    """A path in the shared folder that no other run uses; removed at the end of temporary() (of the one so many levels further out) or of the driver."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    if len(_scopes) > outer:
        _scopes[-1 - outer].append(path)
    return path


def shared_table(df: DataFrame, name: str, outer: int = 0) -> DataFrame:
    """df, computed once into a table in the shared folder and read back from there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name, outer)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but those written for a level further out."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)
            _written.remove((spark, path))


def remove(spark: SparkSession, path: str) -> None:
    """Delete one written path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already; a folder of this machine can still go
            if path.startswith("file://"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)

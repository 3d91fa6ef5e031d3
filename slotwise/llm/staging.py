"""Tables that outlive the executor that wrote them.

A plan that is read more than once (by an iterative operator, or by a range partitioner that samples
its input) is written as Parquet to the shared folder that the session names in
``spark.checkpoint.dir`` and read back, which also cuts its lineage. Losing an executor then costs a
re-read and nothing else. Once such a table is written nobody reads the shuffles that made it, so that
Spark is told to remove their files then; a table whose successor is written can be discarded.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: list[str] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in an unconfigured local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="slotwise-")
    spark.conf.set("spark.checkpoint.dir", folder)
    _LOCAL.append(folder)
    return folder


@atexit.register
def _remove_local() -> None:
    for folder in _LOCAL:
        shutil.rmtree(folder, ignore_errors=True)


@contextmanager
def _without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _without_old_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that no frame still in use reads."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001

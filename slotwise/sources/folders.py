"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


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


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a plan that is read more than once, or grows round by round."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

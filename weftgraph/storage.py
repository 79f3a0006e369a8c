"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session names none, as in tests, a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
    return _own[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/graph/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back; a lost executor costs a re-read."""
    spark = df.sparkSession
    path = fresh(spark, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

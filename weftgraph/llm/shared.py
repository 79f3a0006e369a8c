"""What the operators share: the folder that driver and executors both see, and tables written there.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it again, so a
lost executor costs a re-read, never a lost block.  Only where a local session names no such folder
(tests, notebooks) a temporary one is made; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: the longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Whether a query's shuffle files go once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder all executors share."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *, keep_shuffles: bool = True) -> DataFrame:
    """``df`` written to the shared folder and read back, with its schema kept.

    The write's shuffle files stay on executors' disks until the driver collects its garbage, or go at its end.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    if not keep_shuffles:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if not keep_shuffles:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` wrote."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/weftgraph/" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffle join follows)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def given_back(rows: Iterator[pa.RecordBatch], *caches) -> Iterator[pa.RecordBatch]:
    """``rows``; once they end, what the task has cached goes: workers are reused, and later stages need the memory."""
    try:
        yield from rows
    finally:
        for cache in caches:
            cache.cache_clear()
        pa.default_memory_pool().release_unused()


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def copy_number(docs: DataFrame, keys: list[str], id_col: str, text_col: str) -> Column:
    """1, 2, ... for rows that are the same under ``keys``; the further columns decide the order."""
    rest = [F.col(f.name) for f in docs.schema if f.name not in (id_col, text_col) and f.dataType.typeName() not in ("map", "variant")]
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(0), *rest)))


def words(text: str = "text") -> Column:
    """How many words a text has; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

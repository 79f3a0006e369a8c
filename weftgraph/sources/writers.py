"""Writers for nodes, edges and question sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def json_array(df: DataFrame, path: str) -> None:
    """One JSON array, for tools that read nothing else; meant for small results, as one task writes it."""
    whole = df.select(F.to_json(F.struct("*")).alias("row")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("row"), ",\n"), F.lit("\n]")).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def csv_edges(edges: DataFrame, path: str, with_evidence: bool = False) -> None:
    """source, target, type, and evidence if asked for."""
    _csv(edges.select("source", "target", "type", *(["evidence"] if with_evidence else [])), path)


def bulk_edges(edges: DataFrame, with_evidence: bool = False) -> DataFrame:
    """The columns of a bulk import of relations; missing evidence is empty."""
    columns = [F.col("source").alias(":START_ID"), F.col("target").alias(":END_ID"), F.col("type").alias(":TYPE")]
    return edges.select(*columns, *([F.coalesce("evidence", F.lit("")).alias("evidence")] if with_evidence else []))


def bulk_nodes(nodes: DataFrame) -> DataFrame:
    """The columns of a bulk import of nodes; the infobox is JSON, a missing page id 0."""
    return nodes.select(
        F.col("title").alias("title:ID"),
        F.coalesce("label", F.lit("")).alias(":LABEL"),
        F.coalesce(F.expr("try_cast(page_id as bigint)"), F.lit(0)).alias("page_id"),
        F.coalesce(F.to_json("infobox"), F.lit("{}")).alias("infobox"),
    )


def bulk_csv(df: DataFrame, path: str) -> None:
    _csv(df, path)


def replaced(df: DataFrame, path: str) -> str:
    """Write over a table that ``df`` itself may read: a new version beside it takes its place at the end."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fresh, old, here = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old", path))
    system = here.getFileSystem(conf)
    df.write.parquet(fresh.toString())
    if system.exists(here):
        system.rename(here, old)
    system.rename(fresh, here)
    system.delete(old, True)
    return path

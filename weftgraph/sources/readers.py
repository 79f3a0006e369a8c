"""Readers for pages, articles, nodes and edges; always with an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType, _parse_datatype_string

from weftgraph import schema as S


class MissingInput(ValueError):
    """An input that a step needs isn't there."""


def must_exist(spark: SparkSession, *paths: str) -> None:
    """Raise :class:`MissingInput` naming the paths that aren't there; any file system that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (path := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(path)]
    if missing:
        raise MissingInput(f"missing: {', '.join(missing)}")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One file that holds a JSON array."""
    must_exist(spark, path)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and unparsable lines are skipped, numbers written as strings are kept."""
    must_exist(spark, path)
    wanted: StructType = _parse_datatype_string(schema)
    loose = ", ".join(f"`{f.name}` {'string' if isinstance(f.dataType, LongType) else f.dataType.simpleString()}" for f in wanted)
    rows = spark.read.schema(loose).option("mode", "DROPMALFORMED").json(path)
    return rows.select(*[F.expr(f"try_cast(`{f.name}` as bigint)").alias(f.name) if isinstance(f.dataType, LongType) else F.col(f.name) for f in wanted])


def csv_edges(spark: SparkSession, path: str, with_evidence: bool = False) -> DataFrame:
    """Edges with a header; empty evidence stays empty, doubled quotes are quotes."""
    must_exist(spark, path)
    rows = spark.read.schema(S.EVIDENCE_EDGE if with_evidence else S.EDGE).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.withColumn("evidence", F.coalesce("evidence", F.lit(""))) if with_evidence else rows


def xml_pages(spark: SparkSession, path: str, ids: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """page_id, title, wikitext out of an XML dump, of the given page ids only; pages without text go."""
    must_exist(spark, path)
    rows = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", True).schema("id long, title string, revision struct<text: string>").load(path)
    pages = rows.select(F.col("id").alias("page_id"), "title", F.col("revision.text").alias("wikitext")).where(F.coalesce("wikitext", F.lit("")) != "")
    if ids is None:
        return pages
    if isinstance(ids, DataFrame):
        return pages.join(ids.select(F.col(ids.columns[0]).alias("page_id")), "page_id", "left_semi")
    return pages.where(F.col("page_id").isin(list(ids)))


def pages_of(pages: DataFrame, titles: DataFrame, redirects: DataFrame | None = None, text: str = "wikitext") -> DataFrame:
    """The pages that ``titles`` name, looked up in a table instead of over a network.

    Redirects (source, target) are followed once.  Missing pages and blank texts are left out.
    """
    wanted = titles.select("title").distinct()
    if redirects is not None:
        wanted = wanted.join(redirects.select(F.col("source").alias("title"), F.col("target").alias("to")), "title", "left").select(F.coalesce("to", "title").alias("title")).distinct()
    return pages.join(wanted, "title", "left_semi").where(F.trim(F.coalesce(text, F.lit(""))) != "")


def texts_of(titles: DataFrame, articles: DataFrame, text: str = "text") -> DataFrame:
    """title, text for every title; empty where there is no article."""
    return titles.select("title").distinct().join(articles.select("title", F.col(text).alias("text")), "title", "left").select("title", F.coalesce("text", F.lit("")).alias("text"))


def setting(path: str, default: str | None = None) -> str:
    """The first line of a local text file that isn't blank; ``default`` if there is none."""
    try:
        with open(path, encoding="utf-8") as file:
            found = next((x.strip() for x in file if x.strip()), None)
    except FileNotFoundError:
        found = None
    if (found or default) is None:
        raise MissingInput(f"no setting in {path}")
    return found or default


def table(spark: SparkSession, query: str, **values) -> DataFrame:
    """A parameterised query over the session's tables."""
    return spark.sql(query, args=values)

"""Loading nodes and edges into tables: upserts, endpoint checks, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.schema import EDGE_KEY


def upsert_nodes(existing: DataFrame | None, new: DataFrame, order: str = "pos") -> DataFrame:
    """Existing rows untouched, and the first new row of every other title; rows without title go.

    A missing page id becomes ``TITLE_KEY_`` and the title.
    """
    first = Window.partitionBy("title").orderBy(order)
    fresh = new.where(F.col("title").isNotNull()).withColumn("n", F.row_number().over(first)).where("n = 1")
    fresh = fresh.withColumn("page_id", F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("TITLE_KEY_"), "title"))).drop("n", order)
    return fresh if existing is None else existing.unionByName(fresh.join(existing.select("title"), "title", "left_anti"))


def endpoint_checked(edges: DataFrame, nodes: DataFrame, title: str = "title") -> DataFrame:
    """Edges both of whose ends are nodes; repeated ones stay."""
    known = nodes.select(F.col(title).alias("known")).distinct()
    return edges.join(known, edges["source"] == known["known"], "left_semi").join(known.withColumnRenamed("known", "known2"), F.col("target") == F.col("known2"), "left_semi")


def rejected(edges: DataFrame, nodes: DataFrame, title: str = "title") -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select(F.col(title).alias("known")).distinct().withColumn("yes", F.lit(True))
    marked = edges.join(known, edges["source"] == known["known"], "left").drop("known").withColumnRenamed("yes", "s")
    marked = marked.join(known, marked["target"] == known["known"], "left").drop("known").withColumnRenamed("yes", "t")
    return marked.where("s is null or t is null").drop("s", "t")


def insert_edges(edges: DataFrame, nodes: DataFrame, existing: DataFrame | None = None, keep_repeated: bool = True) -> DataFrame:
    """Checked edges added to existing ones; with ``keep_repeated`` off loading twice changes nothing."""
    good = endpoint_checked(edges, nodes)
    if existing is None:
        return good if keep_repeated else good.dropDuplicates(EDGE_KEY)
    if keep_repeated:
        return existing.unionByName(good)
    return existing.unionByName(good.dropDuplicates(EDGE_KEY).join(existing.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_anti"))


def assert_unique(nodes: DataFrame, title: str = "title") -> None:
    """Raise unless titles are unique."""
    if repeated := nodes.groupBy(title).count().where("count > 1").limit(5).collect():
        raise ValueError(f"titles are not unique: {[r[title] for r in repeated]}")


def label_histogram(nodes: DataFrame, label: str = "label", missing: str = "Khác") -> DataFrame:
    return nodes.groupBy(F.coalesce(label, F.lit(missing)).alias("label")).agg(F.count("*").alias("n"))


def type_histogram(edges: DataFrame, top: int | None = None) -> DataFrame:
    counted = edges.groupBy("type").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "type").limit(top) if top else counted


def symmetric_once(edges: DataFrame, symmetric: list[str]) -> DataFrame:
    """Of symmetric types one row per unordered pair; others as they are."""
    ordered = F.col("type").isin(symmetric)
    return edges.select(
        F.when(ordered, F.least("source", "target")).otherwise(F.col("source")).alias("source"),
        F.when(ordered, F.greatest("source", "target")).otherwise(F.col("target")).alias("target"),
        "type",
    ).distinct()


def with_generic_fallback(pairs: DataFrame, typed: DataFrame, generic: str) -> DataFrame:
    """Typed edges, and a generic one for each pair that has none."""
    left = pairs.select("source", "target").distinct().join(typed.select("source", "target").distinct(), ["source", "target"], "left_anti")
    return typed.select(*EDGE_KEY).unionByName(left.withColumn("type", F.lit(generic)))


def written_back(nodes: DataFrame, scores: DataFrame, key: str = "title") -> DataFrame:
    """Nodes with score columns; nodes without a score have null."""
    return nodes.join(scores, key, "left")


def filled_summaries(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Missing or empty summaries taken from ``summaries`` (title, summary), on one line and stripped."""
    found = summaries.select("title", F.col("summary").alias("found"))
    line = F.regexp_replace(F.regexp_replace(F.coalesce("found", F.lit("")), "\n", " "), r"(?U)^\s+|\s+$", "")
    return nodes.join(found, "title", "left").withColumn("summary", F.coalesce(F.nullif("summary", F.lit("")), line)).drop("found")


def first_batch_numbers(titles: DataFrame, size: int = 50, order: str = "pos") -> DataFrame:
    """Distinct titles in order of first appearance, and the batch that each falls in (for live sources)."""
    firsts = titles.where(F.col("title").isNotNull()).groupBy("title").agg(F.min(order).alias(order))
    numbered = firsts.withColumn("n", F.row_number().over(Window.orderBy(order)) - 1)
    return numbered.select("title", F.floor(F.col("n") / size).alias("batch"))

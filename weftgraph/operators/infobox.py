"""Edges and labels from infoboxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T


def clean_value(value: Column) -> Column:
    """Without bracketed notes, with single spaces."""
    return T.strip(F.regexp_replace(F.regexp_replace(value, r"\[[^\]]*\]|\([^)]*\)", ""), r"(?U)\s+", " "))


def infobox_edges(nodes: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """source, target, type: values of infobox keys that hold a phrase (first match), split at line breaks."""
    kind = None
    for phrase, rel_type in keys:
        found = F.contains(F.lower("key"), F.lit(phrase))
        kind = F.when(found, F.lit(rel_type)) if kind is None else kind.when(found, F.lit(rel_type))
    rows = nodes.select(F.col("title").alias("source"), F.explode("infobox").alias("key", "value")).withColumn("type", kind).where(F.col("type").isNotNull())
    parts = rows.select("source", "type", F.explode(F.split("value", r"(?i)<br\s*/?>|\n", -1)).alias("part"))
    return parts.select("source", clean_value(F.col("part")).alias("target"), "type").where((F.col("target") != "") & (F.col("target") != F.col("source"))).distinct()


def labelled_nodes(nodes: DataFrame, rules: Sequence[tuple[str, list[str]]], default: str | None = None) -> DataFrame:
    """``nodes`` with ``label``: the first whose words occur in the template or an infobox key."""
    seen = F.lower(F.concat_ws(" ", F.coalesce("template", F.lit("")), F.array_join(F.map_keys("infobox"), " ")))
    branch = None
    for label, cues in rules:
        hit = T.mentions_any(seen, cues)
        branch = F.when(hit, F.lit(label)) if branch is None else branch.when(hit, F.lit(label))
    return nodes.withColumn("label", branch.otherwise(F.lit(default)) if branch is not None else F.lit(default))


def with_page_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with the page ids of both ends, null where there is no such page."""
    ids = nodes.groupBy("title").agg(F.min("page_id").alias("page_id"))
    s, t = ids.select(F.col("title").alias("source"), F.col("page_id").alias("source_id")), ids.select(F.col("title").alias("target"), F.col("page_id").alias("target_id"))
    return edges.join(s, "source", "left").join(t, "target", "left")

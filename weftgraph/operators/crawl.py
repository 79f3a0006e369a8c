"""Breadth-first crawl over a table of pages, level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.schema import GENERIC
from weftgraph.storage import cut


def valid_title(title: Column, seeds: Sequence[str], first_words: Sequence[str], person_template: Column) -> Column:
    """A seed, or a known first word, or a person's infobox."""
    return title.isin(list(seeds)) | F.coalesce(T.first_word(title).isin(list(first_words)), F.lit(False)) | person_template


def candidate_links(pages: DataFrame, first_words: Sequence[str] | None) -> DataFrame:
    """source, target: distinct links that are capitalised, not the page itself, and start well."""
    links = pages.select(F.col("title").alias("source"), F.explode(F.array_distinct("links")).alias("target"))
    good = T.capitalised(F.col("target")) & (F.col("target") != F.col("source"))
    return links.where(good if first_words is None else good & T.first_word(F.col("target")).isin(list(first_words)))


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 2, first_words: Sequence[str] | None = None, valid: Column | None = None, generic: str = GENERIC) -> tuple[DataFrame, DataFrame]:
    """Nodes (title, depth) and edges (source, target, type) reached from ``seeds`` (title).

    A title is visited once, at its least depth.  Pages that are missing or not ``valid`` are visited
    but neither kept nor followed; pages at ``max_depth`` are kept and give no edges.  Edges stay only if
    both ends were kept.  Each level is written out, so plans don't grow with depth.
    """
    known = pages.withColumn("ok", F.coalesce(valid if valid is not None else F.lit(True), F.lit(False)))
    frontier = cut(seeds.select("title").distinct().withColumn("depth", F.lit(0)), "frontier")
    visited, nodes, edges = frontier.select("title"), None, None
    for depth in range(max_depth + 1):
        kept = cut(known.where("ok").join(frontier, "title", "left_semi").withColumn("depth", F.lit(depth)), "level")
        nodes = kept.select("title", "depth") if nodes is None else nodes.unionByName(kept.select("title", "depth"))
        if depth == max_depth:
            break
        links = candidate_links(kept, first_words)
        edges = links if edges is None else edges.unionByName(links)
        frontier = cut(links.select(F.col("target").alias("title")).distinct().join(visited, "title", "left_anti").withColumn("depth", F.lit(depth + 1)), "frontier")
        visited = visited.unionByName(frontier.select("title"))
    ends = nodes.select("title")
    edges = edges if edges is not None else candidate_links(known.where("false"), None)
    checked = edges.distinct().join(ends.withColumnRenamed("title", "source"), "source", "left_semi").join(ends.withColumnRenamed("title", "target"), "target", "left_semi")
    return nodes, checked.select("source", "target", F.lit(generic).alias("type"))

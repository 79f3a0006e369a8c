"""Mention edges from a stream of articles: each triple once, whatever order articles come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.functions import text as T
from weftgraph.operators.enrich import contains_join
from weftgraph.schema import EDGE_KEY


def mention_stream(articles: DataFrame, titles: DataFrame, rel_type: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Edges from streaming ``articles`` (title, text) to the titles of a static gazetteer (lowered, title).

    Titles are found as in ``contains_join``: by an automaton, or on grams if they are many.
    With an event time column, triples are remembered for ``delay`` behind the newest article only.
    """
    texts = articles.select(*[c for c in ("title", "text", time) if c]).where(F.coalesce("text", F.lit("")) != "")
    hits = contains_join(texts.withColumn("low", F.lower("text")), "low", titles, min_length=1).where(F.lower("title") != F.lower("t_title"))
    edges = hits.select(F.col("title").alias("source"), F.col("t_title").alias("target"), F.lit(rel_type).alias("type"), *([F.col(time)] if time else []))
    return edges.withWatermark(time, delay).dropDuplicatesWithinWatermark(EDGE_KEY) if time else edges.dropDuplicates(EDGE_KEY)


def sentence_counts(articles: DataFrame, time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Sentences by event-time window; windows are final once the watermark has passed them."""
    rows = articles.withWatermark(time, delay).select(time, F.size(T.sentences(F.col("text"))).alias("n"))
    return rows.groupBy(F.window(time, window).alias("window")).agg(F.sum("n").alias("sentences"))


def append_to(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has come to a table of edges, then stop."""
    return edges.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)

"""Looking up nodes and their surroundings for questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.schema import GENERIC

#: Scoring of titles: BM25 with the usual constants; a hit must score above the floor.
K1, B, FLOOR = 1.2, 0.75, 0.6


def title_terms(nodes: DataFrame) -> DataFrame:
    """title, term: lowered words of letters and digits, repeats kept."""
    words = F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return nodes.select("title").distinct().select("title", F.explode(words).alias("term"))


def search(nodes: DataFrame, keyword: str, limit: int = 1, floor: float = FLOOR) -> DataFrame:
    """title, score: the best titles for a keyword by BM25, equal ones by title."""
    spark = nodes.sparkSession
    terms = title_terms(nodes)
    asked = title_terms(spark.createDataFrame([(keyword,)], "title string")).select("term").distinct()
    sizes = terms.groupBy("title").agg(F.count("*").alias("size"))
    whole = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    hits = terms.join(F.broadcast(asked), "term").groupBy("title", "term").agg(F.count("*").alias("tf"))
    spread = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(spread, "term").join(sizes, "title").join(F.broadcast(whole), F.lit(True))
    rarity = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = rows.groupBy("title").agg(F.sum(rarity * weight).alias("score")).where(F.col("score") > floor)
    return scored.orderBy(F.desc("score"), "title").limit(limit)


def one_hop(nodes: DataFrame, edges: DataFrame, keyword: str, exclude: Sequence[str] = (GENERIC,), limit: int = 30) -> DataFrame:
    """center, rel_type, neighbor: edges at the best hit, either way round."""
    hit = search(nodes, keyword).select(F.col("title").alias("center"))
    kept = edges.where(~F.col("type").isin(list(exclude)))
    out = kept.select(F.col("source").alias("center"), F.col("type").alias("rel_type"), F.col("target").alias("neighbor"))
    back = kept.where("source <> target").select(F.col("target").alias("center"), F.col("type").alias("rel_type"), F.col("source").alias("neighbor"))
    return out.unionByName(back).join(F.broadcast(hit), "center", "left_semi").orderBy("rel_type", "neighbor").limit(limit)


def one_hop_text(found: DataFrame) -> DataFrame:
    """One row, ``context``: a line for each row of :func:`one_hop`."""
    line = F.concat(F.lit("- "), "center", F.lit(" --["), "rel_type", F.lit("]--> "), "neighbor")
    return found.agg(F.concat_ws("\n", F.array_sort(F.collect_list(line))).alias("context"))


def paths(nodes: DataFrame, edges: DataFrame, keyword: str, exclude: Sequence[str] = (GENERIC,), limit: int = 50, directed_text: bool = True) -> DataFrame:
    """path: chains of one or two edges from the best hit to another node.

    An edge is used once in a path; nodes may recur.  With ``directed_text`` the arrow follows the edge,
    otherwise the walk.  Distinct texts in order, at most ``limit``.
    """
    hit = F.broadcast(search(nodes, keyword).select(F.col("title").alias("start")))
    kept = edges.where(~F.col("type").isin(list(exclude)))
    # Rows that are equal are still edges of their own.
    w = Window.partitionBy("source", "target", "type").orderBy(F.lit(1))
    kept = kept.select("source", "target", "type").withColumn("copy", F.row_number().over(w)).withColumn("edge", F.struct("source", "target", "type", "copy"))
    steps = kept.select(F.col("source").alias("a"), F.col("target").alias("b"), "type", "edge", F.lit(True).alias("ahead")).unionByName(kept.where("source <> target").select(F.col("target").alias("a"), F.col("source").alias("b"), "type", "edge", F.lit(False).alias("ahead")))

    def text(a, b, rel, ahead):
        to = F.concat(a, F.lit(" --["), rel, F.lit("]--> "), b)
        return F.when(ahead, to).otherwise(F.concat(b, F.lit(" --["), rel, F.lit("]--> "), a)) if directed_text else to

    first = steps.join(hit, steps["a"] == hit["start"]).select("start", F.col("b").alias("mid"), F.col("edge").alias("edge1"), text(F.col("a"), F.col("b"), F.col("type"), F.col("ahead")).alias("text1"))
    one = first.where(F.col("mid") != F.col("start")).select(F.col("text1").alias("path"))
    second = first.join(steps, first["mid"] == steps["a"]).where((F.col("edge1") != F.col("edge")) & (F.col("b") != F.col("start")))
    two = second.select(F.concat("text1", F.lit(" ; "), text(F.col("a"), F.col("b"), F.col("type"), F.col("ahead"))).alias("path"))
    return one.unionByName(two).distinct().orderBy("path").limit(limit)


def summary(nodes: DataFrame, keyword: str) -> DataFrame:
    """name, summary of the best hit, if it has one."""
    hit = search(nodes, keyword).select(F.col("title").alias("hit"))
    found = nodes.join(F.broadcast(hit), nodes["title"] == hit["hit"])
    return found.where(F.coalesce("summary", F.lit("")) != "").select(F.col("title").alias("name"), "summary")


def context(nodes: DataFrame, edges: DataFrame, intent: str, keyword: str, hops: int = 1) -> str | None:
    """Text for an answer: the summary if asked for and there is one, else relations of one or two steps."""
    if intent == "SUMMARY" and "summary" in nodes.columns and (row := summary(nodes, keyword).first()):
        return f"TÓM TẮT VỀ {row['name']}:\n{row['summary']}"
    if hops >= 2:
        return "\n".join(r["path"] for r in paths(nodes, edges, keyword).collect()) or None
    return one_hop_text(one_hop(nodes, edges, keyword)).first()["context"] or None


def succession(edges: DataFrame, rel_type: str = "KẾ_NHIỆM_CỦA", limit: int = 20) -> DataFrame:
    return edges.where(F.col("type") == rel_type).select("source", "target").orderBy("source", "target").limit(limit)

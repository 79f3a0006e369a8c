"""Typing edges from the sentences that mention their target.

Input edges are (source, target) with an optional ``pos`` (order of input), articles are (title, text).
Whatever depends on order carries a position column; partitions never decide.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.rule_tables import COLLAPSED, GENERIC, WEIGHTS
from weftgraph.functions.rules import heaviest, looked_up, weight_of
from weftgraph.schema import EDGE_KEY


def mention_sentences(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """source, target, pos, sentence: sentences of the source's article that hold the target, case kept."""
    split = articles.where(F.coalesce("text", F.lit("")) != "").select(F.col("title").alias("source"), T.sentences_strict(F.col("text")).alias("sentences"))
    pairs = edges.select("source", "target").distinct().join(split, "source")
    return pairs.select("source", "target", F.posexplode("sentences").alias("pos", "sentence")).where(F.contains("sentence", "target"))


def votes(mentions: DataFrame, rules: Mapping[str, list[str]], weights: Mapping[str, int] = WEIGHTS, flips: Sequence = (), generic: str = GENERIC) -> DataFrame:
    """source, target, type, score, pos, evidence: summed weights and the first sentence of each type."""
    typed = mentions.withColumn("type", heaviest(F.col("sentence"), rules, weights, generic, flips)).withColumn("w", weight_of(F.col("type"), weights))
    return typed.groupBy(*EDGE_KEY).agg(F.sum("w").alias("score"), F.min("pos").alias("pos"), T.evidence(F.min_by("sentence", "pos")).alias("evidence"))


def top_types(voted: DataFrame, keep: int = 2, generic: str = GENERIC) -> DataFrame:
    """The best types of each pair, by score and then first mention; the generic one only if it is alone."""
    pair = Window.partitionBy("source", "target")
    counted = voted.withColumn("kinds", F.count("*").over(pair)).where((F.col("kinds") == 1) | (F.col("type") != generic))
    rank = F.row_number().over(pair.orderBy(F.desc("score"), "pos"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= keep).select(*EDGE_KEY, "evidence", "score", "rank")


def first_writer(edges: DataFrame, *order: str) -> DataFrame:
    """One row per triple, the first by ``order``."""
    w = Window.partitionBy(*EDGE_KEY).orderBy(*order)
    return edges.withColumn("written", F.row_number().over(w)).where("written = 1").drop("written")


def inverse_closure(forward: DataFrame, inverse: Mapping[str, str], collapsed: Mapping[str, str] = COLLAPSED) -> DataFrame:
    """Forward edges and, once round, the inverse of each; on equal triples forward edges come first.

    An inverse type that ``collapsed`` names is written as what it names.

    Among inverses of one triple the one whose forward edge is first by (source, target, rank) stays.
    """
    inverse = {k: collapsed.get(v, v) for k, v in inverse.items()}
    turned = forward.withColumn("back", looked_up(F.col("type"), inverse)).where(F.col("back").isNotNull())
    said = F.concat(F.lit("[SUY LUẬN] Từ việc "), F.col("source"), F.lit(" là "), F.col("type"), F.lit(" của "), F.col("target"), F.lit("."))
    shape = ["source", "target", "type", "evidence", "generation", "o1", "o2", "o3"]
    first = forward.select("source", "target", "type", "evidence", F.lit(0).alias("generation"), F.col("source").alias("o1"), F.col("target").alias("o2"), F.col("rank").alias("o3"))
    second = turned.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("back").alias("type"), said.alias("evidence"), F.lit(1).alias("generation"), F.col("source").alias("o1"), F.col("target").alias("o2"), F.col("rank").alias("o3"))
    return first_writer(first.unionByName(second).select(*shape), "generation", "o1", "o2", "o3").select("source", "target", "type", "evidence", "generation")


def unmentioned(edges: DataFrame, mentions: DataFrame, articles: DataFrame, keep_missing: bool, generic: str = GENERIC) -> DataFrame:
    """Edges of the generic type with empty evidence, and ``why``.

    A source without text keeps all its edges.  An edge whose text never mentions the target is kept
    if ``keep_missing``, as family B does, and dropped otherwise.
    """
    pairs = edges.select("source", "target").distinct()
    with_text = articles.where(F.coalesce("text", F.lit("")) != "").select(F.col("title").alias("source")).distinct()
    no_text = pairs.join(with_text, "source", "left_anti").withColumn("why", F.lit("no text"))
    silent = pairs.join(with_text, "source", "left_semi").join(mentions.select("source", "target").distinct(), ["source", "target"], "left_anti").withColumn("why", F.lit("no mention"))
    out = no_text.unionByName(silent) if keep_missing else no_text
    return out.select("source", "target", F.lit(generic).alias("type"), F.lit("").alias("evidence"), "why")


def typed_edges(edges: DataFrame, articles: DataFrame, rules: Mapping[str, list[str]], inverse: Mapping[str, str], weights: Mapping[str, int] = WEIGHTS, flips: Sequence = (), keep_missing: bool = False, generic: str = GENERIC, labeler=None) -> DataFrame:
    """The whole step: votes, top two, fallbacks, inverses.

    ``labeler``, a function of a table (source, target, context) that adds ``label``, is asked about pairs
    for which only the generic type was found.
    """
    mentions = mention_sentences(edges, articles)
    best = top_types(votes(mentions, rules, weights, flips, generic), generic=generic).select(*EDGE_KEY, "evidence", "rank")
    if labeler is not None:
        open_ = best.where(F.col("type") == generic).select("source", "target")
        ordered = F.array_sort(F.collect_list(F.struct("pos", "sentence")))
        context = mentions.join(open_, ["source", "target"], "left_semi").groupBy("source", "target").agg(F.concat_ws(" ", F.transform(ordered, lambda x: x["sentence"])).alias("context"))
        asked = labeler(context).where(F.col("label") != generic).select("source", "target", "label", "context")
        told = F.concat(F.lit("[AI] "), F.substring("context", 1, 100), F.lit("..."))
        best = best.join(asked, ["source", "target"], "left").select("source", "target", F.coalesce("label", "type").alias("type"), F.when(F.col("label").isNull(), F.col("evidence")).otherwise(told).alias("evidence"), "rank")
    rest = unmentioned(edges, mentions, articles, keep_missing, generic).select(*EDGE_KEY, "evidence", F.lit(1).alias("rank"))
    return inverse_closure(best.unionByName(rest), inverse)

"""Adding edges from texts: mentions of titles, keywords, sentence classes, links.

"Text contains title" has no equality to hash on.  Up to ``BROADCAST_TITLES`` titles of ``BROADCAST_BYTES``,
measured first, an automaton of all titles reads every text once, in Arrow batches, however many titles there
are.  Beyond that texts and titles meet on the title's first characters, or on the whole of a shorter title:
texts are cut into their distinct grams, and the pairs are verified.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.rules import first_match
from weftgraph.schema import EDGE_KEY

BROADCAST_TITLES = 50_000
BROADCAST_BYTES = 16 << 20
GRAM = 4


def gazetteer(nodes: DataFrame, title: str = "title", order: str = "pos", label: str | None = None) -> DataFrame:
    """lowered, title (and label): one row per lowered title, the last one written; null and empty titles go."""
    last = Window.partitionBy("lowered").orderBy(F.desc(order), F.desc(title))
    kept = nodes.where(F.coalesce(title, F.lit("")) != "").withColumn("lowered", F.lower(title))
    return kept.withColumn("n", F.row_number().over(last)).where("n = 1").select("lowered", F.col(title).alias("title"), *([F.col(label).alias("label")] if label else []))


HIT = "array<struct<t_lowered string, t_title string>>"


def finder(titles: list[tuple[str, str]], spark: SparkSession):
    """A function of a text column: the titles (lowered, title) that the text holds, each once; none for null."""
    shared = spark.sparkContext.broadcast(titles)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, places = ahocorasick.Automaton(), {}
        for i, (lowered, _) in enumerate(shared.value):
            places.setdefault(lowered, []).append(i)
        for lowered, at in places.items():
            automaton.add_word(lowered, at)
        automaton.make_automaton()
        columns = [pa.array(c, pa.string()) for c in zip(*shared.value, strict=True)]
        rows = pa.StructArray.from_arrays(columns, ["t_lowered", "t_title"])
        for batch in batches:
            ends, found = [0], []
            for text in batch:
                # The lists are the automaton's own, so equal hits are one object.
                held = {id(at): at for _, at in automaton.iter(text.as_py() or "")}
                for at in held.values():
                    found += at
                ends.append(len(found))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.take(pa.array(found, pa.int32())))

    return F.arrow_udf(run, HIT)


def contains_join(texts: DataFrame, lowered: str, titles: DataFrame, min_length: int = GRAM, limit: int = BROADCAST_TITLES) -> DataFrame:
    """``texts`` and ``titles`` (lowered, title) where the text holds the title; a null text or title holds nothing."""
    titles = titles.where(F.length("lowered") >= max(min_length, 1)).select(F.col("lowered").alias("t_lowered"), F.col("title").alias("t_title"))
    size = titles.limit(limit + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length("t_lowered") + F.coalesce(F.octet_length("t_title"), F.lit(0))).alias("bytes")).first()
    if size["n"] == 0:
        return texts.select("*", *[F.lit(None).cast("string").alias(c) for c in titles.columns]).where(F.lit(False))
    if size["n"] <= limit and size["bytes"] <= BROADCAST_BYTES:
        find = finder([tuple(r) for r in titles.collect()], texts.sparkSession)
        return texts.withColumn("_title_hit", F.explode(find(F.col(lowered)))).select("*", "_title_hit.*").drop("_title_hit")
    # A title shorter than the gram is its own gram; texts are cut into grams of its length too.
    keyed = titles.withColumn("gram", F.substring("t_lowered", 1, GRAM))

    def cut(n: int) -> Column:
        # All overlapping grams in one pass; cutting by position would count characters from the start each time.
        return F.regexp_extract_all(F.col(lowered), F.lit(f"(?s)(?=(.{{{n}}}))"), 1)

    grams = texts.withColumn("gram", F.explode(F.array_distinct(F.flatten(F.array(*[cut(n) for n in range(min(min_length, GRAM), GRAM + 1)])))))
    return grams.join(keyed, "gram").where(F.contains(F.col(lowered), F.col("t_lowered"))).drop("gram")


def others(own: Column, found: Column, by: str) -> Column:
    """Not the text's own title: compared as written, or lowered."""
    return F.lower(own) != F.lower(found) if by == "lowered" else own != found


def document_mentions(articles: DataFrame, titles: DataFrame, rel_type: str, self_by: str = "lowered") -> DataFrame:
    """An edge from each article to every title that its text holds."""
    texts = articles.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")).select(F.col("title").alias("source"), F.lower("text").alias("low"))
    found = contains_join(texts, "low", titles).where(others(F.col("source"), F.col("t_title"), self_by))
    return found.select("source", F.col("t_title").alias("target"), F.lit(rel_type).alias("type")).distinct()


def keyword_titles(articles: DataFrame, titles: DataFrame, patterns: Mapping[str, str], min_length: int = 1, limit: int = BROADCAST_TITLES) -> DataFrame:
    """An edge of each keyword's type from articles that hold both the keyword and the title.

    Articles without any keyword are left out before titles are looked for.
    """
    texts = articles.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")).select(F.col("title").alias("source"), F.lower("text").alias("low"))
    kinds = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(k)), F.lit(v)) for k, v in patterns.items()])))
    texts = texts.where(T.mentions_any(F.col("low"), list(patterns))).withColumn("kinds", kinds)
    found = contains_join(texts, "low", titles, min_length, limit).where(F.col("source") != F.col("t_title"))
    return found.select("source", F.col("t_title").alias("target"), F.explode("kinds").alias("type")).distinct()


def sentence_mentions(articles: DataFrame, titles: DataFrame, classes: Sequence[tuple[list[str], str]], default: str) -> DataFrame:
    """Each sentence's class as an edge to every title that the sentence holds."""
    texts = articles.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")).select(F.col("title").alias("source"), F.explode(T.sentences(F.col("text"))).alias("sentence"))
    lowered = texts.select("source", F.lower("sentence").alias("low"))
    found = contains_join(lowered, "low", titles).where(F.col("source") != F.col("t_title"))
    return found.select("source", F.col("t_title").alias("target"), first_match(F.col("low"), classes, default).alias("type")).distinct()


def link_sentences(articles: DataFrame, classes: Sequence[tuple[list[str], str]], default: str, text: str = "wikitext", shortest: int = 20, longest: int = 220, links: int = 3, first: int = 200) -> DataFrame:
    """source, pos, sentence, type, link_no, link: of the first sentences of each article the first links.

    Sentences are clipped before links and class are read, as evidence is what is kept.
    """
    texts = articles.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce(text, F.lit("")) != ""))
    cut = texts.select(F.col("title").alias("source"), F.posexplode(F.slice(T.sentences(F.col(text)), 1, first)).alias("pos", "sentence")).where(F.length("sentence") >= shortest)
    clipped = cut.withColumn("sentence", T.clip(F.col("sentence"), longest))
    typed = clipped.withColumn("links", F.slice(T.link_targets(F.col("sentence")), 1, links)).where(F.size("links") > 0).withColumn("type", first_match(F.lower("sentence"), classes, default))
    return typed.select("source", "pos", T.strip(F.col("sentence")).alias("sentence"), "type", F.posexplode("links").alias("link_no", "link"))


def resolve_links(linked: DataFrame, titles: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Edges with evidence to the nodes that links name, compared in lower case; nodes of other labels go."""
    hit = linked.join(titles.where(F.col("label").isin(list(labels))), F.lower("link") == F.col("lowered")).where(F.col("title") != F.col("source"))
    first = Window.partitionBy("source", "title", "type").orderBy("pos", "link_no")
    return hit.withColumn("n", F.row_number().over(first)).where("n = 1").select("source", F.col("title").alias("target"), "type", F.col("sentence").alias("evidence"))


def appended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing edges, and new triples that they don't hold; repeated new ones once."""
    fresh = new.dropDuplicates(EDGE_KEY).join(existing.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)

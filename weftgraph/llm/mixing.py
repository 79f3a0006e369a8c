"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies are proportional to its weight: by default the number of binary digits of
its number of words, so that a longer document is likelier, but by far less than in proportion.  In each
source the factor is the one by which expected words add up to the source's target, with no document
above ``max_copies``.  The whole part of a document's expected copies is allocated as certain copies.
What is left, ``p`` between 0 and 1, is its inclusion probability for one more: documents are ranked by
their random odds ``u / (1 - u)`` divided by their inclusion odds ``p / (1 - p)``, and the smallest ranks
are taken until the source's remaining words are used up, so the sample's size is fixed in words.

The order within a source is never sorted in one task.  Ranks fall into ``BUCKETS`` ordered buckets;
running sums over (source, bucket) give each bucket its start, and only the rows of one bucket are
sorted together, so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import documents, small_enough, stored, text_or_empty, words

BUCKETS = 4096
#: Random digits of a document: 13 hexadecimal digits of md5, 52 bits.
DIGITS, SPAN = 13, float(2**52)
SEED = "mix-1"


def uniform(id_col: str, seed: str) -> Column:
    """A number strictly between 0 and 1 that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long").cast("double") + 0.5) / SPAN


def source_targets(sources: DataFrame, weights: Sequence[float], max_copies: float) -> DataFrame:
    """``sources`` (no_source, source_key, source_size) with ``target``: weighted shares of all sizes.

    Weights go round over the sources in code point order, null last.  A target stops at
    ``max_copies`` times the source's size; the excess is shared again by weight until none is above.
    That fixed point is found at once: sources ordered by cap / weight are capped as long as their cap
    lies below the level that is left for the rest.
    """
    by_name = Window.orderBy("no_source", "source_key")
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size").cast("double") * float(max_copies))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    by_ratio = Window.orderBy("ratio", "no_source", "source_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    levels = ranked.withColumn("level", level).withColumn("place", F.row_number().over(by_ratio))
    free = F.when(F.col("ratio") > F.col("level"), F.col("place"))
    return (
        levels.withColumn("first_free", F.min(free).over(everything))
        .withColumn("water", F.max(F.when(F.col("place") == F.col("first_free"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("place") >= F.col("first_free"), F.col("weight") * F.col("water")).otherwise(F.col("cap")))
        .select("no_source", "source_key", "source_size", "target")
    )


def class_rates(classes: DataFrame, targets: DataFrame, max_copies: float) -> DataFrame:
    """``classes`` (no_source, source_key, weight, class_size) with source_size, target, whole, part, left.

    ``whole + part`` is what a document of that weight is expected to be taken: its weight times a level,
    ``max_copies`` at most.  With the heaviest classes capped one after another the level rises until no
    class is above and falls afterwards, so the greatest level is the one.  ``left`` is the source's words
    beyond certain copies.  One row a source and weight; those of one source are seen by one task.
    """
    key = ["no_source", "source_key"]
    source = Window.partitionBy(*key)
    heavier = source.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    weighed = F.col("weight") * F.col("class_size")
    free = F.sum(weighed).over(source) - F.coalesce(F.sum(weighed).over(heavier), F.lit(0))
    level = (F.col("target") - float(max_copies) * F.coalesce(F.sum("class_size").over(heavier), F.lit(0))) / F.nullif(free, F.lit(0))
    return (
        classes.join(targets, key)
        .withColumn("level", level)
        .withColumn("expected", F.least(F.lit(float(max_copies)), F.coalesce(F.max("level").over(source), F.lit(0.0)) * F.col("weight")))
        .withColumn("whole", F.floor("expected"))
        .withColumn("part", F.col("expected") - F.col("whole"))
        .withColumn("left", F.col("target") - F.sum(F.col("whole") * F.col("class_size")).over(source))
        .select(*key, "weight", "source_size", "target", "whole", "part", "left")
    )


def pareto_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    max_copies: int = 3,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, no_source, source_key, size, source_size, target, copies, taken.

    ``size`` is the number of words, ``taken`` is ``size`` times ``copies`` (0 to ``max_copies``).
    ``weight_col`` names documents' own weights, whole numbers; null and less than 1 count as 1.
    Null texts and texts without words have size 0 and take nothing but may be counted a copy.
    A null source is a source of its own, last in order.  Rows that share an id share their random
    number; ties go to the smaller size.  A null id counts as one more id.  Long texts are counted whole.
    Further columns may have any name.  No rows in, no rows out.
    The same rows give the same result, in whatever order and partitions they come.

    The number of *sources* is taken to fit one task (a name and two numbers each), and so is the number
    of different weights of one source (at most 64 by default).
    """
    own = F.length(F.bin("size")) if weight_col is None else F.greatest(F.coalesce(F.col("own_weight"), F.lit(1)), F.lit(1))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"),
        words(text_col).alias("size"),
        uniform(id_col, seed).alias("u"),
        *([] if weight_col is None else [F.col(weight_col).cast("long").alias("own_weight")]),
    )
    sized = stored(sized.select("doc_id", "no_source", "source_key", "size", "u", own.cast("long").alias("weight")), "mix-sized")
    key = ["no_source", "source_key"]
    classes = sized.groupBy(*key, "weight").agg(F.sum("size").alias("class_size"))
    targets = source_targets(classes.groupBy(*key).agg(F.sum("class_size").alias("source_size")), weights, max_copies)
    rates = small_enough(stored(class_rates(classes, targets, max_copies), "mix-rates"), 100_000)
    more = F.col("part") > 0
    odds = (F.col("u") / (1 - F.col("u"))) * (1 - F.col("part")) / F.col("part")
    ranked = (
        sized.join(rates, [*key, "weight"])
        .withColumn("odds", F.when(more, odds).otherwise(F.lit(float("inf"))))
        .withColumn("offered", F.when(more, F.col("size")).otherwise(F.lit(0)))
        .withColumn("bucket", F.floor(F.when(more, F.col("odds") / (1 + F.col("odds"))).otherwise(F.col("u")) * BUCKETS))
    )
    sums = ranked.groupBy(*key, "bucket").agg(F.sum("offered").alias("bucket_size"))
    earlier = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*key, "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy(*key, "bucket").orderBy("odds", "u", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("bucket_start") + F.sum("offered").over(inside)
    drawn = more & (end - F.col("size") / 2 <= F.col("left"))
    return (
        ranked.join(starts, [*key, "bucket"])
        .withColumn("copies", (F.col("whole") + F.when(drawn, 1).otherwise(0)).cast("int"))
        .select("doc_id", "no_source", "source_key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def op9_pareto_mix(spark, sf_dir: str) -> DataFrame:
    """:func:`pareto_mix` over all documents: what the mix takes of each."""
    return pareto_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`pareto_mix` takes it.

    Rows that agree in id, source and size are numbered by their texts, and the first gets the most copies
    of theirs, so that there are as many rows as :func:`pareto_mix` counts.  Names that begin with two
    underscores must not be used.
    """
    id_col, text_col, source_col = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    key = ["__id", "__no_id", "__no_source", "__source", "__size"]
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = pareto_mix(docs, **options).select(
        name("doc_id").alias("__id"), F.col("doc_id").isNull().alias("__no_id"), F.col("no_source").alias("__no_source"), F.col("source_key").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies")
    )
    found = found.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__copies")))).where("__copies > 0")
    keyed = docs.select("*", name(id_col).alias("__id"), F.col(id_col).isNull().alias("__no_id"), F.col(source_col).isNull().alias("__no_source"), name(source_col).alias("__source"), words(text_col).alias("__size"))
    numbered = keyed.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(text_or_empty(text_col)))))
    return numbered.join(found, [*key, "__n"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


_SIZED = r"""
sized AS (
  SELECT *, length(bin(size)) AS weight FROM (SELECT doc_id, (source IS NULL) AS no_source, coalesce(source, '') AS source_key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM {docs}))
"""
_TARGETS = """
sources AS (SELECT no_source, source_key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
ranked_sources AS (
  SELECT *, CAST((row_number() OVER (ORDER BY no_source, source_key) - 1) % 3 + 1 AS DOUBLE) AS weight,
         CAST(source_size AS DOUBLE) * 3.0 AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio, row_number() OVER o AS place,
         (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS lvl
  FROM ranked_sources WINDOW o AS (ORDER BY cap / weight, no_source, source_key)),
water AS (SELECT place AS first_free, lvl AS water FROM levels WHERE ratio > lvl ORDER BY place LIMIT 1),
targets AS (
  SELECT no_source, source_key, source_size,
         CASE WHEN place >= first_free THEN weight * water ELSE cap END AS target
  FROM levels LEFT JOIN water ON true),
classes AS (SELECT no_source, source_key, weight, CAST(sum(size) AS BIGINT) AS class_size FROM sized GROUP BY ALL),
class_levels AS (
  SELECT c.*, source_size, target,
         (target - 3.0 * CAST(coalesce(sum(class_size) OVER b, 0) AS DOUBLE))
         / nullif(CAST(sum(weight * class_size) OVER s - coalesce(sum(weight * class_size) OVER b, 0) AS DOUBLE), 0.0) AS lvl
  FROM classes c JOIN targets t ON c.no_source = t.no_source AND c.source_key = t.source_key
  WINDOW s AS (PARTITION BY c.no_source, c.source_key),
         b AS (PARTITION BY c.no_source, c.source_key ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
expected AS (
  SELECT *, least(CAST(3 AS DOUBLE), coalesce(max(lvl) OVER (PARTITION BY no_source, source_key), CAST(0 AS DOUBLE)) * weight) AS expected FROM class_levels),
rates AS (
  SELECT no_source, source_key, weight, source_size, target, floor(expected) AS whole, expected - floor(expected) AS part,
         target - sum(floor(expected) * class_size) OVER (PARTITION BY no_source, source_key) AS left_over
  FROM expected),
placed AS (
  SELECT s.*, source_size, target, whole, part, left_over,
         CASE WHEN part > 0 THEN (u / (1 - u)) * (1 - part) / part END AS odds
  FROM sized s JOIN rates r ON s.no_source = r.no_source AND s.source_key = r.source_key AND s.weight = r.weight),
picked AS (
  SELECT *, sum(CASE WHEN part > 0 THEN size ELSE 0 END) OVER (PARTITION BY no_source, source_key ORDER BY odds NULLS LAST, u, size, doc_id ROWS UNBOUNDED PRECEDING) AS ending FROM placed)
"""
ORACLE = (
    "WITH " + _SIZED.format(docs="documents") + "," + _TARGETS + """
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN part > 0 AND ending - size / 2.0 <= left_over THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM picked
"""
)

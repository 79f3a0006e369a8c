"""Question routing, labelers and the evaluation set.

Calls to language models are pluggable; what stands here is deterministic and needs no network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftgraph.functions import text as T
from weftgraph.schema import ROUTE


class Labeler(Protocol):
    """Names the relation that a sentence states between two titles."""

    def __call__(self, subject: str, target: str, sentence: str) -> str: ...


def labelled(pairs: DataFrame, make: Callable[[], Sequence[Labeler]], default: str = "LIEN_KET") -> DataFrame:
    """``pairs`` (source, target, sentence, ...) with ``label``.

    ``make`` is called once in each task, as clients can't be sent there; it returns models in order of
    preference.  The next one is asked when a model raises; the label is ``default`` if all do.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = list(make())

        def ask(s, t, sentence):
            for m in models:
                try:
                    return m(s, t, sentence) or default
                except Exception:  # a model that fails is passed over, whatever it raises
                    continue
            return default

        for frame in frames:
            yield frame.assign(raw_label=[ask(*row) for row in frame[["source", "target", "sentence"]].itertuples(index=False)])

    shape = StructType([*pairs.schema.fields, StructField("raw_label", StringType())])
    return pairs.mapInPandas(run, shape).withColumn("label", T.clean_label(F.col("raw_label"), default)).drop("raw_label")


def useful_labels(found: DataFrame, default: str = "LIEN_KET") -> DataFrame:
    """Rows whose label says something."""
    return found.where((F.col("label") != "") & (F.col("label") != default))


def route(answer: Column, question: Column) -> Column:
    """intent, keyword, hops from a model's answer; a one-step relation about the whole question if it can't be read."""
    parsed = F.from_json(T.json_island(answer), ROUTE)
    return F.struct(F.coalesce(parsed["intent"], F.lit("RELATION")).alias("intent"), F.coalesce(parsed["keyword"], question).alias("keyword"), F.coalesce(parsed["hops"], F.lit(1)).alias("hops"))


def rule_route(question: Column, summary_cues: Sequence[str] = ("là ai", "tiểu sử", "tóm tắt", "who is"), two_step_cues: Sequence[str] = ("gián tiếp", "bắc cầu", "through", "between")) -> Column:
    """A route by cue words alone, as JSON like a model's answer."""
    lowered = F.lower(question)
    intent = F.when(T.mentions_any(lowered, list(summary_cues)), "SUMMARY").otherwise("RELATION")
    hops = F.when(T.mentions_any(lowered, list(two_step_cues)), 2).otherwise(1)
    return F.to_json(F.struct(intent.alias("intent"), T.strip(question).alias("keyword"), hops.alias("hops")))


def yes_no_items(triples: DataFrame, yes: str = "Đúng", no: str = "Sai") -> DataFrame:
    """question, expected_answer: one true and one false question for each triple."""
    rel = T.type_words(F.col("type"))
    asked = F.concat("source", F.lit(" có quan hệ "), rel, F.lit(" với "), "target", F.lit(" phải không?"))
    denied = F.concat("source", F.lit(" không có quan hệ "), rel, F.lit(" với "), "target", F.lit(" phải không?"))
    items = F.array(F.struct(asked.alias("question"), F.lit(yes).alias("expected_answer")), F.struct(denied.alias("question"), F.lit(no).alias("expected_answer")))
    return triples.select(F.explode(items).alias("item")).select("item.*")


def parsed_items(answers: DataFrame, column: str = "answer") -> DataFrame:
    """QA items out of models' answers: the JSON list in each; nothing where it can't be read."""
    items = F.from_json(T.json_list_island(F.col(column)), "array<struct<question string, expected_answer string>>")
    return answers.select(F.explode(items).alias("item")).select("item.*")


def generating_models(models: DataFrame, method: str = "generateContent") -> DataFrame:
    """Models (name, methods) that support ``method``."""
    return models.where(F.array_contains("methods", method)).select("name")

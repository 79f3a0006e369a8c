import re

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import rule_tables as R
from weftgraph.functions import text as T
from weftgraph.functions import wikitext as W
from weftgraph.functions.rules import heaviest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


TEXTS = ["A b. Đ c! Ấ d? E", "x.  Yes.\nNo", "a. B.\x0bC", "", "  \n ", "One.Two. Three", "End. ", "a? b! c."]


@pytest.mark.parametrize("text", TEXTS)
def test_splits_equal_plain_python(spark, text):
    assert one(spark, text, T.sentences_strict) == re.split(r"(?<=[.?!])\s+(?=[A-ZĐ])", text)
    assert one(spark, text, T.sentences) == [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def test_links(spark):
    text = "[[A|b]] [[C#d]] [[Thể loại:Q]] [[ ]] [[E|f|g]] [[bro\nken]]"
    assert one(spark, text, T.link_targets) == ["A", "C#d", "E"]


def test_evidence_is_one_clipped_line(spark):
    out = one(spark, " a\nb " + "x" * 300, T.evidence)
    assert out.startswith("a b x") and len(out) == 203 and out.endswith("...")


def test_labels(spark):
    assert one(spark, " vua-1 x", lambda c: T.clean_label(c, "D")) == "VUA"
    assert one(spark, " 12", lambda c: T.clean_label(c, "D")) == "D"
    assert one(spark, "là_cha_của!", lambda c: T.clean_label_in(c, ["LÀ_CHA_CỦA"], "D")) == "LÀ_CHA_CỦA"


def test_islands(spark):
    assert one(spark, 'so {"a": {"b": 1}} ok', T.json_island) == '{"a": {"b": 1}}'
    assert one(spark, "none", T.json_island) == ""


def reference_type(sentence, rules, weights):
    found = [t for t, kws in rules.items() if any(k in sentence.lower() for k in kws)]
    return max(found, key=lambda t: weights.get(t, 1)) if found else R.GENERIC


@pytest.mark.parametrize("rules", [R.RULES_A, R.RULES_B])
def test_case_chain_equals_heaviest_first(spark, rules):
    words = sorted({k for kws in rules.values() for k in kws})
    sentences = [f"Ông {a} và {b}." for a, b in zip(words, words[7:] + words[:7], strict=True)] + ["không có gì"]
    rows = spark.createDataFrame([(s,) for s in sentences], "s string").select("s", heaviest(F.col("s"), rules).alias("t")).collect()
    assert all(r["t"] == reference_type(r["s"], rules, R.WEIGHTS) for r in rows)


def test_flip(spark):
    t = lambda s: one(spark, s, lambda c: heaviest(c, R.RULES_B, flips=R.FLIPS_B))
    assert t("cha là A, con của B") == "LÀ_CON_CỦA"
    assert t("cha là A") == "LÀ_CHA_CỦA"


def test_rule_table_sizes():
    assert (len(R.RULES_A), len(R.RULES_B), len(R.WEIGHTS), len(R.INVERSE_A), len(R.INVERSE_B)) == (18, 18, 22, 18, 16)
    assert (sum(map(len, R.RULES_A.values())), sum(map(len, R.RULES_B.values()))) == (198, 98)
    assert (len(R.DOCUMENT_PATTERNS), len(R.SENTENCE_CLASSES), len(R.LINK_CLASSES), len(R.SEEDS)) == (14, 10, 12, 13)


def test_wikitext(spark):
    page = "{{Thông tin nhân vật\n| tên = {{nowrap|[[A|b]]}}\n| tên = c\n|x=}}'''Vua''' [[Gia Long|ông]] sinh<ref>r</ref>. [[Tập tin:a.jpg|thumb|[[B]] c]] {{x|{{y}}}}"
    row = spark.createDataFrame([(page,), (None,)], "x string").select(W.parsed(F.col("x"), R.INFOBOX_CUES["crawl"]).alias("p")).select("p.*").collect()
    assert row[0]["template"] == "Thông tin nhân vật"
    assert row[0]["infobox"] == {"tên": "c", "x": ""}
    assert row[0]["links"] == ["A", "Gia Long", "Tập tin:a.jpg", "B"]
    assert row[0]["plain"].split() == ["Vua", "ông", "sinh."]
    assert row[1]["template"] is None and row[1]["links"] == []

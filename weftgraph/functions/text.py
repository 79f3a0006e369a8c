"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence ends, and capitals that may start a sentence in the strict split.
STRICT_SPLIT = r"(?U)(?<=[.?!])\s+(?=[A-ZĐ])"
PLAIN_SPLIT = r"(?U)(?<=[.!?])\s+"
EDGE_SPACE = r"(?U)^\s+|\s+$"
LINK = r"\[\[(.*?)(?:\|(.*?))?\]\]"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def sentences_strict(text: Column) -> Column:
    """Split after an end sign before an ASCII capital or Đ; nothing is trimmed or dropped."""
    return F.split(text, STRICT_SPLIT, -1)


def sentences(text: Column) -> Column:
    """Split after every end sign; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, PLAIN_SPLIT, -1), strip), lambda s: s != "")


def clip(text: Column, size: int) -> Column:
    """The first ``size`` characters and three dots, if it is longer."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def evidence(sentence: Column) -> Column:
    """One line of at most 203 characters."""
    return clip(strip(F.replace(sentence, F.lit("\n"), F.lit(" "))), 200)


def link_targets(text: Column) -> Column:
    """Targets of wiki links: stripped, without empty ones and those of a namespace; anchors stay."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(LINK), 1), strip), lambda x: (x != "") & ~F.contains(x, F.lit(":")))


def mentions_any(lowered: Column, keywords: list[str]) -> Column:
    """Whether any keyword is a substring."""
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(lowered, F.lit(k))
    return found


def clean_label(raw: Column, default: str) -> Column:
    """First token in upper case, only A to Z and underscores; ``default`` if nothing is left."""
    token = F.element_at(F.split(strip(raw), r"(?U)\s+", -1), 1)
    return F.coalesce(F.nullif(F.regexp_replace(F.upper(token), "[^A-Z_]", ""), F.lit("")), F.lit(default))


def clean_label_in(raw: Column, allowed: list[str], default: str) -> Column:
    """Upper case with Vietnamese letters kept; ``default`` unless it is one of ``allowed``."""
    token = F.regexp_replace(F.upper(strip(raw)), "[^A-Z_À-Ỹ]", "")
    return F.when(token.isin(allowed), token).otherwise(F.lit(default))


def type_words(rel_type: Column) -> Column:
    return F.lower(F.replace(rel_type, F.lit("_"), F.lit(" ")))


def json_island(text: Column) -> Column:
    """From the first opening to the last closing brace; empty if there is none."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def json_list_island(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)(\[.*\])", 1)


def first_word(title: Column) -> Column:
    return F.element_at(F.split(strip(title), r"(?U)\s+", -1), 1)


def capitalised(title: Column) -> Column:
    return title.rlike(r"^\p{IsUppercase}")

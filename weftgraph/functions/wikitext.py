"""Wiki markup: templates, links and plain text, by one scan that counts brackets.

Nested templates and links are followed to any depth.  Plain text is a good approximation: templates,
references, comments and tags go, links leave their text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REF = re.compile(r"<ref[^>/]*/>|<ref[^>]*>.*?</ref>", re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_QUOTES = re.compile(r"'{2,5}")
_HEAD = re.compile(r"^=+\s*(.*?)\s*=+\s*$", re.M)
_OUTER = re.compile(r"\[https?://\S+(?:\s+([^\]]*))?\]")


def spans(text: str, opening: str, closing: str) -> list[tuple[int, int]]:
    """Start and end of every balanced pair, in order of start; what never closes is left out."""
    open_at, found = [], []
    for m in re.finditer(re.escape(opening) + "|" + re.escape(closing), text):
        if m[0] == opening:
            open_at.append(m.start())
        elif open_at:
            found.append((open_at.pop(), m.end()))
    return sorted(found)


def split_top(body: str) -> list[str]:
    """Parts between bars that no template or link encloses."""
    parts, depth, last = [], 0, 0
    for m in re.finditer(r"\{\{|\}\}|\[\[|\]\]|\|", body):
        if m[0] in ("{{", "[["):
            depth += 1
        elif m[0] in ("}}", "]]"):
            depth -= 1
        elif depth == 0:
            parts.append(body[last : m.start()])
            last = m.end()
    return [*parts, body[last:]]


def templates(text: str) -> list[tuple[str, dict[str, str]]]:
    """Name and parameters of every template, outer before inner; unnamed ones are numbered, the last of equal names stays."""
    out = []
    for a, b in spans(_COMMENT.sub("", text), "{{", "}}"):
        name, *rest = split_top(_COMMENT.sub("", text)[a + 2 : b - 2])
        params, number = {}, 0
        for part in rest:
            key, eq, value = part.partition("=")
            if eq and "{{" not in key and "[[" not in key:
                params[key.strip()] = value.strip()
            else:
                number += 1
                params[str(number)] = part.strip()
        out.append((name.strip(), params))
    return out


def links(text: str) -> list[str]:
    """Targets of wiki links, repeats kept."""
    clean = _COMMENT.sub("", text)
    return [split_top(clean[a + 2 : b - 2])[0].strip() for a, b in spans(clean, "[[", "]]")]


def plain(text: str) -> str:
    """The text a reader sees, about."""
    out = _REF.sub("", _COMMENT.sub("", text))
    for opening, closing in (("{{", "}}"), ("{|", "|}")):
        cut, last = [], 0
        for a, b in spans(out, opening, closing):
            if a >= last:
                cut.append(out[last:a])
                last = b
        out = "".join(cut) + out[last:]
    while found := spans(out, "[[", "]]"):
        a, b = found[-1]  # the last one to start holds no other
        target, *rest = split_top(out[a + 2 : b - 2])
        shown = "" if ":" in target and not target.startswith(":") and rest and re.match(r"(?i)\s*(file|image|tập tin|hình|category|thể loại)\s*:", target) else (rest[-1] if rest else target)
        out = out[:a] + shown + out[b:]
    out = _OUTER.sub(lambda m: m[1] or "", out)
    return _HEAD.sub(r"\1", _QUOTES.sub("", _TAG.sub("", out)))


PARSED = "template string, infobox map<string,string>, links array<string>, plain string"


def parsed(wikitext: Column, cues: Sequence[str], keep_empty: bool = True, strip_values: bool = False) -> Column:
    """template, infobox, links, plain of a page.

    The infobox is the first template whose lowered name holds a cue; null template without one.  Crawling
    keeps raw values, seed builders strip markup and leave out empty values.
    """

    @F.pandas_udf(PARSED)
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            page = page or ""
            box = next(((n, p) for n, p in templates(page) if any(c in n.lower() for c in cues)), (None, {}))
            values = {k: plain(v).strip() if strip_values else v for k, v in box[1].items()}
            rows.append((box[0], {k: v for k, v in values.items() if keep_empty or v}, links(page), plain(page)))
        return pd.DataFrame(rows, columns=["template", "infobox", "links", "plain"])

    return run(wikitext)


def person_template(template: Column, cues: Sequence[str]) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(F.lower(template), c)), F.lit(False))

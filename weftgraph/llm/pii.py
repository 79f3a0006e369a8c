"""Personal data by weak supervision.

Base spans (email, ip, card, phone) are fixed by pattern and check, and always kept.  Looser patterns
propose more candidates.  On every candidate, base spans included, five labelers vote yes, no or
nothing: the strict pattern, a checksum or structure test, a gazetteer, the words around, and the
signs right beside it.  Votes are counted over the whole corpus by kind and vote pattern, a table
whose size does not depend on the corpus; expectation-maximisation over it estimates how reliable
each labeler is on true and false candidates, and a logistic span classifier is trained on the
resulting probabilities.  A second pass adds the candidates that it accepts.

All patterns run in time linear in the text: runs are matched from their first sign only, and what has
been matched is not tried again.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import documents, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "person")
LABELERS = ("pattern", "structure", "gazetteer", "context", "border")
#: A candidate is added from this probability on.
ACCEPT = 0.9
#: Characters before a candidate that the context labeler reads.
BEFORE = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[A-Za-z0-9-]{1,63}){1,4}"),
    "phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"),
    "person": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?"),
}
#: Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es it uk nl eu us ca au ch at be jp cn in br ru mx pl se no fi dk pt gr cz ie".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "6011", "65", "34", "37", "35")
COUNTRIES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "64", "65", "7", "81", "82", "84", "86", "90", "91")
GIVEN_NAMES = frozenset("James Mary John Anna Michael Maria David Sarah Peter Laura Thomas Julia Paul Emma Robert Linda Marie Hans Pierre Carlos Jose Ana Luis Klaus".split())
CLUES = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "mastercard", "amex", "payment", "credit"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell"),
    "ssn": ("ssn", "social security", "tax id"),
    "person": ("dear", "name", "signed", "regards"),
}
COUNTER_CLUES = ("version", "isbn", "order", "invoice", "price", "build", "figure", "section", "issn", "doi")


def luhn(digits: str) -> bool:
    """Whether the digits pass the check of payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def at_most_255(digits: str) -> bool:
    """Digit runs may be of any length, leading zeros included."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def matches(text: str) -> dict[str, list[tuple[int, int, bool]]]:
    """Pattern matches by base kind, and whether each passes its check."""
    found: dict[str, list[tuple[int, int, bool]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        found["email"] = [(a, b, True) for a, b in _emails(text)]
    if "." in text:
        found["ip"] = [(m.start(), m.end(), all(at_most_255(p) for p in m[0].split("."))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        digits = digits_of(m[0])
        found["card"].append((m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        found["phone"] = [(m.start(), m.end(), 8 <= len(digits_of(m[0])) <= 15) for m in _PHONE.finditer(text)]
    return found


def apart(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans with overlapping ones joined, in order."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, is base): base spans, matches that fail their check, loose matches beside base spans."""
    out: list[tuple[str, int, int, bool]] = []
    for kind, spans in matches(text).items():
        for a, b, good in spans:
            # Short digit strings are numbers, not failed cards.
            if good or kind != "card" or b - a >= 13:
                out.append((kind, a, b, good))
    starts, ends = apart([(a, b) for _, a, b, good in out if good])
    for kind, pattern in _LOOSE.items():
        if kind == "email" and "(" not in text and "[" not in text:
            continue
        for m in pattern.finditer(text):
            at = bisect_right(ends, m.start())
            if at == len(ends) or starts[at] >= m.end():
                out.append((kind, m.start(), m.end(), False))
    return out


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The labelers' votes (1, 0, -1) on a candidate."""
    span = text[start:end]
    digits = digits_of(span)
    if kind == "card":
        structure = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    elif kind == "phone":
        structure = 1 if 8 <= len(digits) <= 15 else -1
        gazetteer = (1 if digits.startswith(COUNTRIES) else -1) if span[0] == "+" else 0
    elif kind == "ip":
        parts = [int(p[-4:]) for p in span.split(".")]
        structure = 1 if max(parts) <= 255 else -1
        gazetteer = -1 if parts[0] in (0, 127, 255) else 0
    elif kind == "email":
        structure = 1 if len(span) <= 254 and ".." not in span else -1
        gazetteer = 1 if re.split(r"[.)\] ]", span.rstrip(")] "))[-1].lower() in TOP_DOMAINS else -1
    elif kind == "ssn":
        structure = 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
        gazetteer = 0
    else:
        structure = 0
        gazetteer = 1 if any(w in GIVEN_NAMES for w in span.split()[1:]) else 0
    before = text[max(0, start - BEFORE) : start].lower()
    context = 1 if any(re.search(r"\b" + re.escape(c), before) for c in CLUES[kind]) else -1 if any(c in before for c in COUNTER_CLUES) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    border = -1 if left.isalnum() or right.isalnum() else 1
    return (1 if base else -1 if kind in ("ip", "card") else 0), structure, gazetteer, context, border


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of labelers and the span classifier's weights, by kind."""

    reliability: dict[str, np.ndarray]
    weights: dict[str, np.ndarray]

    def probability(self, kind: str, cast: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-float(np.clip(features(cast) @ self.weights[kind], -30, 30))))


def features(cast: tuple[int, ...]) -> np.ndarray:
    """Intercept, and for each labeler whether it said yes or no."""
    return np.array([1.0, *[float(v == 1) for v in cast], *[float(v == -1) for v in cast]])


def estimate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 60) -> SpanModel:
    """Dawid-Skene expectation-maximisation by kind over vote patterns, then the classifier on its probabilities.

    ``reliability[kind][truth, labeler, vote + 1]`` starts better than chance and keeps those starting
    values as ``prior`` pseudo-counts, which decide where a kind has few candidates.
    """
    prior, reliability, weights = 20.0, {}, {}
    start = np.array([[0.35, 0.5, 0.15], [0.1, 0.4, 0.5]])
    for kind in KINDS:
        patterns = sorted(p for k, p in counts if k == kind)
        n = np.array([counts[kind, p] for p in patterns], float)
        cast = np.array(patterns, int).reshape(-1, len(LABELERS))
        theta = np.repeat(start[:, None, :], len(LABELERS), axis=1)
        share = 0.5
        truth = np.zeros(len(patterns))
        for _ in range(rounds if len(patterns) else 0):
            like = np.log([1 - share, share])[:, None] + np.stack([np.log(theta[t, np.arange(len(LABELERS)), cast + 1]).sum(axis=1) for t in (0, 1)])
            truth = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
            share = (n @ truth + prior / 2) / (n.sum() + prior)
            for t, w in enumerate((n * (1 - truth), n * truth)):
                for j in range(len(LABELERS)):
                    seen = np.bincount(cast[:, j] + 1, weights=w, minlength=3) + prior * start[t]
                    theta[t, j] = seen / seen.sum()
        reliability[kind] = theta
        # The classifier sees each pattern with its count, plus the naive reading of every single vote as a prior.
        x = np.array([features(p) for p in patterns]).reshape(-1, 1 + 2 * len(LABELERS))
        w = np.concatenate([[math.log(share / (1 - share))], np.log(theta[1, :, 2] / theta[0, :, 2]), np.log(theta[1, :, 0] / theta[0, :, 0])])
        anchor = w.copy()
        scale = n / max(n.sum(), 1.0) * min(n.sum(), 1000.0)
        for _ in range(30 if len(patterns) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = x.T @ (x * (scale * p * (1 - p))[:, None]) + np.eye(len(w))
            w = w + np.linalg.solve(hessian, x.T @ (scale * (truth - p)) - (w - anchor))
        weights[kind] = w
    return SpanModel(reliability, weights)


def count_votes(docs: DataFrame, *, text_col: str = "text") -> dict[tuple[str, tuple[int, ...]], int]:
    """How often each kind and vote pattern occurs in all texts; at most ``6 * 3 ** 5`` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                for kind, a, b, base in candidates(text):
                    seen[kind, ",".join(map(str, votes(text, kind, a, b, base)))] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["kind", "pattern", "n"])

    rows = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "kind string, pattern string, n long").groupBy("kind", "pattern").agg(F.sum("n").alias("n")).collect()
    return {(r["kind"], tuple(map(int, r["pattern"].split(",")))): r["n"] for r in rows}


def spans_of(text: str, model: SpanModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, by kind as listed and then by start."""
    base, every = [], []
    for kind, a, b, good in candidates(text):
        if good:
            base.append((kind, a, b))
            every.append((kind, a, b))
        elif model.probability(kind, votes(text, kind, a, b, good)) >= ACCEPT:
            every.append((kind, a, b))
    key = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return sorted(base, key=key), sorted(set(every), key=key)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_spans, spans; one row per row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, joined by commas.  A null text is
    empty and has none.  Texts are read whole, in time linear in their length.  Null and repeated ids are
    kept, further columns are not looked at.  No rows in, no rows out.
    """
    model = model or estimate(count_votes(docs, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                base, every = spans_of(value.as_py(), model)
                n = Counter(k for k, _, _ in base)
                rows.append((*[n[k] for k in BASE_KINDS], written(base), written(every)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"])

    shape = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, shape)


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    """``find_personal_data`` over all documents, the base spans as a digest."""
    found = find_personal_data(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans")

"""Cutting text into the pieces that byte-level BPE merges within, and files of the shared folder.

A piece is a contraction, or letters, digits or other signs with a space before, or white space; the
last space before a sign belongs to the sign.  Texts of Latin letters take Python's ``re``; any other
sign sends the text to ``regex`` with full Unicode classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import regex

#: The letters that the quick pattern knows, and white space as Unicode has it.
LATIN = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ"
SPACES = r"\t-\r \x85\xa0  -     　"
PLAIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^{SPACES}{LATIN}0-9]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
FULL = regex.compile(rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Any sign that the two patterns might see otherwise.
ODD = re.compile(r"[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af]")
#: A sign that is neither letter, digit nor space.
SIGN = "\u00a7"


#: Code points that ``regex`` takes for letters or digits and Unicode 16, which the
#: published tokenizers follow, does not.
NEWER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd
a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a
11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128
1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479
3d000-3fc3f
"""


@lru_cache(1)
def newer() -> dict[int, str]:
    """Those code points, each as a sign."""
    spans = (span.split("-") for span in NEWER.split())
    return {c: SIGN for a, b in spans for c in range(int(a, 16), int(b, 16) + 1)}


def each_piece(text: str) -> Iterator[str]:
    """The pieces of ``text`` one by one."""
    if not ODD.search(text):
        return (m[0] for m in PLAIN.finditer(text))
    seen = text.translate(newer())
    return (text[m.start() : m.end()] for m in FULL.finditer(seen))


def pieces(text: str) -> list[str]:
    """The pieces of ``text``, which together are the text."""
    if not ODD.search(text):
        return PLAIN.findall(text)
    seen = text.translate(newer())
    if seen == text:
        return FULL.findall(text)
    return [text[m.start() : m.end()] for m in FULL.finditer(seen)]

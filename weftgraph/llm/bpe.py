"""Byte-pair encoding and decoding as streams with bounded memory.

Encoding.  Text is cut into pieces (``pretokens``); within a piece the merge list decides.  The
transducer reads a piece byte by byte.  For each position it keeps the last token of the encoding of
the bytes so far; that token is the one whose pair with the last token before it is stable under the
merge list, and it is unique.  Following last tokens backwards gives the encoding of any prefix.
Only tokens that end at the position are tried; an automaton of the vocabulary names them.

A later byte can change an earlier token only by a chain of merges that each take away the right-hand
part of what the merge before it needed, each of an earlier rank.  ``sufficient_lookahead`` adds up the bytes
along the longest such chain of the merge list.  Once so many bytes have been read beyond a token's
end, it is emitted and its state dropped; so memory is bounded by the merge list, not by the piece.

Short pieces recur; a worker remembers the ids of a bounded number of them.

Decoding.  Ids become bytes, bytes become text by an incremental UTF-8 state machine which holds at
most three bytes between tokens and puts U+FFFD for what is no UTF-8.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.pretokens import each_piece, pieces
from weftgraph.llm.shared import documents, given_back, text_or_empty

#: Pieces of at most so many bytes are remembered, so many of them a round; when full, those of the round
#: before go, and what is seen again is taken over from the round that ended.
SHORT = 64
REMEMBERED = 150_000
#: Longer texts, in characters, go through piece by piece.
LONG = 1_000_000


def byte_signs() -> dict[str, int]:
    """The printable sign that a byte-level vocabulary writes for each byte, and that byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeList:
    """A byte-level vocabulary with ranked merges, read from a tokenizer file."""

    #: First bytes of pieces whose states are remembered, and of how many pieces.
    HEAD, MOST_HEADS = 6, 100_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        signs = byte_signs()
        as_bytes = lambda s: bytes(signs[c] for c in s)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.vocab = {as_bytes(s): i for s, i in model["model"]["vocab"].items() if s not in self.special}
        self.text = {i: b for b, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        #: (left id, right id) to (rank, merged id)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        #: merged id to its (rank, left id, right id)
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(pairs):
            a, b = as_bytes(left), as_bytes(right)
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((x, y), (rank, z))
            self.made.setdefault(z, (rank, x, y))
        self.longest = max(map(len, self.vocab))
        #: Tokens that merges can make, and single bytes.
        self.usable = {b: i for b, i in self.vocab.items() if len(b) == 1 or i in self.made}
        self.width = max(self.text) + 1
        #: Whether pairs are stable, by left id * width + right id.
        self.known: dict[int, bool] = {}
        self._build_automaton()
        #: Further transitions are remembered up to this number.
        self.most_steps = 4 * len(self.step)
        self.heads: dict[bytes, tuple[int, tuple[int | None, ...]]] = {}
        self.sizes = [len(self.text.get(i, b"")) for i in range(self.width)]

    def _build_automaton(self) -> None:
        """States are beginnings of tokens; one holds the longest end of the bytes read that is a beginning.

        ``step[state << 8 | byte]`` is the state of the longer beginning, ``fall[state]`` that of its longest
        proper end, ``ending[state]`` all usable tokens that it ends with, as (id, length), longest first.
        """
        self.step: dict[int, int] = {}
        own: list[int | None] = [None]
        byte_of, parent, depth = [0], [0], [0]
        for token, number in self.usable.items():
            state = 0
            for byte in token:
                to = self.step.get(state << 8 | byte)
                if to is None:
                    to = self.step[state << 8 | byte] = len(own)
                    own.append(None)
                    byte_of.append(byte)
                    parent.append(state)
                    depth.append(depth[state] + 1)
                state = to
            own[state] = number
        self.fall = [0] * len(own)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        for state in sorted(range(1, len(own)), key=depth.__getitem__):
            if parent[state]:
                self.fall[state] = self.next_state(self.fall[parent[state]], byte_of[state])
            shorter = self.ending[self.fall[state]]
            self.ending[state] = shorter if own[state] is None else ((own[state], depth[state]), *shorter)

    def next_state(self, state: int, byte: int) -> int:
        while (to := self.step.get(state << 8 | byte)) is None and state:
            state = self.fall[state]
        return to or 0

    @property
    def sufficient_lookahead(self) -> int:
        """Bytes beyond a token's end after which no further byte can change it.

        ``by_left[t]`` is the most bytes that a chain can reach whose first merge, of a rank seen so
        far, has ``t`` on its left; ``spine[t]`` the same for merges that break ``t`` itself from its
        right end.  A merge (x, y) is undone by one of an earlier rank that takes y, or a right end of
        y before y was made, so its reach is y's length plus the larger of the two.
        """
        if not hasattr(self, "_lookahead"):
            by_left: dict[int, int] = {}
            spine: dict[int, int] = {}
            most = 0
            for (x, y), (_, z) in sorted(self.rank.items(), key=lambda kv: kv[1][0]):
                reach = len(self.text[y]) + max(by_left.get(y, 0), spine.get(y, 0))
                if z not in spine:
                    spine[z] = max(by_left.get(y, 0), spine.get(y, 0))
                by_left[x] = max(by_left.get(x, 0), reach)
                most = max(most, reach)
            self._lookahead = most + self.longest
        return self._lookahead

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are what the merge list makes of their bytes.

        The tokens are taken apart from the inside, latest merge first: a merge of both sides' inner
        ends that ranks before either side's own last merge would have come first.
        """
        if (known := self.known.get(left * self.width + right)) is not None:
            return known
        x, y, limit, ok = left, right, len(self.rank) + 1, True
        while True:
            found = self.rank.get((x, y))
            if found is not None and found[0] < limit:
                ok = False
                break
            a, b = self.made.get(x), self.made.get(y)
            if a is None and b is None:
                break
            # On equal terms the left side, which is scanned first, is undone last.
            if b is None or a is not None and a[0] > b[0]:
                limit, x = a[0], a[2]
                # a merge of the same rank further left comes first
                found = self.rank.get((x, y))
                if found is not None and found[0] < limit:
                    ok = False
                    break
            else:
                limit, y = b[0] + 1, b[1]
                found = self.rank.get((x, y))
                if found is not None and found[0] < limit:
                    ok = False
                    break
        if len(self.known) > 1_000_000:
            self.known.clear()
        self.known[left * self.width + right] = ok
        return ok


    def extended(self, data: bytes | memoryview, last: list[int | None], state: int) -> int:
        """Read ``data``, adding each position's last token to ``last``; returns the automaton's state."""
        step, fall, ending, known, width = self.step, self.fall, self.ending, self.known, self.width
        end = len(last)
        for byte in data:
            at = state << 8 | byte
            to = step.get(at)
            if to is None:
                to = self.next_state(state, byte)
                if len(step) < self.most_steps:
                    step[at] = to  # next time at once
            state = to
            found = None
            # Longest token first: the first one that is stable after what stands before it.
            for token, size in ending[state]:
                if (start := end - size) > 0:
                    before = last[start]
                    if before is None:
                        continue
                    if (ok := known.get(before * width + token)) is None:
                        ok = self.stable(before, token)
                    if ok:
                        found = token
                        break
                elif not start:
                    before = last[0]
                    if before is None or self.stable(before, token):
                        found = token
                        break
            last.append(found)
            end += 1
        return state

    def encoded(self, data: bytes) -> bytes:
        """Ids of a short piece: what a transducer does until it is fed so much that it emits, in one go.

        What has been read after a piece's first bytes is remembered, as many pieces begin alike.
        """
        head = data[: self.HEAD]
        start = self.heads.get(head)
        if start is None:
            if len(self.heads) >= self.MOST_HEADS:
                self.heads.clear()
            last: list[int | None] = [None]
            start = self.heads[head] = (self.extended(head, last, 0), tuple(last))
        last = list(start[1])
        if len(data) > self.HEAD:
            self.extended(data[self.HEAD :], last, start[0])
        out, end, sizes = [], len(data), self.sizes
        while end:
            token = last[end]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)


class Transducer:
    """Encodes one piece that comes in chunks of bytes; ``feed`` and ``finish`` return stable ids."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.look = merges.sufficient_lookahead
        self.buffer = bytearray()
        #: last token of each prefix of the buffer that is held; None where no token ends
        self.last: list[int | None] = [None]
        self.state = 0

    def _extend(self) -> None:
        self.state = self.m.extended(memoryview(self.buffer)[len(self.last) - 1 :], self.last, self.state)

    def _path(self, end: int) -> list[int]:
        out, text = [], self.m.text
        while end > 0 and self.last[end] is not None:
            out.append(self.last[end])
            end -= len(text[self.last[end]])
        return out[::-1]

    def feed(self, chunk: bytes) -> list[int]:
        self.buffer += chunk
        self._extend()
        if len(self.buffer) < 2 * self.look:
            return []
        # What ends at least `look` bytes before the end can't change; the last such token is kept as the left neighbour.
        out, at = [], 0
        for token in self._path(len(self.buffer)):
            if at + len(self.m.text[token]) > len(self.buffer) - self.look:
                break
            out.append(token)
            at += len(self.m.text[token])
        if out:
            del self.buffer[:at]
            self.last = self.last[at:]  # position 0 now holds the last emitted token
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.buffer))
        self.buffer, self.last, self.state = bytearray(), [None], 0
        return out


class BpeCodec:
    """Whole texts to ids and back, by the transducer and the state machine."""

    CHUNK = 4096

    def __init__(self, path: str):
        self.merges = MergeList(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        special = sorted(self.merges.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        size = max(self.merges.text) + 1
        self.bytes_of = [self.merges.text.get(i, b"") for i in range(size)]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that isn't among the known ones of this round."""
        out = self.older.get(piece)
        if out is None:
            data = piece.encode()
            if len(data) > SHORT:
                return self._transduced(data)
            out = self.merges.encoded(data)
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        self.known[piece] = out
        return out

    def _transduced(self, data: bytes) -> bytes:
        transducer = Transducer(self.merges)
        ids: list[int] = []
        for lo in range(0, len(data), self.CHUNK):
            ids += transducer.feed(data[lo : lo + self.CHUNK])
        ids += transducer.finish()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_stream(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, piece by piece."""
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                yield np.array([self.merges.special[part]], "<u4").tobytes()
                continue
            for piece in each_piece(part):
                found = self.known.get(piece)
                yield self._piece(piece) if found is None else found

    def encode(self, text: str) -> bytes:
        """As :meth:`encode_stream`, joined; pieces are looked up all at once."""
        if self.cut and self.cut.search(text):
            return b"".join(self.encode_stream(text))
        cut = pieces(text)
        found = list(map(self.known.get, cut))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._piece(cut[i]) if (ids := self.known.get(cut[i])) is None else ids
        return b"".join(found)

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := machine.decode(self.bytes_of[i]):
                yield out
        if out := machine.decode(b"", True):
            yield out

    def decode(self, ids: bytes, span: int = 4096) -> str:
        """As :meth:`decode_stream`, some thousand tokens at a step."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        numbers = np.frombuffer(ids, "<u4")
        out = []
        for lo in range(0, len(numbers), span):
            out.append(machine.decode(b"".join(map(self.bytes_of.__getitem__, numbers[lo : lo + span].tolist()))))
        out.append(machine.decode(b"", True))
        return "".join(out)


    def digest(self, text: str, with_ids: bool = False) -> tuple[int, str, str, bytes | None]:
        """Number of ids, SHA-256 of ids and of the decoded text, and the ids if asked for.

        Long texts go through as streams: pieces, ids and decoded text are never whole in memory.
        """
        if len(text) <= LONG:
            ids = self.encode(text)
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest(), ids if with_ids else None
        n, of_ids, of_text, kept = 0, hashlib.sha256(), hashlib.sha256(), []
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in self.encode_stream(text):
            n += len(ids) // 4
            of_ids.update(ids)
            of_text.update(machine.decode(b"".join(map(self.bytes_of.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))).encode())
            if with_ids:
                kept.append(ids)
        of_text.update(machine.decode(b"", True).encode())
        return n, of_ids.hexdigest(), of_text.hexdigest(), b"".join(kept) if with_ids else None


@lru_cache(1)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian u32) and decoded text, one row per row of ``docs``.

    A null text is encoded as the empty one: no ids, empty decoded text.  Null and repeated document
    ids are kept as they are.  No rows in, no rows out.
    """

    def run(batches):
        coder = codec(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode(text.as_py())
                rows.append((doc_id, len(ids) // 4, ids, coder.decode(ids)))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_tokens", "ids", "decoded"])

    shape = "doc_id long, n_tokens long, ids binary, decoded string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(lambda batches: given_back(run(batches), codec), shape)


def digests(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for; else as :func:`encode_documents`."""

    def run(batches):
        coder = codec(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append((doc_id, *coder.digest(text.as_py(), with_ids)))
            columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            width = 4 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:width], kinds, strict=False)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:width])

    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(lambda batches: given_back(run(batches), codec), shape)


def op5_bpe_stream(spark, sf_dir: str) -> DataFrame:
    """``digests`` of all documents."""
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

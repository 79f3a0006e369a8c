"""Token ids in files of patched frame-of-reference blocks.

A file holds three columns of unsigned numbers: document ids (as steps from the one before), document
lengths, and token ids.  Each column is cut into blocks of ``BLOCK`` values:

* the block's minimum is subtracted;
* the rest is packed at the width that a percentile of the block's values needs, 64 values to as many
  64-bit words as the width has bits;
* values that need more go to an exception list of positions and high parts.

Layout, little-endian: ``MAGIC``; the blocks; for each column an index of its blocks' starts in the
file; a footer with counts, index places and ``MAGIC`` again.  Any block can be read by itself.

Block: minimum u64, width u8, values u16, exceptions u16, packed words u64 each, positions u16 each,
high parts u64 each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

MAGIC = b"PFORBLK1"
BLOCK = 1024
PERCENTILE = 0.95
HEAD = struct.Struct("<QBHH")
FOOT = struct.Struct("<QQQQQQQQq")
COLUMNS = ("doc_ids", "lengths", "tokens")


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below ``2 ** width`` as rows of ``width`` words."""
    out = np.zeros((len(values), width), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, word] |= values[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, i] >> np.uint64(64 - shift)
    return out


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """What :func:`pack` packed."""
    out = np.zeros((len(packed), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        column = packed[:, word] >> np.uint64(shift)
        if shift + width > 64:
            column = column | (packed[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = column & mask
    return out


def encode_blocks(values: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of ``values`` (u64), the last one perhaps short."""
    n = len(values)
    if not n:
        return []
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, values[-1], np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, BLOCK)
    least = grid.min(axis=1)
    rest = grid - least[:, None]
    count = np.full(blocks, BLOCK)
    count[-1] = n - (blocks - 1) * BLOCK
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    limit = np.partition(rest, at, axis=1)[:, at]
    widths = [int(x).bit_length() for x in limit]
    out: list[bytes] = [b""] * blocks
    for width in set(widths):
        chosen = [b for b in range(blocks) if widths[b] == width]
        part = rest[chosen]
        high = part >> np.uint64(width) if width < 64 else np.zeros_like(part)
        packed = pack((part & np.uint64((1 << width) - 1)).reshape(-1, 64), width).reshape(len(chosen), -1)
        for row, b in enumerate(chosen):
            where = np.flatnonzero(high[row][: count[b]]).astype("<u2")
            out[b] = b"".join(
                (HEAD.pack(int(least[b]), width, int(count[b]), len(where)), packed[row].astype("<u8").tobytes(), where.tobytes(), high[row][where].astype("<u8").tobytes())
            )
    return out


def decode_blocks(data: bytes | memoryview, starts: list[int]) -> np.ndarray:
    """The values of many blocks, unpacked together where their widths are equal."""
    heads = [HEAD.unpack_from(data, at) for at in starts]
    values = np.zeros((len(starts), BLOCK), np.uint64)
    per_bit = BLOCK // 64
    for width in {h[1] for h in heads}:
        chosen = [i for i, h in enumerate(heads) if h[1] == width]
        if width:
            packed = np.concatenate([np.frombuffer(data, "<u8", per_bit * width, starts[i] + HEAD.size) for i in chosen])
            values[chosen] = unpack(packed.reshape(-1, width), width).reshape(len(chosen), BLOCK)
    for i, (_, width, _, exceptions) in enumerate(heads):
        if exceptions:
            at = starts[i] + HEAD.size + 8 * per_bit * width
            where = np.frombuffer(data, "<u2", exceptions, at)
            high = np.frombuffer(data, "<u8", exceptions, at + 2 * exceptions)
            values[i, where] |= high << np.uint64(width) if width < 64 else high
    values += np.array([h[0] for h in heads], np.uint64)[:, None]
    counts = np.array([h[2] for h in heads])
    return values.reshape(-1) if (counts == BLOCK).all() else values[np.arange(BLOCK) < counts[:, None]]


class TokenFileWriter:
    """Writes documents as they come; holds a chunk of tokens and 16 bytes a document."""

    CHUNK = BLOCK * 256

    def __init__(self, file: BinaryIO):
        self.file = file
        self.at = file.write(MAGIC)
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_tokens = 0
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        self.index: dict[str, list[int]] = {c: [] for c in COLUMNS}

    def _put(self, column: str, values: np.ndarray) -> None:
        for block in encode_blocks(values):
            self.index[column].append(self.at)
            self.file.write(block)
            self.at += len(block)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Ids ascend, null ones first."""
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.n_pending += len(ids)
        self.n_tokens += len(ids)
        if self.n_pending >= self.CHUNK:
            values = np.concatenate(self.pending)
            cut = len(values) // BLOCK * BLOCK
            self._put("tokens", values[:cut].astype(np.uint64))
            self.pending, self.n_pending = [values[cut:]], len(values) - cut

    def close(self) -> int:
        """Write the rest; returns the file's bytes."""
        if self.n_pending:
            self._put("tokens", np.concatenate(self.pending).astype(np.uint64))
        known = [x for x in self.doc_ids if x is not None]
        first = known[0] if known else 0
        steps = np.diff(np.array(known, np.int64).view(np.uint64), prepend=np.array([first], np.int64).view(np.uint64)) if known else np.array([], np.uint64)
        self._put("doc_ids", steps)
        self._put("lengths", np.array(self.lengths, np.uint64))
        places = []
        for c in COLUMNS:
            places += [self.at, len(self.index[c])]
            self.at += self.file.write(np.array(self.index[c], "<u8").tobytes())
        self.at += self.file.write(FOOT.pack(len(self.lengths), len(self.lengths) - len(known), *places, first)) + self.file.write(MAGIC)
        return self.at


class TokenFileReader:
    """Random access to a file: ``read_at(start, length)`` gives its bytes."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        end = read_at(size - FOOT.size - len(MAGIC), FOOT.size + len(MAGIC))
        if end[FOOT.size :] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_null, *places, self.first = FOOT.unpack(end[: FOOT.size])
        self.index = {}
        for i, c in enumerate(COLUMNS):
            at, n = places[2 * i : 2 * i + 2]
            self.index[c] = np.frombuffer(read_at(at, 8 * n), "<u8").astype(np.int64)
        # The columns are written one after the other, so each block ends where the next starts.
        starts = np.concatenate([self.index["tokens"], self.index["doc_ids"], self.index["lengths"], [places[0]]]).astype(np.int64)
        self.ends = dict(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))

    def column(self, name: str, span: int = 64) -> Iterator[np.ndarray]:
        """The column's values, some blocks at a time."""
        index = self.index[name]
        for lo in range(0, len(index), span):
            some = index[lo : lo + span].tolist()
            data = self.read_at(some[0], self.ends[some[-1]] - some[0])
            yield decode_blocks(data, [at - some[0] for at in some])

    def whole(self, name: str) -> np.ndarray:
        return np.concatenate([np.array([], np.uint64), *self.column(name)])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and token ids, with only some blocks held."""
        steps = self.whole("doc_ids")
        known = (np.cumsum(steps, dtype=np.uint64) + np.array([self.first], np.int64).view(np.uint64)).view(np.int64) if len(steps) else []
        doc_ids = [None] * self.n_null + [int(x) for x in known]
        chunks = self.column("tokens")
        held = np.array([], np.uint64)
        for doc_id, n in zip(doc_ids, self.whole("lengths").tolist(), strict=True):
            if len(held) < n:
                parts, have = [held], len(held)
                while have < n:
                    parts.append(next(chunks))
                    have += len(parts[-1])
                held = np.concatenate(parts)
            yield doc_id, held[:n]
            held = held[n:]

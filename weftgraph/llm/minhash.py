"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

A document's distinct five-word shingles are hashed once.  The top bits of a hash choose one of
``BINS`` bins; each bin keeps its smallest hash.  An empty bin borrows from another one: for bin ``i``
and attempt ``a`` a fixed random table names a bin, and the first attempt that meets a filled one
counts, the same for every document (optimal densification).  Of each bin's value the low ``LOW``
bits are stored, so a fingerprint has ``BINS * LOW / 8`` bytes.  Two bins agree by chance with
probability ``2 ** -LOW``; the estimate of likeness takes that out.

Shingle hashes are computed for a batch of texts at once: word hashes are polynomials over the bytes,
taken from running sums, and five of them are mixed into a shingle's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import documents, partitions, text_or_empty

BINS = 512
LOW = 4
SHINGLE = 5
ATTEMPTS = 4096
#: Texts are hashed together up to so many bytes; a longer text is alone.
TOGETHER = 1 << 20

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


_inverse = np.uint64(pow(int(_BASE), -1, 2**64))


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles, and each one's text number; fewer words make one shingle."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.array([], np.uint64), np.array([], np.int64)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.array([], np.uint64), np.array([], np.int64)
    # A word's polynomial: its part of the running sum, brought back to power 0.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data) - 1))])
    back = powers(_inverse, len(data))
    words = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    owner = np.searchsorted(text_ends, starts, side="right")
    n = len(words)
    full = np.zeros(n, bool)
    full[: max(0, n - size + 1)] = owner[: max(0, n - size + 1)] == owner[size - 1 :] if n >= size else False
    at = np.flatnonzero(full)
    hashes = np.zeros(len(at), np.uint64)
    for k in range(size):
        hashes = mix(hashes + words[at + k] + np.uint64(k))
    owners = owner[at]
    # Texts of fewer words: all of them are one shingle.
    counts = np.bincount(owner, minlength=len(texts))
    first = np.searchsorted(owner, np.arange(len(texts)))
    short = [t for t in np.flatnonzero((counts > 0) & (counts < size))]
    extra = np.zeros(len(short), np.uint64)
    for i, t in enumerate(short):
        value = np.zeros(1, np.uint64)
        for k in range(counts[t]):
            value = mix(value + words[first[t] + k : first[t] + k + 1] + np.uint64(k))
        extra[i] = value[0]
    return np.concatenate([hashes, extra]), np.concatenate([owners, np.array(short, np.int64)])


_table: np.ndarray | None = None


def choices() -> np.ndarray:
    """For each attempt and bin the bin to borrow from; fixed for all documents and sessions."""
    global _table
    if _table is None:
        numbers = np.arange(ATTEMPTS * BINS, dtype=np.uint64).reshape(ATTEMPTS, BINS)
        _table = (mix(numbers + np.uint64(77)) % np.uint64(BINS)).astype(np.int64)
    return _table


def densify(bins: np.ndarray, empty: np.uint64) -> np.ndarray:
    """Rows of bins with the empty ones filled; rows without any value stay empty."""
    filled = bins != empty
    out = bins.copy()
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    table = choices()
    for attempt in range(ATTEMPTS):
        if not len(row):
            return out
        source = table[attempt][col]
        hit = filled[row, source]
        out[row[hit], col[hit]] = bins[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    for r, c in zip(row.tolist(), col.tolist(), strict=True):  # beyond the table: the next filled bin round the circle
        out[r, c] = bins[r, (c + 1 + int(np.argmax(np.roll(filled[r], -c - 1)))) % BINS]
    return out


def signatures(texts: list[str]) -> np.ndarray:
    """A row of ``BINS`` numbers below ``2 ** LOW`` for each text; a text without words has all 0 (and see ``likeness``)."""
    encoded = [t.encode() for t in texts]
    empty = np.uint64(2**64 - 1)
    bins = np.full((len(texts), BINS), empty)
    shift = np.uint64(64 - (BINS - 1).bit_length())
    lo = 0
    while lo < len(encoded):
        hi, size = lo, 0
        while hi < len(encoded) and (hi == lo or size + len(encoded[hi]) <= TOGETHER):
            size += len(encoded[hi])
            hi += 1
        hashes, owners = shingle_hashes(encoded[lo:hi])
        np.minimum.at(bins.reshape(-1), (owners + lo) * BINS + (hashes >> shift).astype(np.int64), hashes)
        lo = hi
    out = densify(bins, empty)
    # The bin's number goes in, so that bins which borrowed one value still agree by chance one by one.
    low = (mix(out + np.arange(BINS, dtype=np.uint64) * _BASE) & np.uint64((1 << LOW) - 1)).astype(np.uint8)
    low[(bins == empty).all(axis=1)] = 0
    return low


def packed_hex(row: np.ndarray) -> str:
    """The low-order bits of all bins, two bins a byte, as lowercase hex."""
    return (row[0::2] | row[1::2] << np.uint8(LOW)).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, words_a: np.ndarray, words_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of rows; ``words_*`` says which have words at all.

    Two texts without words are alike (1), a text with and one without words are not (0).
    """
    chance = 2.0**-LOW
    agree = (a == b).mean(axis=1)
    value = np.clip((agree - chance) / (1 - chance), 0.0, 1.0)
    return np.where(words_a & words_b, value, np.where(words_a | words_b, 0.0, 1.0))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint, has_words: the packed bytes as lowercase hex, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = signatures(texts)
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([packed_hex(r) for r in rows]), pa.array([bool(t.strip(" \t\n\r\x0b\x0c")) for t in texts])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "fingerprint", "has_words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string, has_words boolean")


def with_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sorted, compressed texts (part, doc_id, packed) of which each part ends with the next part's first.

    Documents are cut into ranges of ids; the bounds are percentiles of the ids, one per partition.
    The first document of each range goes to its own part, and as a guest to the part before (that of
    the first range to the last part), so every task sees its rows' successors.  One shuffle.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    bounds = np.array(sorted({int(b) for b in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (20 * n))} if n > 1 else []), np.int64)

    def part_of(ids: pa.Array) -> np.ndarray:
        """The number of bounds not above each id; null ids are below all."""
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known, np.searchsorted(bounds, ids.fill_null(0).to_numpy(), side="right"), 0).astype(np.int32)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part_of(batch.column(0)))], ["doc_id", "part"])

    # One row per part: its number and first id (null before all).
    least = rows.select("doc_id").mapInArrow(parts, "doc_id long, part int").groupBy("part").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("has_null"))
    firsts = sorted(((r["part"], None if r["has_null"] else r["least"]) for r in least.collect()), key=lambda x: x[0])
    part_before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [press.compress(t.as_py().encode()) for t in batch.column(1)]
            ids = batch.column(0).to_pylist()
            own = part_of(batch.column(0)).tolist()
            guests = [i for i, doc_id in enumerate(ids) if doc_id in part_before]
            columns = [
                pa.array(own + [part_before[ids[i]] for i in guests], pa.int32()),
                pa.array([0] * len(ids) + [1] * len(guests), pa.int32()),
                pa.array(ids + [ids[i] for i in guests], pa.int64()),
                pa.array(packed + [packed[i] for i in guests], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "guest", "doc_id", "packed"])

    dealt = rows.mapInArrow(squeeze, "part int, guest int, doc_id long, packed binary")
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "packed")


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text with its second half taken from the next document.

    The next document follows by ascending id (null ids first, equal ids by text), after the last comes
    the first; a single document follows itself.  The last ``n_chars // 2`` code points are replaced by
    the first as many of the next text, or all of it.  A null text is empty.  No rows in, no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # rows whose successor may be still to come
        for batch in batches:
            for part, guest, doc_id, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                # Of several guests (rows that share the first id) the first one is the successor.
                if held and guest and held[-1][0] == part and held[-1][1]:
                    continue
                held.append((part, guest, doc_id, open_.decompress(packed.as_py()).decode()))
                if len(held) > 500:
                    yield compared(held)
                    held = held[-1:]
        if held:
            yield compared(held)

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        """Results for the rows that have a successor in their part; guests are successors only."""
        own = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
        texts = [r[3] for r in rows]
        edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in own]
        sign = signatures(texts + edited)
        worded = np.array([bool(t.strip(" \t\n\r\x0b\x0c")) for t in texts + edited])
        at = np.array([i for i, (a, b) in enumerate(zip(rows, rows[1:], strict=False)) if not a[1] and a[0] == b[0]], int)
        ed = np.arange(len(texts), len(texts) + len(edited))
        columns = [
            pa.array([a[2] for a, _ in own], pa.int64()),
            pa.array([len(a[3]) for a, _ in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([packed_hex(sign[i]) for i in at], pa.string()),
            pa.array([packed_hex(sign[i]) for i in ed], pa.string()),
            pa.array(likeness(sign[at], sign[ed], worded[at], worded[ed]), pa.float64()),
            pa.array(likeness(sign[at], sign[at + 1], worded[at], worded[at + 1]), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_neighbours(docs, id_col=id_col, text_col=text_col).mapInArrow(run, shape)


def op7_minhash_prints(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))

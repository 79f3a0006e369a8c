"""SimHash fingerprints and near duplicates by the generalised pigeonhole principle.

The 64 bits are cut into parts; a part ``i`` gets a threshold ``t_i`` of -1 or more so that the sum of
``t_i + 1`` is ``distance + 1``.  Two fingerprints within ``distance`` bits then agree up to ``t_i``
bits in at least one part.  From a bounded sample of fingerprints come

* the parts: bits that vary together go to one part, which leaves the others more selective;
* the thresholds: dynamic programming over the parts minimises index and probe rows plus the
  candidates that the sample lets expect; how many parts there are is chosen by the same cost.

Every distinct fingerprint is then put under its value in each part, and under the values it can
reach by flipping up to ``t_i`` bits of which the highest is 0 (its partner covers the other half).
Rows with equal keys meet in one task in key order; candidates are verified on all 64 bits, and only
enough links to keep the group connected are passed on.  Links make components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.components import components
from weftgraph.llm.shared import copy_number, documents, stored, text_or_empty

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Shingles that are held at once; a longer text's bits are counted span by span.
AT_ONCE = 32_768
#: Distinct fingerprints that the parts and thresholds are fitted on, at most.
SAMPLE = 20_000
PAIRS = 400_000
PART_COUNTS = (3, 4, 5)
MOST_FLIPS = 2
#: Cost of a row that is shuffled and sorted, in candidates verified.
ROW_COST = 60.0
#: Groups up to this size are verified by shifting; larger ones by a search that drops what is linked.
SHIFTS = 12
#: Larger groups are cut once more by all five fifths of the bits.
LARGE = 4096

BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str) -> int:
    """The text's fingerprint as an unsigned number; 0 without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - SHINGLE + 1
    del words
    counts = np.zeros(2048, np.int64)
    for lo in range(0, n, AT_ONCE):
        hi = min(lo + AT_ONCE, n)
        spans = zip(starts[lo:hi].tolist(), ends[lo + SHINGLE - 1 : hi + SHINGLE - 1].tolist(), strict=True)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in spans], repeat(SEED)), np.uint64, hi - lo)
        codes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        counts += np.bincount(codes.ravel(), minlength=2048)
    ones = counts.reshape(8, 256) @ BYTE_BITS
    return int(np.packbits(ones.ravel() * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    """Parts (their bits) and the threshold of each."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def correlated_parts(values: np.ndarray, count: int) -> tuple[tuple[int, ...], ...]:
    """The bits in ``count`` parts; each part grows by the bit that goes best with it."""
    bits = ((values[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    with_each = np.abs(centred.T @ centred) / max(len(values), 1)
    left, parts = set(range(BITS)), []
    for k in range(count):
        size = (BITS - sum(map(len, parts))) // (count - k)
        part = [max(left, key=lambda b: (sum(with_each[b, c] for c in left if c != b), -b))]
        left.discard(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: (with_each[b, part].sum(), -b)))
            left.discard(part[-1])
        parts.append(tuple(sorted(part)))
    return tuple(parts)


def mask_of(part: tuple[int, ...]) -> np.uint64:
    return np.uint64(sum(1 << b for b in part))


def plan_for(sample: np.ndarray, total: int, distance: int = DISTANCE) -> Plan:
    """Parts and thresholds of least expected cost for ``total`` fingerprints like the sample."""
    random = np.random.default_rng(1)
    sample = sample if len(sample) > 1 else np.arange(2, dtype=np.uint64)
    a, b = random.integers(0, len(sample), (2, PAIRS))
    differ = (sample[a] ^ sample[b])[a != b]
    best: tuple[float, Plan] | None = None
    for count in PART_COUNTS:
        parts = correlated_parts(sample, count)
        cost = []
        for part in parts:
            apart = np.bitwise_count(differ & mask_of(part))
            row = {-1: 0.0}
            for t in range(MOST_FLIPS + 1):
                flips = sum(len(list(combinations(range(len(part)), f))) for f in range(1, t + 1)) / 2
                # A floor for what the sample is too small to show: as many as uniform bits give.
                share = max(float((apart <= t).mean()) if len(apart) else 1.0, (1 + 2 * flips) / 2.0 ** len(part))
                row[t] = total * (1 + flips) * ROW_COST + share * total * total / 2
            cost.append(row)
        # spent[s]: least cost of the parts so far whose t + 1 add up to s
        spent: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in cost:
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, ts) in spent.items():
                for t, extra in row.items():
                    if s + t + 1 <= distance + 1 and (s + t + 1 not in after or c + extra < after[s + t + 1][0]):
                        after[s + t + 1] = (c + extra, (*ts, t))
            spent = after
        if distance + 1 in spent and (best is None or spent[distance + 1][0] < best[0]):
            best = (spent[distance + 1][0], Plan(parts, spent[distance + 1][1]))
    return best[1]


def index_keys(values: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the fingerprints under them: own values and flips."""
    keys, owners = [], []
    for number, (part, threshold) in enumerate(zip(plan.parts, plan.thresholds, strict=True)):
        if threshold < 0:
            continue
        value = np.zeros(len(values), np.uint64)
        for place, bit in enumerate(part):
            value |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
        top = np.uint64(number << 40)
        keys.append(value | top)
        owners.append(values)
        for flips in range(1, threshold + 1):
            for places in combinations(range(len(part)), flips):
                zero = ((value >> np.uint64(places[-1])) & np.uint64(1)) == 0
                keys.append((value[zero] ^ np.uint64(sum(1 << p for p in places))) | top)
                owners.append(values[zero])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.array([], np.uint64),) * 2


def connect(values: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within ``distance`` that connect what is connected; each value is reached once."""
    if len(values) > LARGE:
        out, width = [], -(-BITS // (distance + 1))
        for k in range(distance + 1):
            part = (values >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    out += search(values[group], distance)
        return out
    return search(values, distance)


def search(values: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth first; what has been reached is compared no more."""
    out, rest = [], values
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), at, np.uint64), found))
                frontier.extend(found)
                rest = rest[~near]
    return out


def links(distinct: DataFrame, plan: Plan, distance: int = DISTANCE) -> DataFrame:
    """(u, v) within ``distance`` that keep connected what is connected; ``distinct``: fp."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(values), 20_000):
                keys, owners = index_keys(values[lo : lo + 20_000], plan)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64))], ["key", "fp"])

    def found_in(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        """Links among rows sorted by key, all rows of a key among them."""
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])]) if len(keys) else np.array([], bool)
        keys, values = keys[fresh], values[fresh]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], int)
        sizes = np.diff(np.append(starts, len(keys)))
        small = np.repeat(sizes <= SHIFTS + 1, sizes)
        pairs = []
        sk, sv = keys[small], values[small]
        for shift in range(1, min(SHIFTS, len(sk) - 1) + 1):
            close = (sk[shift:] == sk[:-shift]) & (np.bitwise_count(sv[shift:] ^ sv[:-shift]) <= distance)
            pairs.append((sv[:-shift][close], sv[shift:][close]))
        for start, size in zip(starts[sizes > SHIFTS + 1].tolist(), sizes[sizes > SHIFTS + 1].tolist(), strict=True):
            pairs += connect(values[start : start + size], distance)
        u = np.concatenate([p[0] for p in pairs]) if pairs else np.array([], np.uint64)
        v = np.concatenate([p[1] for p in pairs]) if pairs else np.array([], np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.array([], np.int64), np.array([], np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            if whole:
                yield found_in(keys[:whole], values[:whole])
                keys, values = keys[whole:], values[whole:]
        yield found_in(keys, values)

    spread_out = distinct.mapInArrow(spread, "key long, fp long")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread_out.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(verify, "u long, v long")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id.

    ``component_id`` is the smallest document id that links of ``distance`` or fewer bits reach.
    Null and wordless texts have fingerprint 0 and link like any other.  A null id takes part and is
    never the smallest unless its whole component has none.  No rows in, no rows out.
    """
    prints = stored(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash-prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    sample = [r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()]
    plan = plan_for(np.array(sample, np.int64).view(np.uint64), distinct.count(), distance)
    roots = components(links(distinct.select("fp"), plan, distance), "simhash-links")
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = stored(rooted.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_groups(spark, sf_dir: str) -> DataFrame:
    found = simhash_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; rows with a null id stay.

    Of repeated rows, of the same id and the same text, one stays; texts that differ under one id stay together.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    keep = simhash_groups(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(keep, docs[id_col] == keep["kept_id"]).withColumn("__hash", F.xxhash64(text_or_empty(text_col)))
    kept = kept.withColumn("__copy", copy_number(docs, ["kept_id", "__hash"], id_col, text_col)).where("__copy = 1")
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))

"""Connected components of a graph given by links, by large-star and small-star rounds.

Each round is a few aggregations and joins over the links; every round's links are written to the
shared folder.  Nothing is collected but a count and a checksum.  A first pass replaces the links that a
task happens to hold by a star for each component among them, which shortens chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import forget, stored

#: Links that a task holds at once while it contracts.
HELD = 500_000  # some 100 MB of a task's memory
SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def stars(links: list[tuple[int, int]]) -> dict[int, int]:
    """Each node that isn't the smallest of its component, and that smallest one."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for a, b in links:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: r for x in list(parent) if (r := find(x)) != x}


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def out():
        found = stars(held)
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], schema=SCHEMA)

    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(held) >= HELD:
            yield out()
            held = []
    if held:
        yield out()


def components(links: DataFrame, name: str = "links", held: int = HELD) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: longs) but the roots; a root is its component's smallest node.

    Null ends and links of a node to itself are left out; repeated links count once.  No links, no rows.
    Whenever no more than ``held`` links are left, by count, one task ends the work.
    """
    now = stored(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    n = now.count()
    if n > held:
        contracted = stored(now.mapInArrow(contract, "u long, v long").distinct(), name)
        forget(now)
        now = contracted
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if not state["n"] or before == (state["n"], state["sum"]):
            break
        if state["n"] <= held:
            now = stored(now.coalesce(1).mapInArrow(contract, "u long, v long"), name)
            break
        before = (state["n"], state["sum"])
        # Large star: each node's larger neighbours go to its smallest neighbour (or itself).
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node's smaller neighbours, and itself, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("u"), F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = stored(small, name)
        forget(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

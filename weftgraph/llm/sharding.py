"""Sharding by vector bin packing: bytes, words and rows of the shards are balanced jointly.

Documents with equal texts form a group.  A group goes to the shard where the dot product of its
size vector with the shard's residual capacity is highest; larger groups are placed first.

* Heavy groups, with ``HEAVY`` or more of any total, are at most ``3 / HEAVY`` by arithmetic (and 768 pieces); the
  driver places them.  A group larger than a shard is dealt by row into pieces of ``SPLIT`` of
  one, as no placement of the whole could balance; no other group is split.
* The others are packed where the shuffle puts them: each partition fills the eight shards in
  proportion to the capacity that the heavy groups left, so no task sees all groups, and as each
  partition ends with its smallest groups, the sums stay close.

Slots come from counts per (shard, hash bucket) with running sums; only one bucket is sorted at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import documents, stored, text_or_empty, words

HEAVY = 1 / 512
SPLIT = 1 / 32
SLOT_ROWS = 20_000
#: What each dimension counts for in the dot product: the law promises near-equal bytes first.
LAW_WEIGHTS = (16.0, 1.0, 1.0)
DIMENSIONS = ("size", "n_words", "n_rows")


def place(items: list[tuple[float, ...]], capacity: np.ndarray, first: int = 0) -> list[int]:
    """Shard of each item, in the order given: the highest dot product with what capacity is left.

    Items and capacities are shares of the totals, a row of ``capacity`` per shard.  Equal products go
    to the shard with the fewest rows so far, then to the next one counted from ``first``.
    """
    left = [list(map(float, row)) for row in capacity]
    n, out = len(left), []
    order = [(first + i) % n for i in range(n)]
    for item in items:
        best, best_value = order[0], None
        for s in order:
            row = left[s]
            value = 0.0
            for w, a, b in zip(LAW_WEIGHTS, item, row, strict=True):
                value += w * a * b
            if best_value is None or value > best_value:
                best, best_value = s, value
        row = left[best]
        for i, a in enumerate(item):
            row[i] -= a
        out.append(best)
    return out


def vector_shards(docs: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    ``size`` is the text's UTF-8 bytes plus 1.  A null text weighs 1 and is grouped with empty texts.
    Equal texts share a shard unless the group outgrows a shard.  Long texts count by their
    size only; further columns are not looked at.  Rows with equal ids are apart
    rows; null ids are allowed.  No rows in, no rows out.  Reruns on the same session settings agree.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            words(text_col).alias("n_words"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("group_key"),
        ),
        "shard-rows",
    )
    # Rows are dealt into pieces by their place in the table, as ids may be null or repeat.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    groups = stored(
        rows.groupBy("group_key").agg(F.sum("size").alias("size"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_rows")),
        "shard-groups",
    )
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).first()
    totals = np.array([max(total[d] or 0, 1) for d in DIMENSIONS], float)
    share = F.greatest(*[F.col(d) / float(t) for d, t in zip(DIMENSIONS, totals, strict=True)])

    # Heavy groups: at most 3 / HEAVY rows, as the shares of each dimension add up to 1.
    heavy = sorted(groups.where(share >= HEAVY).collect(), key=lambda g: bytes(g["group_key"]))
    filled = {bytes(g["group_key"]): max(g[d] / t for d, t in zip(DIMENSIONS, totals, strict=True)) * shards for g in heavy}
    pieces_of = {k: int(np.ceil(x / SPLIT)) if x > 1 else 1 for k, x in filled.items()}
    marked_schema = "group_key binary, n_pieces int"
    marks = F.broadcast(spark.createDataFrame([(bytearray(k), n) for k, n in pieces_of.items()], marked_schema))
    heavy_rows = rows.join(marks, "group_key").withColumn("piece", F.pmod("row", "n_pieces").cast("int"))
    # At most 3 * shards / SPLIT pieces of split groups, and one for each other heavy group.
    pieces = heavy_rows.groupBy("group_key", "piece").agg(F.sum("size").alias("size"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_rows")).collect() if heavy else []
    capacity = np.full((shards, len(DIMENSIONS)), 1.0 / shards)
    vectors = {(bytes(p["group_key"]), p["piece"]): tuple(float(p[d] / t) for d, t in zip(DIMENSIONS, totals, strict=True)) for p in pieces}
    order = sorted(vectors, key=lambda k: (-max(vectors[k]), k))
    placed = dict(zip(order, place([vectors[k] for k in order], capacity), strict=True))
    for k, s in placed.items():
        capacity[s] -= vectors[k]
    capacity = np.maximum(capacity, 0.0)
    capacity = capacity / np.maximum(capacity.sum(axis=0), 1e-12)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        sizes = np.stack([table[d].to_numpy().astype(float) for d in DIMENSIONS], axis=1)
        shares = sizes / np.maximum(sizes.sum(axis=0), 1.0)
        keys = np.array(table["group_key"].to_pylist(), dtype=object)
        order = sorted(range(len(keys)), key=lambda i: (-shares[i].max(), keys[i]))
        first = keys[order[0]][0] % shards
        found = place([tuple(shares[i]) for i in order], capacity, first)
        for lo in range(0, len(order), 50_000):
            part = order[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in part], pa.binary()), pa.array(found[lo : lo + 50_000], pa.int32())], ["group_key", "shard"])

    light = groups.where(share < HEAVY)
    # Numbers only: some 50 bytes a group, and a partition has its part of the groups.
    dealt = light.repartition("group_key").mapInArrow(pack, "group_key binary, shard int")
    light_rows = rows.join(marks.select("group_key"), "group_key", "left_anti")
    where = F.broadcast(spark.createDataFrame([(bytearray(k), p, int(s)) for (k, p), s in placed.items()], "group_key binary, piece int, shard int"))
    wanted = ["doc_id", "size", "text_crc32", "shard"]
    sharded = stored(
        light_rows.join(dealt, "group_key").select(*wanted).unionByName(heavy_rows.join(where, ["group_key", "piece"]).select(*wanted)),
        "shard-placed",
    )
    buckets = max(1, int(total["n_rows"] or 0) // SLOT_ROWS)
    sharded = sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sharded.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return sharded.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.row_number().over(inside) - 1).alias("slot"))


def op4_vector_shards(spark, sf_dir: str) -> DataFrame:
    """``vector_shards`` over all documents, under the law ``bytes``."""
    return vector_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

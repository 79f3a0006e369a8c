"""Exact top-k inner products by a pivot-distance index.

Inner products become distances: with ``M`` the longest norm, a vector ``x`` gets one more component
``sqrt(M^2 - |x|^2)`` and a query ``q`` a 0; then ``|x' - q'|^2 = M^2 + |q|^2 - 2 q.x``.

* Pivots are cluster centres of a bounded sample.  Every vector is keyed by its nearest pivot and its
  distance to it, and the keys are sorted; a block of the index is an annulus round one pivot.
* By the triangle inequality no vector of an annulus [a, b] round p is nearer to q than
  ``max(d(q, p) - b, a - d(q, p))``.  The best scores in the sample bound a query's result from the start.
* Queries are searched in blocks.  A block's annuli come in order of their bound, running results
  tighten the limit, and the first annulus beyond it ends the search of that list.

Index blocks are read from files in the shared folder, so neither queries nor candidates are broadcast
or replicated in a shuffle; what is shuffled is pairs of block numbers.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import fresh_path, partitions, stored
from weftgraph.llm.token_output import filesystem

PIVOTS = 32
#: Vectors that pivots and first limits come from, at most.
SAMPLE = 4096
BLOCK = 1024
QUERY_BLOCK = 128
SLICES = 4
#: Slack for rounding of distances, relative to the largest norm.
SLACK = 1e-7
#: Below any score; its negative is a number, too.
NOTHING = np.int64(-(2**62))


def valid(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    x = F.col(vector)
    finite = lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))
    return x.isNotNull() & F.forall(x, finite)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows: by floating point where all sums stay below 2 ** 53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres by a few rounds of k-means from a spread-out start; never more than there are vectors."""
    centres = [sample[0]]
    nearest = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(centres) < min(count, len(sample)) and nearest.max() > 0:
        centres.append(sample[int(nearest.argmax())])
        nearest = np.minimum(nearest, ((sample - centres[-1]) ** 2).sum(axis=1))
    found = np.array(centres)
    for _ in range(8):
        own = distances(sample, found).argmin(axis=1)
        for p in range(len(found)):
            if (own == p).any():
                found[p] = sample[own == p].mean(axis=0)
    return found


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def lifted(x: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """Vectors with the component that turns inner products into distances."""
    x = x.astype(np.float64)
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))
    return np.column_stack([x, extra])


class Best:
    """The ``k`` best (score, smaller id first) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NOTHING)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        better = allowed & (scores >= self.score[:, -1:])
        for i in np.flatnonzero(better.any(axis=1)):
            near = np.flatnonzero(better[i])
            if len(near) > 8 * self.k:
                # Keep all that tie with the k-th best.
                cut = np.partition(scores[i][near], len(near) - self.k)[len(near) - self.k]
                near = near[scores[i][near] >= cut]
            s, v = np.concatenate([self.score[i], scores[i][near]]), np.concatenate([self.ids[i], ids[near]])
            order = np.lexsort((v, -s))[: self.k]
            self.score[i], self.ids[i] = s[order], v[order]


@lru_cache(64)
def read_block(folder: str, path: str, start: int, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    system, _ = filesystem(folder)
    with system.open_input_file(path) as file:
        file.seek(start)
        data = np.frombuffer(file.read(8 * n * (width + 1)), "<i8").reshape(n, width + 1)
    return data[:, 0], data[:, 1:]


def exact_top_k(
    vectors: DataFrame,
    *,
    k: int = 5,
    query_every: int = 50,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``query_every`` divides, the ``k`` best others.

    Components count as ``floor(scale * x)``.  Vectors that are null or hold a null or non-finite
    component, and rows with a null id, take no part.  Shorter vectors count as filled up with zeros.
    Rows that share a query's id are its own and no candidates; each of them is a query, with ranks of its own.  With fewer than ``k`` others all are
    returned.  No rows in, no rows out.
    """
    spark = vectors.sparkSession
    width = vectors.where(valid(vector_col)).agg(F.max(F.size(vector_col))).first()[0] or 0
    shape = "query_id long, rank int, vec_id long, score long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, width), np.int64)
            for i, v in enumerate(batch.column(1)):
                values = np.floor(np.array(v.as_py(), np.float64) * scale)
                rows[i, : len(values)] = values.astype(np.int64)
            packed = pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array((rows.astype(np.float64) ** 2).sum(axis=1))], ["vec_id", "whole", "norm2"])

    kept = vectors.where(F.col(id_col).isNotNull() & valid(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), vector_col)
    rows = stored(kept.mapInArrow(whole, "vec_id long, whole binary, norm2 double"), "topk-whole")
    longest = rows.agg(F.max("norm2")).first()[0]
    if longest is None:
        return spark.createDataFrame([], shape)
    unpack = lambda values: np.frombuffer(b"".join(values), "<i8").reshape(-1, width)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "whole").limit(SAMPLE).select("vec_id", "whole").collect()
    sample_ids, sample = np.array([r["vec_id"] for r in picked], np.int64), unpack([bytes(r["whole"]) for r in picked])
    pivots = pivots_of(lifted(sample, longest), PIVOTS)

    # Key every vector, sort by key, and write the annuli.
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(lifted(unpack(batch.column(1).to_pylist()), longest), pivots)
            yield pa.RecordBatch.from_arrays([pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1)), batch.column(0), batch.column(1)], ["pivot", "far", "vec_id", "whole"])

    folder = fresh_path(spark, "topk-index")
    blocks_shape = "block string, path string, start long, n int, pivot int, near double, far double"

    def write(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, base = filesystem(folder)
            path, out, at, done = f"{base}/{uuid.uuid4().hex}", None, 0, []
            pivot, far, ids, whole_ = [], [], [], []

            def flush(upto: int):
                nonlocal at, out, pivot, far, ids, whole_
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(path)
                data = np.column_stack([np.array(ids[:upto], np.int64), unpack(whole_[:upto])]).astype("<i8").tobytes()
                done.append((f"{path}:{at}", path, at, upto, pivot[0], far[0], far[upto - 1]))
                at += out.write(data)
                pivot, far, ids, whole_ = pivot[upto:], far[upto:], ids[upto:], whole_[upto:]

            for batch in batches:
                pivot += batch.column(0).to_pylist()
                far += batch.column(1).to_pylist()
                ids += batch.column(2).to_pylist()
                whole_ += batch.column(3).to_pylist()
                while len(ids) > size or pivot and pivot[0] != pivot[-1]:
                    same = pivot.index(next(p for p in pivot if p != pivot[0])) if pivot[0] != pivot[-1] else len(ids)
                    flush(min(size, same))
            while ids:
                flush(min(size, len(ids)))
            if out is not None:
                out.close()
            names = [f.split(" ")[0] for f in blocks_shape.split(", ")]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            columns = list(zip(*done, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        return run

    keys = stored(rows.select("vec_id", "whole").mapInArrow(keyed, "pivot int, far double, vec_id long, whole binary"), "topk-keys")
    n = partitions(spark)
    sort = ["pivot", "far", "vec_id"]
    annuli = stored(keys.repartitionByRange(n, "pivot", "far").sortWithinPartitions(*sort).mapInArrow(write(BLOCK), blocks_shape), "topk-annuli")
    asked = keys.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    asked_blocks = stored(asked.repartitionByRange(n, "pivot", "far").sortWithinPartitions(*sort).mapInArrow(write(QUERY_BLOCK), blocks_shape), "topk-queries")

    def first_limit(ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The distance beyond which nothing counts, as the sample alone shows it."""
        best = Best(len(ids), k)
        best.add(products(q, sample), sample_ids, ids[:, None] != sample_ids[None, :])
        return reach(best, q)

    def reach(best: Best, q: np.ndarray) -> np.ndarray:
        last = best.score[:, -1].astype(np.float64)
        square = longest + (q.astype(np.float64) ** 2).sum(axis=1) - 2 * last
        return np.where(best.ids[:, -1] == np.iinfo(np.int64).max, np.inf, np.sqrt(np.maximum(square, 0))) + SLACK * (1 + math.sqrt(longest))

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query block and pivot: the nearest and farthest query, and the farthest limit."""
        for batch in batches:
            for row in batch.to_pylist():
                ids, q = read_block(folder, row["path"], row["start"], row["n"], width)
                far = distances(lifted(q, longest, True), pivots)
                limit = float(first_limit(ids, q).max())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]] * len(pivots)), pa.array([row["start"]] * len(pivots), pa.int64()), pa.array([row["n"]] * len(pivots), pa.int32()), pa.array(range(len(pivots)), pa.int32()), pa.array(far.min(axis=0)), pa.array(far.max(axis=0)), pa.array([limit] * len(pivots), pa.float64())],
                    ["q_path", "q_start", "q_n", "pivot", "q_near", "q_far", "limit"],
                )

    reached = asked_blocks.repartition(n, "block").select("path", "start", "n").mapInArrow(reaches, "q_path string, q_start long, q_n int, pivot int, q_near double, q_far double, limit double")
    bound = F.greatest(F.lit(0.0), F.col("q_near") - F.col("far"), F.col("near") - F.col("q_far"))
    pairs = reached.join(annuli.drop("block"), "pivot").withColumn("bound", bound).where("bound <= limit").withColumn("slice", F.col("pivot") % SLICES)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, ids, q, centre, limit, over = None, None, None, None, None, None, False

        def out():
            kept = best.ids != np.iinfo(np.int64).max
            row, col = np.nonzero(kept)
            places = [f"{now[0]}:{now[1]}:{i}" for i in row.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array(ids[row]), pa.array(best.ids[row, col]), pa.array(best.score[row, col])], ["place", "query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if now != (row["q_path"], row["q_start"], row["slice"]):
                    if now is not None:
                        yield out()
                    now, over = (row["q_path"], row["q_start"], row["slice"]), False
                    ids, q = read_block(folder, row["q_path"], row["q_start"], row["q_n"], width)
                    best, limit = Best(len(ids), k), first_limit(ids, q)
                    centre = distances(lifted(q, longest, True), pivots)
                if over or (over := row["bound"] > limit.max()):
                    continue  # bounds ascend: no later annulus of this list can count
                d = centre[:, row["pivot"]]
                near = np.maximum(d - row["far"], row["near"] - d) <= limit
                if near.any():
                    cand_ids, cand = read_block(folder, row["path"], row["start"], row["n"], width)
                    best.add(products(q, cand), cand_ids, (ids[:, None] != cand_ids[None, :]) & near[:, None])
                    limit = np.minimum(limit, reach(best, q))
        if now is not None:
            yield out()

    searched = pairs.repartition(n, "q_path", "q_start", "slice").sortWithinPartitions("q_path", "q_start", "slice", "bound", "path", "start").mapInArrow(search, "place string, query_id long, vec_id long, score long")
    # By the query's place in the index: rows of equal ids are queries of their own.
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    return searched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_pivot_top_k(spark, sf_dir: str) -> DataFrame:
    """``exact_top_k`` over all embeddings."""
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

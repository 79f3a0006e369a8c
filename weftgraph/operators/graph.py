"""Graph measures over an undirected projection of typed edges.

Parallel edges count in degree, PageRank and Louvain weights; betweenness and clustering work on the simple
graph.  Iterations write their state to the shared folder every few rounds and never collect more than counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.storage import cut


def projection(edges: DataFrame) -> DataFrame:
    """src, dst: every edge in both directions."""
    return edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).unionByName(edges.select(F.col("target").alias("src"), F.col("source").alias("dst")))


def simple(edges: DataFrame) -> DataFrame:
    """The projection without loops and parallel edges."""
    return projection(edges).where("src <> dst").distinct()


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """title, degree: edge ends at each node; 0.0 without any."""
    ends = projection(edges).groupBy(F.col("src").alias("title")).agg(F.count("*").cast("double").alias("degree"))
    return nodes.select("title").join(ends, "title", "left").select("title", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def top(scores: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The first ``n`` by score, then title, with their rank."""
    best = scores.where(F.col(column).isNotNull()).orderBy(F.desc(column), "title").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(column), "title")))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float | None = 1e-7, every: int = 5) -> DataFrame:
    """title, score: ``1 - damping + damping * sum(score / degree)`` of neighbours, ``rounds`` updates from ``1 - damping``.

    Scores aren't normalised.  Every ``every`` rounds the state is written out and, unless ``tolerance`` is
    None, the run ends once no score moves by more.
    """
    both = projection(edges)
    out = both.groupBy("src").agg(F.count("*").alias("out"))
    shares = cut(both.groupBy("src", "dst").agg(F.count("*").alias("n")).join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")), "shares")
    base = nodes.select("title").distinct()
    now = base.withColumn("score", F.lit(1 - damping))
    for i in range(rounds):
        got = shares.join(now, shares["src"] == now["title"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        after = base.join(got, base["title"] == got["dst"], "left").select("title", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if (i + 1) % every == 0 or i + 1 == rounds:
            after = cut(after, "pagerank")
            if tolerance is not None and i + 1 < rounds:
                moved = after.join(now.withColumnRenamed("score", "old"), "title").agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
                if moved is not None and moved <= tolerance:
                    return after
        now = after
    return now


def betweenness(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """title, score: exact betweenness of the simple undirected graph.

    Shortest paths are counted from all sources at once, level by level; dependencies are summed back from
    the last level.  The state has a row for each pair of nodes and level, the size of the exact problem.
    """
    links = cut(simple(edges), "links")
    seen = level = cut(nodes.select(F.col("title").alias("s"), F.col("title").alias("v")).distinct().withColumn("paths", F.lit(1.0)), "paths")
    levels = [level]
    while max_depth is None or len(levels) <= max_depth:
        reached = level.join(links, level["v"] == links["src"]).groupBy("s", "dst").agg(F.sum("paths").alias("paths")).withColumnRenamed("dst", "v")
        level = cut(reached.join(seen.select("s", "v"), ["s", "v"], "left_anti"), "paths")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level)
    total = None
    below = None  # (s, v, share): (1 + dependency) / paths of the level after
    for level in reversed(levels[1:]):
        if below is None:
            state = level.withColumn("dependency", F.lit(0.0))
        else:
            back = below.join(links, below["v"] == links["src"]).groupBy("s", "dst").agg(F.sum("share").alias("share"))
            state = level.join(back.withColumnRenamed("dst", "v"), ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("dependency"))
        state = cut(state, "dependency")
        part = state.select("v", "dependency")
        total = part if total is None else total.unionByName(part)
        below = state.select("s", "v", ((1 + F.col("dependency")) / F.col("paths")).alias("share"))
    scores = total.groupBy("v").agg((F.sum("dependency") / 2).alias("score")) if total is not None else None
    base = nodes.select("title").distinct()
    if scores is None:
        return base.withColumn("score", F.lit(0.0))
    return base.join(scores, base["title"] == scores["v"], "left").select("title", F.coalesce("score", F.lit(0.0)).alias("score"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """title, coefficient: the share of a node's neighbour pairs that are linked; 0.0 with fewer than two neighbours.

    Links point from the end of lower degree, so hubs start few wedges.
    """
    links = simple(edges)
    k = links.groupBy("src").agg(F.count("*").alias("k"))
    ranked = links.join(k, "src").join(k.select(F.col("src").alias("dst"), F.col("k").alias("k2")), "dst")
    up = cut(ranked.where(F.struct("k", "src") < F.struct("k2", "dst")).select("src", "dst"), "oriented")
    a, b = up.select(F.col("src").alias("x"), F.col("dst").alias("y")), up.select(F.col("src").alias("x"), F.col("dst").alias("z"))
    wedges = a.join(b, "x").where("y < z")
    closing = up.select(F.least("src", "dst").alias("y"), F.greatest("src", "dst").alias("z"))
    corners = wedges.join(closing, ["y", "z"]).select(F.explode(F.array("x", "y", "z")).alias("title"))
    t = corners.groupBy("title").agg(F.count("*").alias("t"))
    joined = nodes.select("title").distinct().join(k.withColumnRenamed("src", "title"), "title", "left").join(t, "title", "left")
    return joined.select("title", F.when(F.col("k") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("coefficient"))


def modularity(weights: DataFrame, communities: DataFrame) -> float:
    """Of a partition (node, community) over (src, dst, w) in both directions."""
    c = communities
    total = weights.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return 0.0
    inside = weights.join(c.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(c.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    by = inside.groupBy("cs").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("own"))
    return by.agg(F.sum(F.col("own") / total - (F.col("all") / total) ** 2)).first()[0]


def louvain(nodes: DataFrame, edges: DataFrame, rounds: int = 6, levels: int = 3) -> tuple[DataFrame, float]:
    """(title, community) and the modularity reached.

    Nodes move together, to the community of largest gain (the least of equals); rounds alternate between
    moves to lower and to higher communities, so neighbours can't swap for ever.  A round that doesn't
    raise modularity is undone and ends the level; then communities become nodes.
    """
    members = cut(nodes.select("title").distinct().withColumn("node", F.col("title")), "members")
    weights = cut(projection(edges).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")), "weights")
    best = None
    for _ in range(levels):
        state = cut(members.select("node").distinct().withColumn("community", F.col("node")), "communities")
        at = modularity(weights, state)
        best = at if best is None else best
        total = weights.agg(F.sum("w")).first()[0] or 0.0
        if not total:
            break
        strength = cut(weights.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), "strength")
        fails = 0
        for i in range(rounds):
            size = state.join(strength, "node").groupBy("community").agg(F.sum("k").alias("all"))
            near = weights.where("src <> dst").join(state.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("to"))
            own = state.select("node", F.col("community").alias("own")).join(strength, "node")
            options = near.join(own, "node").join(size, "community")
            rest = F.col("all") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
            gain = options.withColumn("gain", F.col("to") - F.col("k") * rest / total)
            stay = own.join(size, own["own"] == size["community"]).join(near.select(F.col("node").alias("n2"), F.col("community").alias("c2"), "to"), (F.col("node") == F.col("n2")) & (F.col("own") == F.col("c2")), "left")
            stay = stay.select("node", (F.coalesce("to", F.lit(0.0)) - F.col("k") * (F.col("all") - F.col("k")) / total).alias("stay"))
            way = F.col("community") < F.col("own") if i % 2 == 0 else F.col("community") > F.col("own")
            first = Window.partitionBy("node").orderBy(F.desc("gain"), "community")
            moves = gain.where(way).join(stay, "node").where(F.col("gain") > F.col("stay") + 1e-12).withColumn("n", F.row_number().over(first)).where("n = 1").select("node", F.col("community").alias("new"))
            after = cut(state.join(moves, "node", "left").select("node", F.coalesce("new", "community").alias("community")), "communities")
            reached = modularity(weights, after)
            if reached > at + 1e-9:
                state, at, fails = after, reached, 0
            else:
                fails += 1
                if fails == 2:
                    break
        if at <= best + 1e-9:
            break
        best = at
        members = cut(members.join(state, "node").select("title", F.col("community").alias("node")), "members")
        to = state.select(F.col("node").alias("src"), F.col("community").alias("cs")), state.select(F.col("node").alias("dst"), F.col("community").alias("cd"))
        weights = cut(weights.join(to[0], "src").join(to[1], "dst").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w")), "weights")
    return members.select("title", F.col("node").alias("community")), best if best is not None else 0.0


def community_sizes(communities: DataFrame, top_n: int = 5, members: int = 5) -> DataFrame:
    """community, size, first members by title; the largest first."""
    w = Window.partitionBy("community").orderBy("title")
    numbered = communities.withColumn("n", F.row_number().over(w))
    grouped = numbered.groupBy("community").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.when(F.col("n") <= members, F.col("title")))).alias("members"))
    return grouped.orderBy(F.desc("size"), "community").limit(top_n)


def one_hop_counts(edges: DataFrame) -> DataFrame:
    return projection(edges).groupBy("src").agg(F.count("*").alias("n"))


def shortest_distances(nodes: DataFrame, edges: DataFrame, source: str, max_depth: int) -> DataFrame:
    """title, distance from one node over the simple graph, up to ``max_depth``."""
    links = simple(edges)
    found = level = nodes.where(F.col("title") == source).select("title", F.lit(0).alias("distance"))
    for d in range(1, max_depth + 1):
        level = cut(level.join(links, level["title"] == links["src"]).select(F.col("dst").alias("title")).distinct().join(found.select("title"), "title", "left_anti").withColumn("distance", F.lit(d)), "distance")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found

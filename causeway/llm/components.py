"""Connected components by alternating large-star and small-star steps, each a join and an aggregation; nothing comes to the driver but counts.

The edges are done when they are stars: no node with a smaller neighbour has another one. Of a graph of up to WHOLE nodes the least neighbours
are broadcast, so that a pair of steps costs three shuffles and the test for stars one. In a larger one a node with a thousandth of all edges
or more (and a hundred at least) is a hub. There are 2000 hubs at most, so where there are any their least neighbours are broadcast and their
edges stay where they are; edges of other nodes meet theirs in a shuffle, where no key has more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import checkpointed

HUBS = 1000
WHOLE = 1 << 17


def _with_least(edges: DataFrame, least: DataFrame, bound: int | None) -> DataFrame:
    """edges (u, v) with m of least (u, m, n). bound: the degree of a hub, 0 where all nodes are few enough to be broadcast, None where there is none."""
    if bound is None:
        return edges.join(least.select("u", "m"), "u")
    if not bound:
        return edges.join(F.broadcast(least.select("u", "m")), "u")
    hubs, others = least.where(F.col("n") >= bound), least.where(F.col("n") < bound)
    marked = edges.join(F.broadcast(hubs.select("u", "m")), "u", "left")  # 2 * HUBS rows at most
    rest = marked.where("m is null").drop("m").join(others.select("u", "m"), "u")
    return marked.where("m is not null").unionByName(rest)


def stars(edges: DataFrame) -> DataFrame:
    """u, v: each node with an edge that isn't its component's smallest node, with that. edges: u, v (long); self-loops and repeats may occur."""
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    while True:
        both = now.select(F.inline(F.array(pair("u", "v"), pair("v", "u"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        nodes, n, degree, open_ = least.agg(F.count("*"), F.sum("n"), F.max("n"), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))).first()
        if not open_:
            return now
        bound = max(100, n // (2 * HUBS))
        hub = 0 if nodes <= WHOLE else bound if degree >= bound else None
        large = _with_least(now.select(F.col("v").alias("u"), F.col("u").alias("v")), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, hub).select(F.inline(F.array(pair("v", "m"), pair("u", "m")))).where("u <> v").distinct()
        now = checkpointed(small)


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns node, component: the smallest node it reaches, for each node with an edge. Self-loops and repeats may occur."""
    found = stars(edges)
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arcwright.operators import kernels
from arcwright.plans.loops import clear, cut


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


#: A vertex is hot with more than HOT_ROWS neighbours and more than one in HOT_VERTICES of all rows.
HOT_VERTICES = 1000
HOT_ROWS = 100
#: Rounds after which the files of those before are cleared.
CLEAR = 2


def _answered(rows: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """(v, m) of rows (u, v) and least (u, m, c)."""
    hot = least.where(F.col("c") > most).select("u", F.col("m").alias("hot"))
    flagged = rows.join(F.broadcast(hot), "u", "left")
    rest = flagged.where("hot is null").select("u", "v").join(least.where(F.col("c") <= most).select("u", "m"), "u")
    return flagged.where("hot is not null").select("v", F.col("hot").alias("m")).union(rest.select("v", "m"))


def min_labels(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex on an edge (u, v); component is the smallest vertex reachable.

    Every round links each vertex's neighbours to the smallest of them, so path lengths shrink
    geometrically and the edge count never exceeds that of the input. Rounds go on until nothing changes.
    Self-loops, nulls and repeated edges are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = cut(e)
    before, turn = _signature(e), 0
    while before[0]:
        turn += 1
        # vertices of more neighbours than their share, fewer than HOT_VERTICES of them, are answered by a broadcast
        most = max(HOT_ROWS, 2 * before[0] // HOT_VERTICES)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = _answered(both.where("v > u"), least, most).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = _answered(large, least, most).select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("y")).where("x <> y")
        e = cut(least.select("u", F.col("m").alias("v")).union(small.select(F.col("x"), F.col("y"))).distinct())
        after = _signature(e)
        if after == before:
            break
        before = after
        del both, least, large, small  # plans that are held hold their files
        if turn % CLEAR == 0:
            clear(e.sparkSession)
    roots = e.select(F.col("v")).distinct().join(e.select(F.col("u").alias("v")), "v", "left_anti")
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).union(roots.select("v", F.col("v").alias("component")))


def components(g) -> DataFrame:
    """(v, component) of all vertices, numbered 1, 2, ... by size, largest first, then by smallest vertex; weak where directed."""
    from arcwright.plans.order import numbered

    low = labels(g)
    sizes = low.groupBy("component").agg(F.count("*").alias("size"))
    rank = numbered(sizes, [F.desc("size"), F.col("component")], "number").select("component", "number")
    return low.join(rank, "component").select("v", F.col("number").alias("component"))


def labels(g) -> DataFrame:
    """(v, component): component is its smallest vertex; isolated vertices are their own."""
    if g.local:
        shared = g.local
        return kernels.once(g.edges.sparkSession, lambda: kernels.component_labels(shared.value), "v long, component long")
    found = min_labels(g.edges.select("u", "v"))
    return g.vertices.join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def component_sizes(g) -> DataFrame:
    """(component, size), component being its smallest vertex."""
    return labels(g).groupBy("component").agg(F.count("*").alias("size"))


def members(g) -> DataFrame:
    """(component, v) in members' order is a sort away; kept as rows, since a component may hold most vertices."""
    return components(g).orderBy("component", "v")

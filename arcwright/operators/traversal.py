"""Breadth-first and depth-first search.

Graphs that fit in one task are searched there (`kernels`); the loops here are for larger ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwright.model import Graph, GraphError, RecursionLimit
from arcwright.operators import components, kernels
from arcwright.plans.loops import cut
from arcwright.plans.order import numbered

_TREE = "v long, parent long, level int, at long"


def bfs(g: Graph, root: int, max_level: int | None = None, until: set[int] | None = None, max_vertices: int | None = None, visit: Callable | None = None) -> DataFrame:
    """(v, parent, level, rank) of what the search reaches, in its order of discovery from rank 1.

    A vertex of the next level hangs from the neighbour discovered first, and a level is ordered by (place of the
    parent, id). Places are increasing numbers from a range sort, so no level passes through one task. Stops after
    `max_level`, or with the level that has discovered all of `until` or `max_vertices`; `visit(level, frontier)`
    may stop it by returning False.
    """
    g.check(root)
    spark = g.edges.sparkSession
    if g.local and not visit:
        shared = g.local
        return kernels.once(spark, lambda: kernels.search(shared.value, root, max_level, until, max_vertices), "v long, parent long, level int, rank long")
    arcs = cut(g.arcs.select("src", "dst").repartition("src"))
    frontier = spark.createDataFrame([(root, None, 0, 0)], _TREE)
    levels, seen, found, level = [frontier], frontier.select("v"), 1, 0
    wanted = set(until or ()) - {root}
    while (max_level is None or level < max_level) and (until is None or wanted) and (max_vertices is None or found < max_vertices):
        if visit and visit(level, frontier) is False:
            break
        level += 1
        new = arcs.join(frontier.select(F.col("v").alias("src"), "at"), "src").groupBy(F.col("dst").alias("v")).agg(F.min(F.struct("at", "src")).alias("by"))
        new = new.join(seen, "v", "left_anti").select("v", F.col("by.src").alias("parent"), F.lit(level).alias("level"), F.col("by.at").alias("by"))
        frontier = cut(new.repartitionByRange("by", "v").sortWithinPartitions("by", "v").select("v", "parent", "level", F.monotonically_increasing_id().alias("at")))
        n = frontier.count()
        if not n:
            break
        levels.append(frontier)
        found += n
        if wanted:
            wanted -= {r.v for r in frontier.where(F.col("v").isin(list(wanted))).collect()}
        seen = cut(seen.union(frontier.select("v"))) if level % 8 == 0 else seen.union(frontier.select("v"))
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    ranked = numbered(out, ["level", "at"], "rank").select("v", "parent", "level", "rank")
    return ranked if max_vertices is None else ranked.where(F.col("rank") <= max_vertices)


#: Rounds after which what was reached is written as one table.
COMPACT = 8


def levels_from(g: Graph, roots: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(src, v, level): hops from every root at once. roots: (v)."""
    if g.local:
        shared = g.local
        return kernels.each(roots.select("v").distinct(), lambda v: kernels.levels(shared.value, v, max_rounds), "src long, v long, level int")
    arcs = cut(g.arcs.select(F.col("src").alias("v"), "dst").repartition("v"))
    frontier = cut(roots.select(F.col("v").alias("src"), "v").distinct())
    seen, level = frontier.withColumn("level", F.lit(0)), 0
    while max_rounds is None or level < max_rounds:
        level += 1
        reached = frontier.join(arcs, "v").select("src", F.col("dst").alias("v")).distinct()
        frontier = cut(reached.join(seen, ["src", "v"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.withColumn("level", F.lit(level)))
        if level % COMPACT == 0:
            seen = cut(seen)
    return seen


def level_sizes(tree: DataFrame) -> DataFrame:
    return tree.groupBy("level").agg(F.count("*").alias("size"))


def distance(g: Graph, s: int, t: int) -> int | None:
    """Hops from s to t; None if there is no way."""
    g.check(t)
    r = bfs(g, s, until={t}).where(F.col("v") == t).first()
    return r.level if r else None


def eccentricity(g: Graph, v: int) -> tuple[int, int]:
    """(largest level, the vertex discovered last)."""
    r = bfs(g, v).agg(F.max("level").alias("level"), F.max_by("v", "rank").alias("v")).first()
    return r.level, r.v


def eccentricities(g: Graph, roots: DataFrame) -> DataFrame:
    return levels_from(g, roots).groupBy(F.col("src").alias("v")).agg(F.max("level").alias("eccentricity"))


def path(tree: DataFrame, target: int) -> list[int]:
    """From the root to the target; empty if it is not reached."""
    if tree.where(F.col("v") == target).isEmpty():
        return []
    return ancestors(tree.where("parent is not null").select("v", "parent"), target)[::-1]


def ancestors(parents: DataFrame, v: int) -> list[int]:
    """v and the vertices above it; parents (v, parent) without a cycle. Pointers are doubled, so the jobs are the logarithm of the depth."""
    jumps = [cut(parents.select("v", F.col("parent").alias("to")))]
    while True:
        j = jumps[-1]
        more = cut(j.join(j.select(F.col("v").alias("to"), F.col("to").alias("next")), "to").select("v", F.col("next").alias("to")))
        if more.isEmpty():
            break
        jumps.append(more)
    found = parents.sparkSession.createDataFrame([(v, 0)], "v long, at long")
    for k in range(len(jumps) - 1, -1, -1):
        found = found.union(found.join(jumps[k], "v").select("to", F.col("at") + F.lit(1 << k)))
    return [r.v for r in found.distinct().orderBy("at").collect()]


class Visitor:
    """What may be told of a search, in its order; a call that returns False ends the telling."""

    def discover(self, v: int, parent: int | None, level: int):
        """A vertex is met."""

    def level_complete(self, level: int):
        """All of a level has been met."""

    def settle(self, v: int, parent: int | None, distance: float):
        """A vertex of a weighted search has its distance."""

    def finish(self):
        """Nothing is left."""


def walk(tree: DataFrame, visitor: Visitor) -> None:
    """Tells a visitor of a tree of any search, in order of rank; rows come to the driver one after another."""
    weighted, before = "distance" in tree.columns, 0
    for r in tree.orderBy("rank").toLocalIterator():
        if not weighted and r.level > before:
            if visitor.level_complete(before) is False:
                return
            before = r.level
        if (visitor.settle(r.v, r.parent, r.distance) if weighted else visitor.discover(r.v, r.parent, r.level)) is False:
            return
    if weighted or visitor.level_complete(before) is not False:
        visitor.finish()


#: Arcs that one task may hold for a search that cannot be split.
DFS_ARCS = 50_000_000


def dfs(g: Graph, root: int, max_depth: int | None = None) -> DataFrame:
    """(v, parent, level, rank) in pre-order, neighbours in order of id.

    Depth-first order is sequential: the arcs of the root's component go to one task, which is refused beyond DFS_ARCS.
    """
    g.check(root)
    spark, schema = g.edges.sparkSession, "v long, parent long, level int, rank long"
    if g.local:
        shared = g.local
        tree = kernels.once(spark, lambda: kernels.depth_first(shared.value, root), schema)
    else:
        label = cut(components.labels(g))
        own = label.where(F.col("component") == label.where(F.col("v") == root).first().component).select(F.col("v").alias("src"))
        arcs, n = g.arcs.select("src", "dst").join(own, "src"), g.n
        size = arcs.count()
        if size > DFS_ARCS:
            raise GraphError(f"depth-first search of {size} arcs is beyond {DFS_ARCS}")
        if not size:
            return spark.createDataFrame([(root, None, 0, 1)], schema)

        def run(t):
            src, dst = (t.column(c).to_numpy() for c in ("src", "dst"))
            return pa.table(dict(zip(("v", "parent", "level", "rank"), kernels.depth_first(kernels.Arcs(n, src, dst, np.zeros(len(src))), root))))

        tree = arcs.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, schema)
    if max_depth is not None:
        tree = cut(tree)
        deepest = tree.agg(F.max("level")).first()[0]
        if deepest > max_depth:
            raise RecursionLimit(f"depth {deepest} is beyond {max_depth}")
    return tree

"""Cuts of undirected graphs: a choice of vertices, renumbered, and the edges among them; tree layouts."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwright.model import Graph, GraphError
from arcwright.operators import kernels, stats
from arcwright.operators.traversal import bfs
from arcwright.plans.loops import cut
from arcwright.plans.order import numbered

RULES = ("ball", "most-connected", "earliest")


def select(g: Graph, rule: str, seed: int, most: int) -> DataFrame:
    """(old_id, new_id): `most` vertices by a rule; a seed outside the graph counts as 1."""
    rule = rule.lower().replace("_", "-")
    if rule not in RULES:
        raise GraphError(f"unknown rule {rule!r}: one of {', '.join(RULES)}")
    most = max(0, min(most, g.n))
    seed = seed if 1 <= seed <= g.n else 1
    if rule == "earliest":
        return g.vertices.where(F.col("v") <= most).select(F.col("v").alias("old_id"), F.col("v").alias("new_id"))
    if rule == "ball":
        if not most:
            return g.vertices.where("false").select(F.col("v").alias("old_id"), F.col("v").alias("new_id"))
        return bfs(g, seed, max_vertices=most).select(F.col("v").alias("old_id"), F.col("rank").alias("new_id"))
    top = stats.degrees(g).orderBy(F.desc("degree"), "v").limit(most)
    return numbered(top, [F.desc("degree"), F.col("v")], "new_id").select(F.col("v").alias("old_id"), "new_id")


def induce(g: Graph, kept: DataFrame) -> DataFrame:
    """(u, v, weight) among kept vertices, in their new numbers, u < v."""
    a = kept.select(F.col("old_id").alias("u"), F.col("new_id").alias("nu"))
    b = kept.select(F.col("old_id").alias("v"), F.col("new_id").alias("nv"))
    e = g.edges.join(a, "u").join(b, "v")
    if g.directed:
        return e.where("nv > nu").select(F.col("nu").alias("u"), F.col("nv").alias("v"), "weight")
    return e.select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"), "weight")


def egonet(g: Graph, seed: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(kept, edges) within `radius` hops of the seed, which becomes 1."""
    g.check(seed)
    kept = cut(bfs(g, seed, max_level=radius).select(F.col("v").alias("old_id"), F.col("rank").alias("new_id")))
    return kept, induce(g, kept)


_PLACED = "v long, parent long, level int, rank long, size long, pre long, angle double, slot double"


def _placed(tree: DataFrame) -> DataFrame | None:
    """All of a layout at once, in one task, where the tree is within its bounds."""
    if tree.count() > kernels.LOCAL_EDGES:
        return None

    def run(t: pa.Table) -> pa.Table:
        v, level, rank = (t.column(c).to_numpy() for c in ("v", "level", "rank"))
        parent = t.column("parent").fill_null(0).to_numpy()
        made = kernels.placed(v, parent, level, rank)
        return pa.table([t.column("v"), t.column("parent"), t.column("level"), t.column("rank"), *map(pa.array, made)], names=["v", "parent", "level", "rank", "size", "pre", "angle", "slot"])

    rows = tree.select("v", "parent", F.col("level").cast("int").alias("level"), F.col("rank").cast("long").alias("rank"))
    return rows.groupBy(F.lit(0).alias("all")).applyInArrow(run, _PLACED)


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(v, parent, level, rank, size) of a search tree, from the deepest level up."""
    whole = _placed(tree)
    if whole is not None:
        return whole.select("v", "parent", "level", "rank", "size")
    deepest = tree.agg(F.max("level")).first()[0] or 0
    sizes = tree.where(F.col("level") == deepest).select("v", "parent", F.lit(1).cast("long").alias("size"))
    out = sizes
    for level in range(deepest - 1, -1, -1):
        below = sizes.groupBy(F.col("parent").alias("v")).agg(F.sum("size").alias("s"))
        sizes = cut(tree.where(F.col("level") == level).join(below, "v", "left").select("v", "parent", (1 + F.coalesce("s", F.lit(0))).alias("size")))
        out = out.union(sizes)
    return tree.join(out.select("v", "size"), "v")


def _wedges(tree: DataFrame) -> DataFrame:
    """(v, parent, level, size, pre, angle): each child gets a wedge of its parent's, in proportion to its subtree, in order of rank; pre is its place in pre-order."""
    from pyspark.sql import Window

    t = cut(subtree_sizes(tree))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("parent").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = cut(t.withColumn("before", before))
    deepest = t.agg(F.max("level")).first()[0] or 0
    at = t.where("level = 0").select("v", F.lit(0).cast("long").alias("pre"), F.lit(0.0).alias("start"), F.lit(2 * math.pi).alias("width"), "size")
    out = at
    for level in range(1, deepest + 1):
        up = at.select(F.col("v").alias("parent"), F.col("pre").alias("pp"), F.col("start").alias("ps"), F.col("width").alias("pw"), F.col("size").alias("pn"))
        child = t.where(F.col("level") == level).join(up, "parent")
        unit = F.col("pw") / F.greatest(F.col("pn") - 1, F.lit(1))
        at = cut(child.select("v", (F.col("pp") + 1 + F.col("before")).alias("pre"), (F.col("ps") + F.col("before") * unit).alias("start"), (F.col("size") * unit).alias("width"), "size"))
        out = out.union(at)
    return t.select("v", "parent", "level").join(out.select("v", "pre", (F.col("start") + F.col("width") / 2).alias("angle"), "size"), "v")


def radial_layout(tree: DataFrame) -> DataFrame:
    """(v, level, angle, size): the middle of each vertex's wedge."""
    whole = _placed(tree)
    return (_wedges(tree) if whole is None else whole).select("v", "level", "angle", "size")


def tree_layout(tree: DataFrame) -> DataFrame:
    """(v, slot, depth): leaves side by side in the order of the tree, parents centred over their first and last child."""
    whole = _placed(tree)
    if whole is not None:
        return whole.select("v", "slot", F.col("level").alias("depth"))
    t = _wedges(tree)
    at = cut(numbered(t.where("size = 1").select("v", "parent", "level", "pre"), ["pre"], "place").select("v", "parent", "level", (F.col("place") - 1).cast("double").alias("slot")))
    out, deepest = at, tree.agg(F.max("level")).first()[0] or 0
    for level in range(deepest - 1, -1, -1):
        mid = out.where(F.col("level") == level + 1).groupBy(F.col("parent").alias("v")).agg(((F.min("slot") + F.max("slot")) / 2).alias("slot"))
        out = cut(out.union(tree.where(F.col("level") == level).join(mid, "v").select("v", "parent", "level", "slot")))
    return out.select("v", "slot", F.col("level").alias("depth"))

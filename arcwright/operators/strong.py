"""Strong components, condensation and topological order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwright.model import Graph, NotAcyclic
from arcwright.operators import kernels
from arcwright.operators.components import CLEAR, min_labels
from arcwright.plans.loops import clear, cut

#: Arcs of a class of vertices, closed under strong connection, that one task searches by itself.
CLASS_EDGES = 5_000_000


def _least(arcs: DataFrame, values: DataFrame) -> DataFrame:
    """(v, c): the smallest value that reaches v along arcs; values (v, c) of all vertices on them."""
    best, turn = cut(values.select("v", "c", F.lit(True).alias("moved"))), 0
    while True:
        via = arcs.join(best.where("moved").select(F.col("v").alias("src"), "c"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("new"))
        best = cut(best.join(via, "v", "left").select("v", F.least("c", "new").alias("c"), F.coalesce(F.col("new") < F.col("c"), F.lit(False)).alias("moved")))
        if best.where("moved").isEmpty():
            return best.select("v", "c")
        turn = _turned(arcs, turn)


def _turned(rows: DataFrame, turn: int) -> int:
    """The next turn of a loop; what the driver and the disk hold of former ones is let go now and then."""
    if (turn + 1) % CLEAR == 0:
        clear(rows.sparkSession)
    return turn + 1


def _trim(arcs: DataFrame) -> DataFrame:
    """Arcs without those at vertices that have none in or none out, round by round."""
    n, turn = arcs.count(), 0
    while n:
        inner = arcs.select(F.col("src").alias("v")).intersect(arcs.select(F.col("dst").alias("v")))
        kept = cut(arcs.join(inner.withColumnRenamed("v", "src"), "src", "left_semi").join(inner.withColumnRenamed("v", "dst"), "dst", "left_semi"))
        m = kept.count()
        arcs = kept
        if m == n:
            break
        n, turn = m, _turned(arcs, turn)
    return arcs


def _reached(same: DataFrame) -> DataFrame:
    """Of arcs (src, dst, c) within classes: (v, scc) of the vertices that reach the vertex c of their class, which is theirs."""
    ends = same.select(F.col("src").alias("v"), "c").union(same.select(F.col("dst").alias("v"), "c")).distinct()
    hit, turn = cut(ends.select("v", "c", (F.col("v") == F.col("c")).alias("hit"), (F.col("v") == F.col("c")).alias("moved"))), 0
    while True:
        via = same.join(hit.where("moved").select(F.col("v").alias("dst")), "dst").select(F.col("src").alias("v"), F.lit(True).alias("new")).distinct()
        hit = cut(hit.join(via, "v", "left").select("v", "c", (F.col("hit") | F.col("new").isNotNull()).alias("hit"), (~F.col("hit") & F.col("new").isNotNull()).alias("moved")))
        if hit.where("moved").isEmpty():
            return hit.where("hit").select("v", F.col("c").alias("scc"))
        turn = _turned(same, turn)


def _task(t: pa.Table) -> pa.Table:
    v, scc = kernels.strong_of(*(t.column(k).to_numpy() for k in ("src", "dst")))
    return pa.table({"v": v, "scc": scc})


def _apart(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of arcs (src, dst, c) within classes: (v, scc) of the classes that fit in one task, and the arcs of the others."""
    sizes = cut(arcs.groupBy("c").agg(F.count("*").alias("m")))
    share = max(1, CLASS_EDGES // 8)
    tasks = int(sizes.agg(F.sum("m")).first()[0] or 0) // share + 1
    # classes of more than a share are few and broadcast; the rest share tasks, under numbers below zero
    flagged = arcs.join(F.broadcast(sizes.where(F.col("m") > share)), "c", "left")
    key = F.when(F.col("m").isNull(), -1 - F.pmod(F.xxhash64("c"), F.lit(tasks))).otherwise(F.col("c"))

    small = flagged.where(F.coalesce("m", F.lit(0)) <= CLASS_EDGES).select(key.alias("task"), "src", "dst")
    return small.groupBy("task").applyInArrow(_task, "v long, scc long"), flagged.where(F.col("m") > CLASS_EDGES).select("src", "dst", "c")


def strong_components(g: Graph) -> DataFrame:
    """(v, scc): scc is the smallest vertex of the component.

    A graph that fits is searched in one task, which gets its arcs from the executors. Of a larger one, classes that no strong
    component crosses are searched each in one task where they fit: first the weak components. Those that are larger go round by
    round: vertices that cannot be on a cycle are trimmed; the smallest id that reaches a vertex colours it, which gives smaller
    classes; what reaches the vertex that gave a colour within that colour is its component and leaves.
    """
    if not g.directed:
        from arcwright.operators.components import labels

        return labels(g).withColumnRenamed("component", "scc")
    if g.local:
        shared = g.local
        return kernels.once(g.edges.sparkSession, lambda: kernels.strong(shared.value), "v long, scc long")
    arcs = g.arcs.select("src", "dst")
    found = cut(arcs.groupBy(F.lit(0).alias("task")).applyInArrow(_task, "v long, scc long")) if g.edge_count <= CLASS_EDGES else _by_class(g, arcs)
    return g.vertices.join(found, "v", "left").select("v", F.coalesce("scc", "v").alias("scc"))


def _by_class(g: Graph, arcs: DataFrame) -> DataFrame:
    """(v, scc) of at least all vertices whose component is not themselves alone."""
    weak = min_labels(g.edges.select("u", "v")).select(F.col("v").alias("src"), F.col("component").alias("c"))
    small, large = _apart(cut(arcs.join(weak, "src")))
    found, arcs = cut(small), cut(large.select("src", "dst"))
    del weak, small, large  # plans that are held hold their files
    while True:
        arcs = _trim(arcs)
        if arcs.isEmpty():
            return found
        vertices = arcs.select(F.col("src").alias("v")).distinct()
        colour = cut(_least(arcs, vertices.select("v", F.col("v").alias("c"))))
        ends = arcs.join(colour.select(F.col("v").alias("src"), "c"), "src").join(colour.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst")
        small, large = _apart(cut(ends.where("c = cd").select("src", "dst", "c")))
        found, same = found.union(cut(small)), cut(large)
        del vertices, colour, ends, small, large
        done = _reached(same)
        found = cut(found.union(done))
        gone = done.select("v")
        arcs = cut(same.select("src", "dst").join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti"))
        del same, done, gone


def condensation(g: Graph, scc: DataFrame | None = None) -> DataFrame:
    """(u, v): arcs between different components, each once."""
    scc = cut(strong_components(g)) if scc is None else scc
    e = g.arcs.join(scc.select(F.col("v").alias("src"), F.col("scc").alias("u")), "src").join(scc.select(F.col("v").alias("dst"), F.col("scc").alias("to")), "dst")
    return e.where("u <> to").select("u", F.col("to").alias("v")).distinct()


def component_ids(g: Graph) -> DataFrame:
    """(v, component): strong components numbered 1, 2, ... in a topological order, by layer and smallest vertex.

    Every arc between components goes from a smaller to a larger number. Of an undirected graph they are the components, by smallest vertex.
    """
    from arcwright.plans.order import numbered

    scc = cut(strong_components(g))
    if not g.directed:
        ranked = numbered(scc.select("scc").distinct(), ["scc"], "component")
    else:
        small = Graph(condensation(g, scc).withColumn("weight", F.lit(1.0)), g.n, True)
        ranked = numbered(layers(small).join(scc.select(F.col("scc").alias("v")).distinct(), "v", "left_semi"), ["layer", "v"], "component").select(F.col("v").alias("scc"), "component")
    return scc.join(ranked, "scc").select("v", "component")


def by_size(g: Graph) -> DataFrame:
    """(v, component): strong components numbered 1, 2, ... by size, largest first, then by smallest vertex."""
    from arcwright.plans.order import numbered

    scc = cut(strong_components(g))
    sizes = scc.groupBy("scc").agg(F.count("*").alias("size"))
    return scc.join(numbered(sizes, [F.desc("size"), F.col("scc")], "component").select("scc", "component"), "scc").select("v", "component")


def largest_size(g: Graph) -> int:
    return strong_components(g).groupBy("scc").count().agg(F.max("count")).first()[0]


def is_acyclic(g: Graph) -> bool:
    """No cycle but perhaps loops; an edge that may be walked both ways is a cycle."""
    return largest_size(g) == 1


def members(g: Graph, scc: int) -> DataFrame:
    """(v) of the strong component of smallest vertex `scc`."""
    return strong_components(g).where(F.col("scc") == scc).select("v").orderBy("v")


def layers(g: Graph) -> DataFrame:
    """(v, layer): length of the longest way to v; refused for a graph with a cycle."""
    if g.local:
        shared = g.local
        made = cut(kernels.once(g.edges.sparkSession, lambda: kernels.layers(shared.value), "v long, layer int"))
        if not made.where("layer < 0").isEmpty():
            raise NotAcyclic(largest_size(g))
        return made
    arcs = cut(g.arcs.select("src", "dst"))
    out, left, layer = None, cut(g.vertices), 0
    while True:
        free = cut(left.join(arcs.select(F.col("dst").alias("v")), "v", "left_anti"))
        if free.isEmpty():
            break
        rows = free.select("v", F.lit(layer).alias("layer"))
        out = rows if out is None else out.union(rows)
        left = cut(left.join(free, "v", "left_anti"))
        arcs = cut(arcs.join(free.withColumnRenamed("v", "src"), "src", "left_anti"))
        layer += 1
    if not left.isEmpty():
        raise NotAcyclic(largest_size(g))
    return out


def topological_order(g: Graph) -> DataFrame:
    """(v, place): every arc goes from a smaller to a larger place."""
    from arcwright.plans.order import numbered

    return numbered(layers(g), ["layer", "v"], "place").select("v", "place")

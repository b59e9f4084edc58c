"""Weighted shortest paths: from roots, to a target, and between all pairs.

Distances are the fixpoint of d[v] = min(d[u] + w), reached by joining only the vertices that were lowered with their
arcs, round by round, for any number of sources at once. Rounded addition is monotone, so the fixpoint does not
depend on the order of relaxing. Graphs that fit in one task are searched there (`kernels`), each source by itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwright.model import Cancelled, Graph, GraphError, NegativeCycle, NegativeWeight, NotAcyclic, OverBudget, strategy
from arcwright.operators import kernels, normalize
from arcwright.plans.loops import cut, cut_bare
from arcwright.plans.order import numbered


def _arcs(g: Graph) -> DataFrame:
    return cut(g.arcs.select(F.col("src").alias("v"), "dst", "weight").repartition("v"))


#: Rounds after which the estimates, kept as one table and what has been lowered since, are written as one table.
COMPACT = 4

_FOUND = "src long, v long, distance double, cycle int"


def fixpoint(g: Graph, starts: DataFrame, max_distance: float | None = None, target: int | None = None, schedule: str = "queue") -> DataFrame:
    """(src, v, distance) from starts (src, v, distance). Raises NegativeCycle where one is reachable.

    By `schedule`, a round relaxes the arcs of what the last one lowered (queue, slf), those of all that is reached (rounds,
    early-stop), or of what was lowered, arcs to larger vertices first and then those to smaller ones (yen, random-yen). With
    `max_distance`, ways that are longer are not followed; with a `target`, neither are ways longer than the best one to it
    that is known.
    """
    if not g.directed and not g.edges.where("weight < 0").isEmpty():
        _undirected_cycle(g, starts)
    schedule = strategy("schedule", schedule)
    best = _local(g, starts, max_distance, target, schedule) if g.local else _rounds(g, starts, max_distance, target, schedule)
    if g.negative_loops is not None:
        loop = best.select("v").distinct().join(g.negative_loops, "v").orderBy("v").first()
        if loop:
            raise NegativeCycle([loop.v], loop.weight)
    return best


def _local(g: Graph, starts: DataFrame, most: float | None, target: int | None, schedule: str) -> DataFrame:
    """Each source's searches in one task, from a broadcast of the arcs."""
    shared = g.local

    def run(t: pa.Table) -> pa.Table:
        src, v, d = (t.column(c).to_numpy() for c in ("src", "v", "distance"))
        best, cycle = kernels.distances(shared.value, v, d, most, target, schedule)
        if cycle:
            return pa.table({"src": np.full(len(cycle), src[0]), "v": cycle, "distance": np.zeros(len(cycle)), "cycle": pa.array(range(len(cycle)), pa.int32())})
        v = np.flatnonzero(np.isfinite(best))
        return pa.table({"src": np.full(len(v), src[0]), "v": v, "distance": best[v], "cycle": pa.nulls(len(v), pa.int32())})

    made = cut(starts.select("src", "v", "distance").groupBy("src").applyInArrow(run, _FOUND))
    _refuse_cycle(g, made.where("cycle is not null"))
    return made.select("src", "v", "distance")


#: Schedules of rounds over all that is reached, and of two sweeps a round.
FULL, SWEEPS = ("rounds", "early-stop"), ("yen", "random-yen")


def _relaxed(front: DataFrame, arcs: DataFrame) -> DataFrame:
    """(src, v, new (distance, parent)): the best that the arcs of a front lead to."""
    return front.join(arcs, "v").groupBy("src", F.col("dst").alias("v")).agg(F.min(F.struct((F.col("distance") + F.col("weight")).alias("distance"), F.col("v").alias("parent"))).alias("new"))


def every(g: Graph, roots: DataFrame) -> DataFrame:
    """(src, v, distance) from each root (v) by itself."""
    starts = roots.select(F.col("v").alias("src"), "v", F.lit(0.0).alias("distance"))
    if not g.local or (g.negative_loops is not None and not g.negative_loops.isEmpty()):
        return fixpoint(g, starts)
    if not g.directed and not g.edges.where("weight < 0").isEmpty():
        _undirected_cycle(g, starts)
    shared = g.local
    reach: list[kernels.Reach] = []  # one a task, once it knows that no arc is negative

    def work(v):
        if not reach and not (len(shared.value.weight) and shared.value.weight.min() < 0):
            reach.append(kernels.Reach(shared.value))
        if reach:
            reached, distance = reach[0](v)
            return np.full(len(reached), v), reached, distance, np.full(len(reached), -1, np.int32)
        best, cycle = kernels.distances(shared.value, np.array([v]), np.zeros(1))
        if cycle:
            return np.full(len(cycle), v), np.array(cycle), np.zeros(len(cycle)), np.arange(len(cycle), dtype=np.int32)
        reached = np.flatnonzero(np.isfinite(best))
        return np.full(len(reached), v), reached, best[reached], np.full(len(reached), -1, np.int32)

    made = cut(kernels.each(roots.select("v").distinct(), work, _FOUND))
    _refuse_cycle(g, made.where("cycle >= 0"))
    return made.select("src", "v", "distance")


def _refuse_cycle(g: Graph, found: DataFrame) -> None:
    """found: (src, v, cycle), the places of vertices on a cycle."""
    bad = found.orderBy("src", "cycle").limit(g.n).collect()
    if bad:
        cycle = [r.v for r in bad if r.src == bad[0].src]
        raise NegativeCycle(cycle, path_length(g, [*cycle, cycle[0]]))


def _rounds(g: Graph, starts: DataFrame, max_distance: float | None, target: int | None, schedule: str) -> DataFrame:
    """Joins of what was lowered with its arcs, round by round."""
    arcs = _arcs(g)
    negative = not arcs.where("weight < 0").isEmpty()
    lowered = cut(starts.groupBy("src", "v").agg(F.min("distance").alias("distance")).withColumn("parent", F.lit(None).cast("long")))
    best, turn, look = lowered, 0, 8
    while True:
        turn += 1
        front, own = best if schedule in FULL else lowered, arcs
        if schedule in SWEEPS:
            # arcs down are relaxed with what the arcs up have just lowered, too
            up = _relaxed(front, arcs.where("dst > v")).select("src", "v", "new.*")
            front, own = front.select("src", "v", "distance").union(up.select("src", "v", "distance")).groupBy("src", "v").agg(F.min("distance").alias("distance")), arcs
        via = _relaxed(front, own)
        if max_distance is not None:
            via = via.where(F.col("new.distance") <= max_distance)
        if target is not None:
            known = best.where(F.col("v") == target).agg(F.max("distance")).first()[0]
            via = via if known is None else via.where(F.col("new.distance") <= known)
        old = best.select("src", "v", F.col("distance").alias("old"))
        lowered = cut(via.join(old, ["src", "v"], "left").where("old is null or new.distance < old").select("src", "v", F.col("new.distance").alias("distance"), F.col("new.parent").alias("parent")))
        if lowered.isEmpty():
            return best.select("src", "v", "distance")
        best = best.union(lowered).groupBy("src", "v").agg(F.min(F.struct("distance", "parent")).alias("b")).select("src", "v", "b.distance", "b.parent")
        if turn % COMPACT == 0 or negative and (turn == look or turn > g.n):
            best = cut(best)
        if negative and (turn == look or turn > g.n):
            look *= 2
            cycle = _parent_cycle(best, g)
            if cycle:
                raise cycle


def _undirected_cycle(g: Graph, starts: DataFrame) -> None:
    """An undirected negative edge that can be reached is a cycle there and back."""
    from arcwright.operators.traversal import levels_from

    reached = levels_from(g, starts.select("v").distinct()).select("v").distinct()
    r = g.edges.where("weight < 0").join(reached.withColumnRenamed("v", "u"), "u").orderBy("u", "v").first()
    if r:
        raise NegativeCycle([r.u, r.v], 2 * r.weight)


def _parent_cycle(best: DataFrame, g: Graph) -> NegativeCycle | None:
    """A cycle of parent pointers, found by doubling: who has an ancestor further away than there are vertices is behind one."""
    parents = cut(best.where("parent is not null").select("src", "v", "parent"))
    jump, reach, n = parents.select("src", "v", F.col("parent").alias("to")), 1, best.count()
    while reach <= n:
        jump = cut(jump.join(jump.select("src", F.col("v").alias("to"), F.col("to").alias("next")), ["src", "to"]).select("src", "v", F.col("next").alias("to")))
        reach *= 2
        if jump.isEmpty():
            return None
    r = jump.orderBy("src", "to").first()
    # r.to is on a cycle: its parents are followed until one comes again
    own = parents.where(F.col("src") == r.src).select("v", "parent")
    found, step, jump = parents.sparkSession.createDataFrame([(r.to, 0)], "v long, at long"), 1, cut(own.withColumnRenamed("parent", "to"))
    while True:
        found = cut(found.union(found.join(jump, "v").select("to", F.col("at") + F.lit(step))))
        back = found.where((F.col("v") == r.to) & (F.col("at") > 0)).agg(F.min("at")).first()[0]
        if back is not None:
            break
        step *= 2
        jump = cut(jump.join(jump.select(F.col("v").alias("to"), F.col("to").alias("next")), "to").select("v", F.col("next").alias("to")))
    cycle = [x.v for x in found.where(F.col("at") < back).orderBy(F.desc("at")).collect()]
    return NegativeCycle(cycle, path_length(g, [*cycle, cycle[0]]))


def _roots(g: Graph, roots: list[int]) -> DataFrame:
    return g.edges.sparkSession.createDataFrame([(g.check(v), v, 0.0) for v in roots], "src long, v long, distance double")


def distances(g: Graph, roots: list[int], schedule: str = "queue") -> DataFrame:
    """(src, v, distance) from a few roots, any weights."""
    return fixpoint(g, _roots(g, roots), schedule=schedule)


def refuse_negative(g: Graph) -> None:
    r = normalize.first_negative(g.edges).first()
    if r:
        raise NegativeWeight(r.u, r.v, r.weight)


#: Arcs of weight zero, at one distance, whose vertices one task puts in order.
SETTLED_ARCS = 50_000_000


def tree(g: Graph, reached: DataFrame, root: int) -> DataFrame:
    """(v, parent, distance, rank) from (v, distance).

    Rank is the order of settling: by distance, then id; among equal distances a vertex that is only reached over
    arcs of weight zero settles after the one it is reached from. The parent is the tight neighbour settled first.
    """
    if g.local:
        shared = g.local

        def run(t: pa.Table) -> pa.Table:
            best = np.full(shared.value.n + 1, np.inf)
            best[t.column("v").to_numpy()] = t.column("distance").to_numpy()
            return pa.table(dict(zip(("v", "parent", "distance", "rank"), kernels.settled(shared.value, best, root))))

        return reached.groupBy(F.lit(0).alias("all")).applyInArrow(run, "v long, parent long, distance double, rank long")
    tight = g.arcs.join(reached.select(F.col("v").alias("src"), F.col("distance").alias("ds")), "src").join(reached.select(F.col("v").alias("dst"), F.col("distance").alias("dd")), "dst").where("ds + weight = dd")
    tight = cut(tight.where(F.col("dst") != root).select("src", "dst", "ds", "dd"))
    level = tight.where("ds = dd")
    if level.isEmpty():
        order = reached.withColumn("place", F.lit(0).cast("long"))
    else:
        classes = level.select(F.col("dd").alias("distance")).distinct()
        inside = reached.join(classes, "distance")
        seeds = tight.where("ds < dd").select(F.col("dst").alias("v")).distinct().withColumn("seed", F.lit(True))
        most = level.groupBy("dd").count().agg(F.max("count")).first()[0]
        if most > SETTLED_ARCS:
            raise GraphError(f"{most} arcs of weight zero at one distance are beyond {SETTLED_ARCS}: their order is made in one task")
        rows = inside.join(seeds, "v", "left").select("distance", "v", F.coalesce("seed", F.col("v") == root).alias("seed"), F.lit(None).cast("long").alias("dst"))
        rows = rows.union(level.select(F.col("dd"), F.col("src"), F.lit(False), F.col("dst")))
        placed = rows.groupBy("distance").applyInPandas(_settle, "distance double, v long, place long")
        order = reached.join(placed.select("v", "place"), "v", "left").withColumn("place", F.coalesce("place", F.lit(0)))
    ranked = cut(numbered(order, ["distance", "place", "v"], "rank").select("v", "distance", "rank"))
    by = tight.join(ranked.select(F.col("v").alias("src"), F.col("rank").alias("rs")), "src").join(ranked.select(F.col("v").alias("dst"), F.col("rank").alias("rd")), "dst").where("rs < rd")
    parent = by.groupBy(F.col("dst").alias("v")).agg(F.min_by("src", "rs").alias("parent"))
    return ranked.join(parent, "v", "left").select("v", "parent", "distance", "rank")


def _settle(pdf):
    """Places within one distance: smallest id first among those reached so far."""
    import heapq

    import pandas as pd

    links: dict[int, list[int]] = {}
    for v, d in pdf[pdf["dst"].notna()][["v", "dst"]].itertuples(index=False):
        links.setdefault(v, []).append(int(d))
    heap = pdf.loc[pdf["dst"].isna() & pdf["seed"], "v"].tolist()
    heapq.heapify(heap)
    place: dict[int, int] = {}
    while heap:
        v = heapq.heappop(heap)
        if v not in place:
            place[v] = len(place) + 1
            for w in links.get(v, ()):
                if w not in place:
                    heapq.heappush(heap, w)
    return pd.DataFrame({"distance": pdf["distance"].iloc[0], "v": list(place), "place": list(place.values())})


def dijkstra(g: Graph, root: int, frontier: str = "heap") -> DataFrame:
    """Tree from a root; refused if the graph has a negative edge anywhere."""
    strategy("frontier", frontier)
    refuse_negative(g)
    return tree(g, cut(distances(g, [root]).select("v", "distance")), root)


def bellman_ford(g: Graph, root: int, schedule: str = "queue") -> DataFrame:
    """Tree from a root, weights of any sign."""
    return tree(g, cut(distances(g, [root], schedule).select("v", "distance")), root)


def bellman_ford_to(g: Graph, target: int, schedule: str = "queue") -> DataFrame:
    """(v, successor, distance, rank): distances to a target."""
    try:
        return bellman_ford(g.transpose(), target, schedule).withColumnRenamed("parent", "successor")
    except NegativeCycle as e:
        raise e.reversed() from None


def shortest_path(g: Graph, s: int, t: int) -> tuple[float, list[int]] | None:
    """(distance, vertices) or None; ways longer than the best known to the target are not followed."""
    refuse_negative(g)
    g.check(t)
    from arcwright.operators.traversal import path

    near = cut(fixpoint(g, _roots(g, [s]), target=t).select("v", "distance"))
    r = near.where(F.col("v") == t).first()
    if r is None:
        return None
    # vertices on the way may have been left above their least distance only beyond the target's
    return r.distance, path(cut(tree(g, near.where(F.col("distance") <= r.distance), s)), t)


def frontier_after(g: Graph, made: DataFrame, step: int) -> DataFrame:
    """(v, estimate) of what is seen but not settled after `step` settlings of a tree."""
    settled = made.where(F.col("rank") <= step).select(F.col("v").alias("src"), "distance")
    seen = g.arcs.join(settled, "src").groupBy(F.col("dst").alias("v")).agg(F.min(F.col("distance") + F.col("weight")).alias("estimate"))
    return seen.join(settled.select(F.col("src").alias("v")), "v", "left_anti")


def potentials(g: Graph) -> DataFrame:
    """(v, h): distance from a source that has an arc of weight 0 to every vertex."""
    starts = g.vertices.select(F.lit(0).cast("long").alias("src"), "v", F.lit(0.0).alias("distance"))
    return fixpoint(g, starts).select("v", F.col("distance").alias("h"))


def negative_cycle(g: Graph) -> NegativeCycle | None:
    try:
        potentials(g).isEmpty()
    except NegativeCycle as e:
        return e
    return None


def reweighted(g: Graph, h: DataFrame) -> Graph:
    """Weights w + h(u) - h(v), none below zero."""
    e = g.edges.join(h.select(F.col("v").alias("u"), F.col("h").alias("hu")), "u").join(h.select("v", F.col("h").alias("hv")), "v")
    return Graph(e.select("u", "v", F.greatest(F.col("weight") + F.col("hu") - F.col("hv"), F.lit(0.0)).alias("weight")), g.n, g.directed, True)


def original(g: Graph, h: DataFrame) -> Graph:
    """The weights that `reweighted` had: w - h(u) + h(v)."""
    e = g.edges.join(h.select(F.col("v").alias("u"), F.col("h").alias("hu")), "u").join(h.select("v", F.col("h").alias("hv")), "v")
    return Graph(e.select("u", "v", (F.col("weight") - F.col("hu") + F.col("hv")).alias("weight")), g.n, g.directed, True)


def table_bytes(n: int) -> int:
    return 12 * (n * n + n)


#: Bytes that a table of all pairs may need where no budget is given: 100,000 vertices.
TABLE_BYTES = 120_000 * 1_000_000


def _within(g: Graph, budget: int | None) -> None:
    """budget: bytes, or UNLIMITED."""
    budget = TABLE_BYTES if budget is None else budget
    if budget != UNLIMITED and table_bytes(g.n) > budget:
        raise OverBudget(f"a table of all pairs needs {table_bytes(g.n)} bytes, more than {budget}")


UNLIMITED = -1


def johnson(g: Graph, frontier: str = "heap", budget: int | None = None) -> DataFrame:
    """(src, v, distance) of all connected pairs, over reweighted arcs."""
    strategy("frontier", frontier)
    _within(g, budget)
    h = cut(potentials(g))
    made = every(reweighted(g, h), g.vertices)
    hs, hv = h.select(F.col("v").alias("src"), F.col("h").alias("hs")), h.select("v", F.col("h").alias("hv"))
    return made.join(hs, "src").join(hv, "v").select("src", "v", (F.col("distance") - F.col("hs") + F.col("hv")).alias("distance"))


def floyd_warshall(g: Graph, sweep: str | Callable[[DataFrame], DataFrame] = "plain", budget: int | None = None, progress: Callable[[int], bool | None] | None = None) -> DataFrame:
    """(src, v, distance) of all connected pairs, by squaring the table under (min, +): log n joins.

    A sweep of one's own makes a better table of a table (src, v, distance), and is repeated until nothing changes. `progress`
    is told the number of each round and may end the work by returning False.
    """
    if not callable(sweep):
        strategy("sweep", sweep)
    _within(g, budget)
    if g.negative_loops is not None:
        loop = g.negative_loops.orderBy("v").first()
        if loop:
            raise NegativeCycle([loop.v], loop.weight)
    if not g.directed:
        r = normalize.first_negative(g.edges).first()
        if r:
            raise NegativeCycle([r.u, r.v], 2 * r.weight)
    own = g.vertices.select(F.col("v").alias("src"), "v", F.lit(0.0).alias("distance"))
    least = lambda df: df.groupBy("src", "v").agg(F.min("distance").alias("distance"))
    if g.local and not callable(sweep) and not progress:
        return every(g, g.vertices)  # rows are made apart, each from its own vertex, so nothing is joined
    d = cut(least(own.union(g.arcs.select("src", F.col("dst").alias("v"), F.col("weight").alias("distance")))))
    mark, hops, turn = None, 1, 0
    while callable(sweep) or hops < g.n:
        turn += 1
        d = cut(least(sweep(d) if callable(sweep) else squared(d)))
        if not d.where("src = v and distance < 0").isEmpty():
            raise negative_cycle(g)
        now = d.agg(F.count("*"), F.sum(F.xxhash64("src", "v", "distance").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, hops = now, hops * 2
        if progress and progress(turn) is False:
            raise Cancelled(f"stopped after round {turn}")
    return d


def squared(d: DataFrame) -> DataFrame:
    """All ways of a table (src, v, distance) put behind one another, and those of the table itself, which begin with none."""
    on = d.select(F.col("src").alias("v"), F.col("v").alias("to"), F.col("distance").alias("more"))
    return d.join(on, "v").select("src", F.col("to").alias("v"), (F.col("distance") + F.col("more")).alias("distance"))


def predecessors(g: Graph, pairs: DataFrame) -> DataFrame:
    """(src, v, distance, hops, parent) from (src, v, distance) of whole rows: of the tight ways the one of fewest arcs, by smallest parent.

    Fewest arcs first means that parents never loop, not even through cycles of weight zero. Tightness allows for rounding by
    TOLERANCE, as tables by squaring or over reweighted arcs are not added up arc by arc.
    """
    arcs = _arcs(g)
    table = cut_bare(pairs.select("src", "v", "distance"))
    ends = table.select("src", F.col("v").alias("dst"), F.col("distance").alias("dd"))
    gap = F.abs(F.col("ds") + F.col("weight") - F.col("dd"))
    scale = F.greatest(F.abs("ds"), F.abs("dd"), F.lit(1.0))
    tight = cut_bare(table.withColumnRenamed("distance", "ds").join(arcs, "v").join(ends, ["src", "dst"]).where((F.col("src") != F.col("dst")) & (gap <= TOLERANCE * scale)).select("src", "v", "dst"))
    front = cut_bare(table.where("src = v").select("src", "v", F.lit(0).alias("hops"), F.lit(None).cast("long").alias("parent")))
    out, hops = front, 0
    while True:
        hops += 1
        new = front.join(tight, ["src", "v"]).groupBy("src", F.col("dst").alias("v")).agg(F.min("v").alias("parent"))
        front = cut_bare(new.join(out.select("src", "v"), ["src", "v"], "left_anti").select("src", "v", F.lit(hops).alias("hops"), "parent"))
        if front.isEmpty():
            return table.join(out, ["src", "v"], "left").select("src", "v", "distance", "hops", "parent")
        out = out.union(front)
        if hops % COMPACT == 0:
            out = cut_bare(out)


def pair_path(g: Graph, pairs: DataFrame, s: int, t: int) -> tuple[float, list[int]] | None:
    """(distance, vertices) of one pair of a table of all pairs."""
    from arcwright.operators.traversal import path

    r = pairs.where((F.col("src") == s) & (F.col("v") == t)).first()
    if r is None:
        return None
    own = cut(predecessors(g, pairs.where(F.col("src") == s)))
    return r.distance, path(own, t)


def pair_table(pairs: DataFrame, vertices: list[int]) -> list[list[float | None]]:
    """Distances between a few vertices; None where there is no way."""
    got = pairs.where(F.col("src").isin(vertices) & F.col("v").isin(vertices)).collect()
    found = {(r.src, r.v): r.distance for r in got}
    return [[found.get((i, j)) for j in vertices] for i in vertices]


#: Two tables are the same within this share of the larger entry, or of one.
TOLERANCE = 1e-9


def check_sweep(g: Graph, sweep: Callable[[Graph], DataFrame]) -> DataFrame:
    """(src, v, distance, other): where a way of one's own to make a table of all pairs departs from this engine's; no row if nowhere."""
    own = floyd_warshall(g).select("src", "v", "distance")
    both = own.join(sweep(g).select("src", "v", F.col("distance").alias("other")), ["src", "v"], "full")
    off = F.abs(F.col("distance") - F.col("other")) > TOLERANCE * F.greatest(F.abs("distance"), F.abs("other"), F.lit(1.0))
    return both.where(off | F.col("distance").isNull() | F.col("other").isNull())


#: Largest graph that is replayed round by round.
REPLAY_MOST = 200


def replay(g: Graph) -> DataFrame:
    """(round, src, v, distance): entries that round k, ways through vertex k, lowers in a table of all pairs; round 0 is the start."""
    if g.n > REPLAY_MOST:
        raise OverBudget(f"a replay takes at most {REPLAY_MOST} vertices, not {g.n}")
    if g.local is None:
        raise OverBudget("a replay takes a graph that fits in one task")
    shared = g.local

    def rounds():
        a = shared.value
        d = np.full((a.n + 1, a.n + 1), np.inf)
        np.fill_diagonal(d, 0)
        np.minimum.at(d, (a.src, a.dst), a.weight)
        made = []
        for k in range(a.n + 1):
            via = d[:, k, None] + d[None, k, :] if k else d
            low = via < d if k else np.isfinite(d)
            low[0], low[:, 0] = False, False
            i, j = np.nonzero(low)
            made.append((np.full(len(i), k, np.int32), i, j, via[i, j]))
            d = np.minimum(d, via)
        return [np.concatenate(x) for x in zip(*made)]

    return kernels.once(g.edges.sparkSession, rounds, "round int, src long, v long, distance double")


def replay_order(tree_: DataFrame, rounds: DataFrame) -> DataFrame:
    """(v, place): a tree's vertices in the order in which a trace of lowerings (round, v, ...) settled them, parents before children."""
    last = rounds.groupBy("v").agg(F.max("round").alias("round"))
    depth = hop_depths(tree_)
    rows = depth.join(last, "v", "left").select("v", "depth", F.coalesce("round", F.lit(0)).alias("round"))
    return numbered(rows, ["round", "depth", "v"], "place").select("v", "place")


def hop_depths(tree_: DataFrame) -> DataFrame:
    """(v, depth): arcs between the root of a tree (v, parent) and v, by doubled pointers."""
    at = cut(tree_.select("v", F.col("parent").alias("to"), F.col("parent").isNotNull().cast("int").alias("depth")))
    while not at.where("to is not null").isEmpty():
        up = at.select(F.col("v").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        at = cut(at.join(up, "to", "left").select("v", F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return at.select("v", "depth")


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Pairs of different vertices, the longest distance, and the first pair that has it."""
    return pairs.where("src <> v").agg(F.count("*").alias("pairs"), F.max("distance").alias("longest"), F.max_by(F.struct("src", "v"), F.struct("distance", -F.col("src"), -F.col("v"))).alias("at")).select("pairs", "longest", F.col("at.src").alias("src"), F.col("at.v").alias("v"))


def lowerings(g: Graph, root: int, limit: int) -> DataFrame | None:
    """(round, v, estimate): what each round lowers; None if it goes beyond `limit` rows or has no end."""
    arcs, out, total, turn = _arcs(g), None, 0, 0
    best = _roots(g, [root]).select("v", "distance")
    now = best
    while turn <= g.n:
        turn += 1
        via = now.join(arcs, "v").groupBy(F.col("dst").alias("v")).agg(F.min(F.col("distance") + F.col("weight")).alias("distance"))
        now = cut(via.join(best.select("v", F.col("distance").alias("old")), "v", "left").where("old is null or distance < old").select("v", "distance"))
        n = now.count()
        total += n
        if not n:
            return out
        if total > limit:
            return None
        rows = now.select(F.lit(turn).alias("round"), "v", F.col("distance").alias("estimate"))
        out = rows if out is None else out.union(rows)
        best = cut(best.union(now).groupBy("v").agg(F.min("distance").alias("distance")))
    return None


def work(g: Graph, root: int, limit: int = 1 << 40) -> DataFrame:
    """(round, scanned, lowered): arcs that each round of relaxing scans, and vertices that it lowers; the last lowers none."""
    low = lowerings(g, root, limit)
    start = _roots(g, [root]).select(F.lit(0).alias("round"), "v")
    rows = cut(start if low is None else start.union(low.select("round", "v")))
    degree = g.arcs.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))
    scanned = rows.join(degree, "v", "left").groupBy((F.col("round") + 1).alias("round")).agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("scanned"))
    lowered = rows.where("round > 0").groupBy("round").agg(F.count("*").alias("lowered"))
    return scanned.join(lowered, "round", "left").select("round", "scanned", F.coalesce("lowered", F.lit(0)).alias("lowered"))


def dag_shortest_path(g: Graph, root: int) -> DataFrame:
    """Tree from a root of an acyclic graph, weights of any sign."""
    from arcwright.operators.strong import largest_size

    if not g.directed or (g.negative_loops is not None and not g.negative_loops.isEmpty()):
        raise NotAcyclic(largest_size(g))
    largest = largest_size(g)
    if largest > 1:
        raise NotAcyclic(largest)
    return bellman_ford(g, root)


def hops(g: Graph, vertices: list[int]) -> DataFrame:
    """(at, u, v, weight) of each step of a path; weight is null where there is no arc."""
    steps = g.edges.sparkSession.createDataFrame([(i, u, v) for i, (u, v) in enumerate(zip(vertices, vertices[1:]))], "at int, u long, v long")
    return steps.join(g.arcs.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight"), ["u", "v"], "left").select("at", "u", "v", "weight")


def path_length(g: Graph, vertices: list[int]) -> float:
    """Sum of weights along a path, in its order; an error if an arc is missing."""
    total = 0.0
    for r in hops(g, vertices).orderBy("at").collect():
        if r.weight is None:
            raise GraphError(f"no arc {r.u} {r.v}")
        total += r.weight
    return total

"""The largest finite distance in hops, by four methods."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from arcwright.model import Graph, GraphError, strategy
from arcwright.operators import components, stats
from arcwright.operators.traversal import bfs, levels_from
from arcwright.plans.loops import cut

#: Sources searched from at once.
BATCH = 4096


@dataclass(frozen=True)
class Diameter:
    value: int
    endpoints: tuple[int, int]
    method: str
    searches: int
    is_exact: bool
    cancelled: bool = False


def diameter(g: Graph, method: str = "ifub", deadline_s: float | None = None, progress: Callable[[int, int], bool | None] | None = None) -> Diameter:
    """Components are taken largest first and left out once they cannot beat the best.

    Between sets of searches, `progress` is told how many searches there were and the longest distance so far. Past the
    deadline, or where it returns False, what is known is a lower bound.
    """
    method = strategy("diameter", method)
    if g.directed and method in ("ifub", "bounds"):
        raise GraphError(f"{method} needs an undirected graph")
    best = [0, (1, 1), 0]
    last = None if deadline_s is None else time.monotonic() + deadline_s

    def late() -> bool:
        return (last is not None and time.monotonic() > last) or (progress is not None and progress(best[2], best[0]) is False)

    label = cut(components.labels(g))
    sizes = cut(label.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"))
    cancelled, seen = False, 0
    while True:
        # components of like size together: one set of searches for all of them
        top = sizes.where((F.col("size") - 1 > best[0]) & ((F.col("size") < seen) if seen else F.lit(True))).agg(F.max("size")).first()[0]
        if top is None:
            break
        low = max(best[0] + 2, (top + 1) // 2)
        group = sizes.where(F.col("size").between(low, top))
        seen = low
        inside = cut(label.join(group, "component").select("v", "component"))
        if not _METHODS[method](g, inside, best, late):
            cancelled = True
            break
    return Diameter(best[0], best[1], method, best[2], method != "sweep" and not cancelled, cancelled)


def _search(g: Graph, roots: DataFrame, best: list) -> DataFrame:
    """Levels from the roots; the best pair is updated."""
    found = cut(levels_from(g, roots))
    r = found.agg(F.max_by(F.struct("src", "v", "level"), F.struct("level", -F.col("src"), -F.col("v"))).alias("at"), F.count_distinct("src").alias("n")).first()
    best[2] += r.n
    if r.at and r.at.level > best[0]:
        best[0], best[1] = r.at.level, (r.at.src, r.at.v)
    return found


def _exact(g, inside, best, late) -> bool:
    n, parts = inside.count(), 1
    parts = max(1, -(-n // BATCH))
    for k in range(parts):
        if late():
            return False
        _search(g, inside.where(F.pmod(F.xxhash64("v"), F.lit(parts)) == k).select("v"), best)
    return True


def _hubs(g, inside) -> DataFrame:
    d = stats.degrees(g).join(inside, "v")
    return d.groupBy("component").agg(F.max_by("v", F.struct("degree", -F.col("v"))).alias("v"))


def _farthest(found, inside) -> DataFrame:
    return found.join(inside, "v").groupBy("component").agg(F.max_by("v", F.struct("level", -F.col("v"))).alias("v"))


def _sweep(g, inside, best, late) -> bool:
    """Four searches a component: from the hub, its farthest, a middle of that way, and its farthest."""
    start = _hubs(g, inside)
    for _ in range(2):
        if late():
            return False
        first = _farthest(_search(g, start.select("v"), best), inside)
        other = _search(g, first.select("v"), best)
        last = _farthest(other, inside)
        back = levels_from(g, last.select("v")).select("v", F.col("level").alias("lb"))
        on = other.select("v", F.col("level").alias("la")).join(back, "v").join(inside, "v")
        whole = on.groupBy("component").agg(F.min(F.col("la") + F.col("lb")).alias("d"))
        start = cut(on.join(whole, "component").where("la + lb = d").groupBy("component").agg(F.min_by("v", F.struct(F.abs(2 * F.col("la") - F.col("d")), F.col("v"))).alias("v")))
    _search(g, _farthest(_search(g, start.select("v"), best), inside).select("v"), best)
    return True


def _ifub(g, inside, best, late) -> bool:
    """From the hubs' outermost levels inwards; done with a level when twice the next cannot beat the best."""
    if not _sweep(g, inside, best, late):
        return False
    depth = cut(levels_from(g, _hubs(g, inside).select("v")).select("v", "level"))
    at = depth.agg(F.max("level")).first()[0] or 0
    while at > 0 and best[0] < 2 * at:
        if late():
            return False
        fringe = depth.where(F.col("level") == at)
        parts = max(1, -(-fringe.count() // BATCH))
        for k in range(parts):
            _search(g, fringe.where(F.pmod(F.xxhash64("v"), F.lit(parts)) == k).select("v"), best)
        at -= 1
    return True


def _bounds(g, inside, best, late) -> bool:
    """Eccentricities lie between max(d, ecc - d) and ecc + d; only those that may beat the best are searched from."""
    open_ = cut(inside.select("v", "component", F.lit(0).alias("low"), F.lit(1 << 30).alias("high")))
    degree = cut(stats.degrees(g).join(inside.select("v"), "v", "left_semi"))
    high = True
    while not open_.isEmpty():
        if late():
            return False
        key = F.struct(F.col("high") if high else -F.col("low"), F.col("degree"), -F.col("v"))
        pick = open_.join(degree, "v").groupBy("component").agg(F.max_by("v", key).alias("v")).select("v")
        high = not high
        found = _search(g, pick, best)
        ecc = found.groupBy("src").agg(F.max("level").alias("e"))
        near = found.join(ecc, "src").select("v", F.col("src"), F.greatest("level", F.col("e") - F.col("level")).alias("l"), (F.col("e") + F.col("level")).alias("h"))
        near = near.groupBy("v").agg(F.max("l").alias("l"), F.min("h").alias("h"), F.max((F.col("src") == F.col("v")).cast("int")).alias("own"))
        joined = open_.join(near, "v", "left")
        low, up = F.greatest("low", F.coalesce("l", F.lit(0))).alias("low"), F.least("high", F.coalesce("h", F.col("high"))).alias("high")
        open_ = cut(joined.where("own is null or own = 0").select("v", "component", low, up).where((F.col("high") > best[0]) & (F.col("low") < F.col("high"))))
    return True


_METHODS = {"exact": _exact, "sweep": _sweep, "ifub": _ifub, "bounds": _bounds}

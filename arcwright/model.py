"""Graphs as DataFrames: an edge table, the number of vertices, and a flag for direction."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, functions as F


class GraphError(ValueError):
    """What a question on a graph may be refused for."""


class ParseError(GraphError):
    def __init__(self, line: int, kind: str, detail: str = ""):
        super().__init__(f"line {line}: {kind}" + (f" ({detail})" if detail else ""))
        self.line, self.kind = line, kind


class NegativeWeight(GraphError):
    def __init__(self, u: int, v: int, weight: float):
        super().__init__(f"edge {u} {v} has negative weight {weight:g}; use bellman_ford")
        self.edge = (u, v, weight)


class NegativeCycle(GraphError):
    """cycle: vertices in arc order, from the smallest."""

    def __init__(self, cycle: list[int], weight: float):
        at = cycle.index(min(cycle))
        self.cycle, self.weight = cycle[at:] + cycle[:at], weight
        super().__init__(f"negative cycle {self.cycle} of weight {weight:g}")

    def arcs(self) -> list[tuple[int, int]]:
        return list(zip(self.cycle, self.cycle[1:] + self.cycle[:1]))

    def reversed(self) -> NegativeCycle:
        return NegativeCycle(self.cycle[::-1], self.weight)


class NotAcyclic(GraphError):
    def __init__(self, largest: int):
        super().__init__(f"the graph has cycles; its largest strong component has {largest} vertices")
        self.largest = largest


class RecursionLimit(GraphError):
    pass


class OverBudget(GraphError):
    pass


class Cancelled(GraphError):
    pass


#: Names of strategies: storages are tables of `representation`, schedules are ways through a round, diameters are methods; frontiers
#: and sweeps name one plan, since they never change a distance.
STRATEGIES = {
    "storage": {"list", "matrix", "csr"},
    "frontier": {"vector", "heap", "lazy-heap", "quad-heap", "pairing", "radix"},
    "schedule": {"rounds", "early-stop", "queue", "yen", "random-yen", "slf"},
    "sweep": {"plain", "pruned", "parallel", "blocked"},
    "diameter": {"exact", "ifub", "bounds", "sweep"},
}


#: Other spellings of the same names.
ALIASES = {"adjacency-list": "list", "adjacency-matrix": "matrix", "binary-heap": "heap", "binary": "heap", "lazy": "lazy-heap", "quad": "quad-heap", "4-ary": "quad-heap", "early": "early-stop", "fifo": "queue", "small-label-first": "slf", "brute-force": "exact", "four-sweep": "sweep", "tiles": "blocked"}


def strategy(axis: str, name: str) -> str:
    chosen = name.lower().replace("_", "-").replace(" ", "-")
    if chosen not in STRATEGIES[axis]:
        chosen = ALIASES.get(chosen, chosen)
    if chosen not in STRATEGIES[axis]:
        raise GraphError(f"unknown {axis} {name!r}: one of {', '.join(sorted(STRATEGIES[axis]))}")
    return chosen


@dataclass(frozen=True)
class Graph:
    """Vertices 1..n; edges (u, v, weight), normalised: no loops, one row a pair, u < v where undirected."""

    edges: DataFrame
    n: int
    directed: bool = False
    weighted: bool = False
    negative_loops: DataFrame | None = field(default=None, compare=False)

    @staticmethod
    def of(df: DataFrame, n: int, directed: bool = False) -> Graph:
        """From any table with u, v and perhaps weight."""
        from arcwright.operators import normalize

        weighted = "weight" in df.columns
        rows = normalize.oriented(normalize.with_weight(df), directed)
        return Graph(normalize.edges(rows), n, directed, weighted, normalize.negative_loops(rows) if weighted else None)

    @property
    def arcs(self) -> DataFrame:
        """(src, dst, weight): every direction in which an edge may be walked."""
        forth = self.edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight")
        return forth if self.directed else forth.unionByName(forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    @property
    def vertices(self) -> DataFrame:
        return self.edges.sparkSession.range(1, self.n + 1).withColumnRenamed("id", "v")

    @cached_property
    def edge_count(self) -> int:
        return self.edges.count()

    @cached_property
    def local(self):
        """The arcs as a broadcast for one task, where they are within its bounds; else None."""
        from arcwright.operators import kernels

        return kernels.local(self)

    def transpose(self) -> Graph:
        if not self.directed:
            return self
        return Graph(self.edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"), self.n, True, self.weighted, self.negative_loops)

    def neighbors(self, v: int) -> DataFrame:
        self.check(v)
        return self.arcs.where(F.col("src") == v).select(F.col("dst").alias("v"), "weight").orderBy("v")

    def has_edge(self, u: int, v: int) -> bool:
        return not self.arcs.where((F.col("src") == u) & (F.col("dst") == v)).isEmpty()

    def weight(self, u: int, v: int) -> float | None:
        r = self.arcs.where((F.col("src") == u) & (F.col("dst") == v)).first()
        return r.weight if r else None

    def check(self, v: int) -> int:
        if not 1 <= v <= self.n:
            raise GraphError(f"vertex {v} is outside 1..={self.n}")
        return v

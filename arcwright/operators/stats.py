"""Degrees, weights, and the one-row summary of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arcwright.model import Graph
from arcwright.operators import components


def degrees(g: Graph) -> DataFrame:
    """(v, degree) of all n vertices; out-degrees where directed."""
    return _counted(g, g.arcs.groupBy(F.col("src").alias("v")))


def in_degrees(g: Graph) -> DataFrame:
    return _counted(g, g.arcs.groupBy(F.col("dst").alias("v")))


def _counted(g: Graph, grouped) -> DataFrame:
    return g.vertices.join(grouped.agg(F.count("*").alias("degree")), "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_stats(g: Graph, incoming: bool = False) -> DataFrame:
    """min, max, mean and median over all vertices, from the histogram of degrees.

    Isolated vertices are counted, not made, so n may be large.
    """
    side = "dst" if incoming else "src"
    hist = g.arcs.groupBy(side).agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("c"))
    seen = {r.degree: r.c for r in hist.collect()}
    seen[0] = seen.get(0, 0) + g.n - sum(seen.values())
    order, total = [(d, c) for d, c in sorted(seen.items()) if c], 0

    def at(k: int) -> int:
        total = 0
        for d, c in order:
            total += c
            if k < total:
                return d
        return 0

    total = sum(d * c for d, c in order)
    row = (order[0][0], order[-1][0], total / g.n, (at((g.n - 1) // 2) + at(g.n // 2)) / 2)
    return g.edges.sparkSession.createDataFrame([row], "min_degree long, max_degree long, mean_degree double, median_degree double")


def weight_stats(g: Graph) -> DataFrame:
    return g.edges.agg(F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.avg("weight").alias("mean_weight"), F.count_if(F.col("weight") < 0).alias("negative"))


def hub(g: Graph) -> DataFrame:
    """The vertex of largest degree, of several the smallest."""
    return degrees(g).agg(F.max_by("v", F.struct("degree", -F.col("v"))).alias("v"), F.max("degree").alias("degree"))


def summary(g: Graph) -> DataFrame:
    """One row: vertices, edges, degrees, components."""
    sizes = components.component_sizes(g).agg(F.count("*").alias("components"), F.max("size").alias("largest"))
    counted = g.edges.agg(F.lit(g.n).cast("long").alias("vertices"), F.count("*").alias("edges"))
    return counted.crossJoin(degree_stats(g)).crossJoin(sizes)


def timing(samples: DataFrame, value: str = "value") -> DataFrame:
    """Mean, median, extremes, sample deviation and total of a column."""
    x = F.col(value).cast("double")
    return samples.agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.expr(f"percentile(cast({value} as double), 0.5)").alias("median"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stddev"),
        F.sum(x).alias("total"),
    )

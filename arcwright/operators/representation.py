"""What a graph is held in: tables of rows of lists, of bits, or of offsets and targets; their sizes, and budgets of memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arcwright.functions.text import representation_bytes
from arcwright.model import Graph, OverBudget, strategy
from arcwright.plans.order import numbered

KINDS = ("list", "matrix", "csr")
#: Memory of this machine, and no bound at all, as budgets.
MACHINE, UNLIMITED = "machine", "unlimited"


def machine_bytes() -> int:
    import os

    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")


def process_bytes() -> dict[str, int]:
    """Resident and peak bytes of this process, where the system tells them."""
    found = {}
    try:
        with open("/proc/self/status") as f:
            for line in f:
                name, _, rest = line.partition(":")
                if name in ("VmRSS", "VmHWM"):
                    found["resident" if name == "VmRSS" else "peak"] = int(rest.split()[0]) * 1024
    except OSError:
        pass
    return found


def check_budget(needed: int, budget: int | str | None) -> None:
    """Refuses what needs more bytes than a budget: a number, MACHINE, or UNLIMITED."""
    most = {MACHINE: machine_bytes, None: machine_bytes}.get(budget, lambda: budget)()
    if most != UNLIMITED and needed > most:
        raise OverBudget(f"{needed} bytes are needed, more than {most}")


def required_bytes(g: Graph, kind: str) -> int:
    return representation_bytes(strategy("storage", kind), g.n, g.edge_count, g.directed, g.weighted)


def report(g: Graph) -> DataFrame:
    """One row: bytes of each kind."""
    return g.edges.sparkSession.createDataFrame([[required_bytes(g, k) for k in KINDS]], ", ".join(f"{k} long" for k in KINDS))


def represent(g: Graph, kind: str, budget: int | str | None = None) -> DataFrame:
    """The table of a kind, chosen by name, within a budget."""
    check_budget(required_bytes(g, kind), budget)
    return {"list": adjacency_lists, "matrix": bit_rows, "csr": offsets}[strategy("storage", kind)](g)


def adjacency_lists(g: Graph) -> DataFrame:
    """(v, neighbours, weights): a row a vertex, neighbours in order; the row of a hub is as long as its degree."""
    rows = g.arcs.groupBy(F.col("src").alias("v")).agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("x"))
    none = F.array().cast("array<struct<dst:bigint,weight:double>>")
    return g.vertices.join(rows, "v", "left").withColumn("x", F.coalesce("x", none)).select("v", F.col("x.dst").alias("neighbours"), F.col("x.weight").alias("weights"))


def bit_rows(g: Graph) -> DataFrame:
    """(v, word, bits): words of 64 bits that are not zero; bit k of word w stands for vertex 64 w + k."""
    each = g.arcs.select(F.col("src").alias("v"), F.floor(F.col("dst") / 64).alias("word"), F.pmod("dst", F.lit(64)).cast("int").alias("k"))
    return each.groupBy("v", "word").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("bits"))


def has_bit(rows: DataFrame, u: int, v: int) -> bool:
    """Whether the arc u -> v is in `bit_rows`."""
    return not rows.where((F.col("v") == u) & (F.col("word") == v // 64) & (F.shiftright("bits", v % 64).bitwiseAND(F.lit(1)) == 1)).isEmpty()


def offsets(g: Graph) -> DataFrame:
    """(v, begin, end): places, from 0, of a vertex's arcs among `targets`."""
    from arcwright.operators.stats import degrees

    counted = numbered_sums(degrees(g))
    return counted.select("v", (F.col("through") - F.col("degree")).alias("begin"), F.col("through").alias("end"))


def targets(g: Graph) -> DataFrame:
    """(at, dst, weight): all arcs by (src, dst), numbered from 0."""
    return numbered(g.arcs, ["src", "dst"], "number").select((F.col("number") - 1).alias("at"), "dst", "weight")


def numbered_sums(degrees: DataFrame) -> DataFrame:
    """(v, degree, through): running sums by v. Ranges of RANGE vertices are summed apart, and their totals once more."""
    from pyspark.sql import Window

    d = degrees.withColumn("range", F.floor(F.col("v") / RANGE))
    totals = d.groupBy("range").agg(F.sum("degree").alias("t")).withColumn("up", F.floor(F.col("range") / RANGE))
    tops = totals.groupBy("up").agg(F.sum("t").alias("s"))
    before = lambda by, column, *part: F.coalesce(F.sum(column).over((Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the last level has a row for each RANGE ** 2 vertices
    tops = tops.select("up", before("up", "s").alias("b2"))
    totals = totals.join(tops, "up").select("range", (before("range", "t", "up") + F.col("b2")).alias("b1"))
    own = F.sum("degree").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return d.join(totals, "range").select("v", "degree", (own + F.col("b1")).alias("through"))


RANGE = 4096


def drawing_rows(g: Graph) -> DataFrame:
    """(v, begin, neighbours): each vertex's neighbours in either direction, once each and in order, and where they begin in one list of all."""
    both = g.edges.select("u", "v").union(g.edges.select("v", "u")).distinct()
    rows = both.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("neighbours"))
    every = g.vertices.join(rows.withColumnRenamed("u", "v"), "v", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>")))
    sums = numbered_sums(every.select("v", F.size("neighbours").cast("long").alias("degree")))
    return every.join(sums, "v").select("v", (F.col("through") - F.col("degree")).alias("begin"), "neighbours")

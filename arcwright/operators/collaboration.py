"""Co-authorship networks from papers, readable as of any year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from arcwright.model import Graph
from arcwright.plans.order import numbered


def coauthors(papers: DataFrame) -> DataFrame:
    """(paper_id, year, name): trimmed, distinct, not blank, of papers with two authors or more."""
    names = F.array_distinct(F.filter(F.transform("authors", lambda x: F.trim(x)), lambda x: x != ""))
    p = papers.select("paper_id", F.col("year").cast("short").alias("year"), names.alias("names")).where(F.size("names") >= 2)
    return p.select("paper_id", "year", F.explode("names").alias("name"))


def numbering(papers: DataFrame) -> DataFrame:
    """(vertex, name, first_year): by first year with a co-author, unknown last, then name."""
    first = coauthors(papers).groupBy("name").agg(F.min("year").alias("first_year"))
    return numbered(first, [F.asc_nulls_last("first_year"), F.col("name")], "vertex").select("vertex", "name", "first_year")


def terms(papers: DataFrame, numbers: DataFrame) -> DataFrame:
    """(u, v, year): one row for each pair of each paper, u < v. Pairs of one paper only are made."""
    ids = coauthors(papers).join(numbers.select("name", "vertex"), "name").groupBy("paper_id", "year").agg(F.array_sort(F.collect_list("vertex")).alias("a"))
    pairs = F.flatten(F.transform("a", lambda x, i: F.transform(F.slice("a", i + 2, F.size("a")), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    return ids.select("year", F.explode(pairs).alias("p")).select("p.u", "p.v", "year")


def until(rows: DataFrame, year: int | None, column: str = "year") -> DataFrame:
    """Rows known by a year; None keeps all, those of unknown year included."""
    return rows if year is None else rows.where(F.col(column) <= year)


def edges(terms_: DataFrame, year: int | None = None) -> DataFrame:
    """(u, v, weight): 1 / papers together."""
    return until(terms_, year).groupBy("u", "v").agg((F.lit(1.0) / F.count("*")).alias("weight"))


def strengths(terms_: DataFrame) -> DataFrame:
    return terms_.groupBy("u", "v", "year").agg(F.count("*").alias("papers"))


def network(terms_: DataFrame, n: int, year: int | None = None) -> Graph:
    return Graph(edges(terms_, year), n, False, True)


def years(terms_: DataFrame) -> DataFrame:
    return terms_.agg(F.min("year").alias("first"), F.max("year").alias("last"))


def counters(papers: DataFrame) -> DataFrame:
    """Papers and authors counted, and the largest paper."""
    c = coauthors(papers)
    return c.groupBy("paper_id").agg(F.count("*").alias("k")).agg(F.count("*").alias("papers"), F.max("k").alias("largest_paper")).crossJoin(c.agg(F.count_distinct("name").alias("authors")))


def vertex_count(numbers: DataFrame, year: int | None = None) -> int:
    """Vertices as of a year: numbers go by first year, so they are 1 .. this."""
    return until(numbers, year, "first_year").count()


def names(numbers: DataFrame, year: int | None = None) -> DataFrame:
    """(vertex, name) as of a year."""
    return until(numbers, year, "first_year").select("vertex", "name")


def name_of(numbers: DataFrame, vertex: int) -> str | None:
    r = numbers.where(F.col("vertex") == vertex).first()
    return r.name if r else None


def counts(terms_: DataFrame, numbers: DataFrame, year: int | None = None) -> DataFrame:
    """One row: vertices, edges, and papers' pairs as of a year."""
    n = until(numbers, year, "first_year").agg(F.count("*").alias("vertices"))
    t = until(terms_, year).groupBy("u", "v").agg(F.count("*").alias("c")).agg(F.count("*").alias("edges"), F.coalesce(F.sum("c"), F.lit(0)).alias("pairs"))
    return n.crossJoin(t)


def tiers(terms_: DataFrame, numbers: DataFrame) -> DataFrame:
    """(year, vertices, new_pairs, edges) of every calendar year of the span; edges and vertices so far.

    Unknown years count in the last one.
    """
    last = years(terms_).select("first", "last")
    span = last.select(F.explode(F.sequence("first", "last")).alias("year"))
    known = lambda df, c: df.crossJoin(F.broadcast(last)).select(F.coalesce(F.col(c), F.col("last")).alias("year"))
    pairs = terms_.groupBy("u", "v").agg(F.min("year").alias("y"))
    new_pairs = known(pairs, "y").groupBy("year").agg(F.count("*").alias("new_pairs"))
    new_names = known(numbers, "first_year").groupBy("year").agg(F.count("*").alias("new_names"))
    t = span.join(new_pairs, "year", "left").join(new_names, "year", "left").na.fill(0)
    so_far = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # a row a year
    return t.select(F.col("year").cast("int").alias("year"), F.sum("new_names").over(so_far).alias("vertices"), "new_pairs", F.sum("new_pairs").over(so_far).alias("edges"))


def rebuilt(strengths_: DataFrame, year: int | None = None) -> DataFrame:
    """(u, v, weight) from (u, v, year, papers)."""
    return until(strengths_, year).groupBy("u", "v").agg((F.lit(1.0) / F.sum("papers")).alias("weight"))


def built(strengths_: DataFrame, names_: DataFrame, year: int | None = None, compacted: bool = False) -> tuple[Graph, DataFrame]:
    """A network from strengths (u, v, year, papers) and names (vertex, name), and the names of its vertices.

    Compacted, vertices without an edge are left out and the others numbered anew, in order.
    """
    from arcwright.plans.loops import cut

    e = cut(rebuilt(strengths_, year))
    if not compacted:
        top = e.agg(F.max("v")).first()[0] or 0
        named = names_.agg(F.max("vertex")).first()[0] or 0
        return Graph(e, max(1, top, named), False, True), names_
    ids = cut(compact(e))
    new = lambda c: ids.select(F.col("old_id").alias(c), F.col("new_id").alias(f"n{c}"))
    e = e.join(new("u"), "u").join(new("v"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"), "weight")
    kept = names_.join(ids.withColumnRenamed("old_id", "vertex"), "vertex").select(F.col("new_id").alias("vertex"), "name")
    return Graph(e, max(1, ids.count()), False, True), kept


def compact(edges_: DataFrame) -> DataFrame:
    """(old_id, new_id) of the vertices that have an edge, in order."""
    ends = edges_.select(F.col("u").alias("old_id")).union(edges_.select("v")).distinct()
    return numbered(ends, ["old_id"], "new_id")

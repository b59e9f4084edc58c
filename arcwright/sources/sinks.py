"""Text sinks. Each makes (part, at, line) rows, in order, and writes them as one folder of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arcwright.functions.text import fifteen_digits, fixed, plain_double
from arcwright.model import Graph
from arcwright.plans.loops import cut
from arcwright.plans.order import numbered


def _head(spark, *rows: str) -> DataFrame:
    """Lines that come first."""
    return spark.createDataFrame([(0, i, r) for i, r in enumerate(rows)], "part int, at long, line string")


def edge_lines(g: Graph) -> DataFrame:
    weight = [plain_double(F.col("weight"))] if g.weighted else []
    body = g.edges.select(F.lit(1).alias("part"), (F.shiftleft("u", 32) + F.col("v")).alias("at"), F.concat_ws(" ", "u", "v", *weight).alias("line"))
    return _head(g.edges.sparkSession, str(g.n)).union(body)


def tree_lines(tree: DataFrame, g: Graph, root: int, toward: bool = False) -> DataFrame:
    """`vertex parent level` or `vertex parent distance`; 0 is the root's parent, `-` what is not reached."""
    value = "distance" if "distance" in tree.columns else "level"
    parent = "successor" if "successor" in tree.columns else "parent"
    shown = plain_double(F.col(value)) if value == "distance" else F.col(value).cast("string")
    all_ = g.vertices.join(tree, "v", "left")
    reached = F.col(value).isNotNull()
    body = all_.select(F.lit(1).alias("part"), F.col("v").alias("at"), F.concat_ws(" ", "v", F.when(reached, F.coalesce(F.col(parent), F.lit(0)).cast("string")).otherwise("-"), F.when(reached, shown).otherwise("-")).alias("line"))
    return _head(g.edges.sparkSession, f"# {'target' if toward else 'root'} {root}", f"# vertex {'successor' if toward else 'parent'} {value}").union(body)


#: Members that one piece of a component's line is made of.
PIECE = 50_000


def component_lines(labels: DataFrame, title: str = "components", column: str = "component") -> DataFrame:
    """`id size v...`, one line a component; a line is put together from pieces of PIECE members, which meet as text."""
    each = labels.select(F.col(column).alias("c"), "v")
    sizes = cut(each.groupBy("c").agg(F.count("*").alias("size")))
    ranked = numbered(each, ["c", "v"], "at")
    first = ranked.groupBy("c").agg(F.min("at").alias("first"))
    pieces = ranked.join(first, "c").groupBy("c", F.floor((F.col("at") - F.col("first")) / PIECE).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("v")), " ").alias("vs"))
    whole = pieces.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "vs"))), lambda x: x["vs"]), " ").alias("vs"))
    body = whole.join(sizes, "c").select(F.lit(1).alias("part"), F.col("c").alias("at"), F.concat_ws(" ", "c", "size", "vs").alias("line"))
    return _head(labels.sparkSession, f"{title} {sizes.count()}").union(body)


def strong_lines(g: Graph) -> DataFrame:
    """Strong components in topological order."""
    from arcwright.operators.strong import component_ids

    return component_lines(cut(component_ids(g)), "strong_components")


def summary_lines(g: Graph) -> DataFrame:
    """Keys and values of a graph, its negative loops, and the members of its components, largest first."""
    from arcwright.operators import components, stats

    spark, rows = g.edges.sparkSession, []

    def add(df: DataFrame, **columns) -> None:
        shown = df.select(*(x.cast("string").alias(k) for k, x in columns.items())).first().asDict()
        rows.extend(f"{k} {v}" for k, v in shown.items())

    def degrees(name: str, df: DataFrame) -> None:
        c = F.col
        add(df, **{f"{name}_min": c("min_degree"), f"{name}_max": c("max_degree"), f"{name}_mean": fixed(c("mean_degree"), 3), f"{name}_median": fixed(c("median_degree"), 1)})

    if g.directed:
        rows.append("directed")
    rows += [f"vertices {g.n}", f"{'arcs' if g.directed else 'edges'} {g.edge_count}"]
    degrees("out_degree" if g.directed else "degree", stats.degree_stats(g))
    if g.directed:
        degrees("in_degree", stats.degree_stats(g, incoming=True))
    if g.weighted and g.edge_count:
        w = stats.weight_stats(g)
        add(w, weight_min=plain_double(F.col("min_weight")), weight_max=plain_double(F.col("max_weight")), weight_mean=fixed(F.col("mean_weight"), 6), weight_negative=F.col("negative"))
    labels = cut(components.components(g))
    body = component_lines(labels, "")
    rows.append(f"{'weak_components' if g.directed else 'components'} {labels.select('component').distinct().count()}")
    out = _head(spark, *rows)
    if g.negative_loops is not None:
        loops = g.negative_loops.select(F.lit(1).alias("part"), F.col("v").alias("at"), F.concat_ws(" ", F.lit("# negative loop"), "v", plain_double(F.col("weight"))).alias("line"))
        out = out.union(loops)
    out = out.union(spark.createDataFrame([(2, 0, "# component size vertices...")], "part int, at long, line string"))
    return out.union(body.where("part = 1").select(F.lit(3).alias("part"), "at", "line"))


def all_pairs_tree_lines(g: Graph, pairs: DataFrame, root: int) -> DataFrame:
    """The tree of one source of a table of all pairs, with its predecessors."""
    from arcwright.operators.paths import predecessors

    own = cut(pairs.where(F.col("src") == root))
    return tree_lines(predecessors(g, own).select("v", "parent", "distance"), g, root)


def line_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first..last (from 1) of what would be written."""
    return numbered(lines, ["part", "at"], "number").where(F.col("number").between(first, last)).select("part", "at", "line")


#: Lines of one piece.
PIECE_LINES = 262_144


def write_pieces(lines: DataFrame, path: str, most: int = PIECE_LINES) -> None:
    """A folder of files of at most `most` lines each, in order of their names."""
    lines.orderBy("part", "at").select("line").write.option("maxRecordsPerFile", most).text(path)


def print_lines(lines: DataFrame, show=print) -> None:
    """Lines in order, one after another, without gathering them."""
    for r in lines.orderBy("part", "at").toLocalIterator():
        show(r.line)


def network_lines(edges: DataFrame, n: int) -> DataFrame:
    body = edges.select(F.lit(1).alias("part"), (F.shiftleft("u", 32) + F.col("v")).alias("at"), F.concat_ws(" ", "u", "v", fifteen_digits(F.col("weight"))).alias("line"))
    return _head(edges.sparkSession, str(n)).union(body)


def name_lines(names: DataFrame) -> DataFrame:
    return names.select(F.lit(1).alias("part"), F.col("vertex").alias("at"), F.concat_ws(",", "vertex", "name").alias("line"))


def write(lines: DataFrame, path: str, gzip: bool = False, one_file: bool = False) -> None:
    """Files in order of their names hold the lines in order."""
    ordered = lines.orderBy("part", "at").select("line")
    (ordered.coalesce(1) if one_file else ordered).write.option("compression", "gzip" if gzip else "none").text(path)


def by_year(strengths: DataFrame, path: str) -> None:
    """(u, v, year, papers) as one folder a year; unknown years with the last."""
    last = strengths.agg(F.max("year").alias("last"))
    rows = strengths.crossJoin(F.broadcast(last)).select(F.coalesce("year", "last").alias("year"), F.concat_ws(" ", "u", "v", "papers").alias("value"))
    rows.repartition("year", F.pmod(F.xxhash64("value"), F.lit(8))).sortWithinPartitions("year", "value").write.partitionBy("year").text(path)


def site(terms: DataFrame, numbers: DataFrame, path: str) -> DataFrame:
    """A folder that holds a network by year: strengths, names, and a manifest with one JSON object a year, which is returned.

    Years are those of the calendar between the first and the last; unknown years count in the last.
    """
    from arcwright.operators import collaboration as co

    strengths = cut(co.strengths(terms))
    last = co.years(terms).first()["last"]
    by_year(strengths, f"{path}/strengths")
    names = numbers.select(F.coalesce("first_year", F.lit(last).cast("short")).alias("year"), F.concat_ws(",", "vertex", "name").alias("value"), "vertex")
    names.repartition("year", F.pmod("vertex", F.lit(8))).sortWithinPartitions("year", "vertex").select("year", "value").write.partitionBy("year").text(f"{path}/names")
    size = lambda df, name: df.groupBy("year").agg(F.sum(F.octet_length("value") + 1).alias(name))
    shown = strengths.select(F.coalesce("year", F.lit(last).cast("short")).cast("int").alias("year"), F.concat_ws(" ", "u", "v", "papers").alias("value"))
    tiers = co.tiers(terms, numbers).join(size(shown, "strengths_bytes"), "year", "left").join(size(names.withColumn("year", F.col("year").cast("int")), "names_bytes"), "year", "left").na.fill(0)
    tiers = cut(tiers)
    tiers.orderBy("year").write.json(f"{path}/manifest")
    return tiers


def up_to(manifest: DataFrame, year: int) -> DataFrame:
    """One row: the years of a manifest that a reader as of a year needs, and their bytes."""
    return manifest.where(F.col("year") <= year).agg(F.array_sort(F.collect_list("year")).alias("years"), F.sum(F.col("strengths_bytes") + F.col("names_bytes")).alias("bytes"))


def measured_bytes(lines: DataFrame) -> int:
    """Size of the text, exactly."""
    return lines.agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0

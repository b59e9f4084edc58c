"""Queries of the graph engine over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwright import fixtures as fx
from arcwright.functions.text import digits, fold, representation_bytes
from arcwright.model import Graph
from arcwright.operators import collaboration as co, components as cc, diameter as dm, normalize as nz, paths as ps, representation as rp, stats as st, strong as sc, subgraph as sg, traversal as tr
from arcwright.plans.loops import cut
from arcwright.sources import sinks, text

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_N = "(SELECT count(*) FROM part)"
_C45, _C48, _S40, _S45 = fx.copart(45), fx.copart(48), fx.succ(40), fx.succ(45)
#: arcs (s, t, w) of each graph
_C00 = fx.copart(0)
_ARCS = {
    "copart00": f"{_C00}, arcs AS (SELECT u AS s, v AS t, 1.0 / papers AS w FROM copart UNION ALL SELECT v, u, 1.0 / papers FROM copart)",
    "copart00_int": f"{_C00}, e AS ({fx.COPART_INT}), arcs AS (SELECT u AS s, v AS t, weight AS w FROM e UNION ALL SELECT v, u, weight FROM e)",
    "copart45": f"{_C45}, arcs AS (SELECT u AS s, v AS t, 1.0 / papers AS w FROM copart UNION ALL SELECT v, u, 1.0 / papers FROM copart)",
    "copart48": f"{_C48}, arcs AS (SELECT u AS s, v AS t, 1.0 AS w FROM copart UNION ALL SELECT v, u, 1.0 FROM copart)",
    "copart45_int": f"{_C45}, e AS ({fx.COPART_INT}), arcs AS (SELECT u AS s, v AS t, weight AS w FROM e UNION ALL SELECT v, u, weight FROM e)",
    "succ40_int": f"{_S40}, arcs AS (SELECT u AS s, v AS t, weight AS w FROM ({fx.SUCC_INT}))",
    "succ40": f"{_S40}, arcs AS (SELECT u AS s, v AS t, 1.0 AS w FROM succ)",
    "succ45": f"{_S45}, arcs AS (SELECT u AS s, v AS t, 1.0 AS w FROM succ)",
}
_DEG = f"deg AS (SELECT p_partkey + 1 AS v, coalesce(c, 0) AS degree FROM part LEFT JOIN (SELECT s, count(*) AS c FROM arcs GROUP BY s) ON s = p_partkey + 1)"
_HUB = "root AS (SELECT s AS r FROM arcs GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)"
_BFS = "d(v, dist) USING KEY (v) AS (SELECT r AS v, CAST(0 AS DOUBLE) AS dist FROM root UNION (SELECT arcs.t AS v, min(d.dist + 1) AS dist FROM d JOIN arcs ON arcs.s = d.v LEFT JOIN recurring.d AS o ON o.v = arcs.t WHERE o.dist IS NULL OR d.dist + 1 < o.dist GROUP BY arcs.t))"
_SSSP = _BFS.replace("d.dist + 1", "d.dist + arcs.w")
_LABEL = "c(v, k) USING KEY (v) AS (SELECT p_partkey + 1 AS v, p_partkey + 1 AS k FROM part UNION (SELECT both_.t AS v, min(c.k) AS k FROM c JOIN both_ ON both_.s = c.v JOIN recurring.c AS o ON o.v = both_.t WHERE c.k < o.k GROUP BY both_.t))"
_BOTH = "both_ AS (SELECT s, t FROM arcs UNION ALL SELECT t, s FROM arcs)"


def _hub(g: Graph) -> int:
    return st.hub(g).first().v


def _raw(spark, sf_dir, directed: bool) -> DataFrame:
    return nz.oriented(nz.with_weight(fx.rows(spark, sf_dir, fx.NEXT, "SELECT u, v, weight FROM raw")), directed)


# --- normalising ---------------------------------------------------------------------------

_UND = f"{fx.NEXT}, ori AS (SELECT least(u, v) AS u, greatest(u, v) AS v, weight FROM raw)"


@_add(f"WITH {_UND} SELECT u, v, min(weight) AS weight FROM ori WHERE u <> v GROUP BY u, v")
def normalize_edges(spark, sf_dir):
    return nz.edges(_raw(spark, sf_dir, False))


@_add(f"WITH {fx.NEXT} SELECT v AS u, u AS v, min(weight) AS weight FROM raw WHERE u <> v GROUP BY u, v")
def transpose_arcs(spark, sf_dir):
    return Graph(nz.edges(_raw(spark, sf_dir, True)), 1, True, True).transpose().edges


@_add(f"WITH {_UND} SELECT count(*) FILTER (WHERE u = v) AS self_loops, count(*) FILTER (WHERE u <> v) - (SELECT count(*) FROM (SELECT DISTINCT u, v FROM ori WHERE u <> v)) AS duplicates FROM ori")
def dropped_counts(spark, sf_dir):
    return nz.dropped(_raw(spark, sf_dir, False))


@_add(f"WITH {fx.NEXT} SELECT v, min(weight) AS weight FROM raw WHERE u = v AND weight < 0 GROUP BY v")
def negative_loops(spark, sf_dir):
    return nz.negative_loops(_raw(spark, sf_dir, True))


@_add(f"WITH {fx.NEXT} SELECT u, v, min(weight) AS weight FROM raw WHERE u <> v AND weight < 0 GROUP BY u, v ORDER BY u, v LIMIT 1")
def first_negative_edge(spark, sf_dir):
    return nz.first_negative(nz.edges(_raw(spark, sf_dir, True)))


@_add(f"WITH {_S40} SELECT u, v, CAST(1 AS DOUBLE) AS weight FROM succ")
def unit_weights(spark, sf_dir):
    return fx.graph(spark, sf_dir, "succ40").edges


# --- degrees and weights -------------------------------------------------------------------


@_add(f"WITH {_ARCS['copart45']}, {_DEG} SELECT v, degree FROM deg")
def degree(spark, sf_dir):
    return st.degrees(fx.graph(spark, sf_dir, "copart45"))


@_add(f"WITH {_S40}, arcs AS (SELECT v AS s FROM succ), {_DEG} SELECT v, degree FROM deg")
def in_degree(spark, sf_dir):
    return st.in_degrees(fx.graph(spark, sf_dir, "succ40"))


_DSTATS = "min(degree) AS min_degree, max(degree) AS max_degree, avg(degree) AS mean_degree, median(degree) AS median_degree"


@_add(f"WITH {_ARCS['copart45']}, {_DEG} SELECT {_DSTATS} FROM deg")
def degree_stats(spark, sf_dir):
    return st.degree_stats(fx.graph(spark, sf_dir, "copart45"))


@_add(f"WITH {_S40}, arcs AS (SELECT v AS s FROM succ), {_DEG} SELECT {_DSTATS} FROM deg")
def in_degree_stats(spark, sf_dir):
    return st.degree_stats(fx.graph(spark, sf_dir, "succ40"), incoming=True)


@_add(f"WITH {_ARCS['succ40_int']} SELECT min(w) AS min_weight, max(w) AS max_weight, avg(w) AS mean_weight, count(*) FILTER (WHERE w < 0) AS negative FROM arcs")
def weight_stats(spark, sf_dir):
    return st.weight_stats(fx.graph(spark, sf_dir, "succ40_int"))


@_add(f"WITH {_ARCS['copart45']}, {_DEG} SELECT v, degree FROM deg ORDER BY degree DESC, v LIMIT 1")
def hub_vertex(spark, sf_dir):
    return st.hub(fx.graph(spark, sf_dir, "copart45"))


@_add(f"WITH RECURSIVE {_ARCS['copart45']}, {_DEG}, {_BOTH}, {_LABEL}, z AS (SELECT k, count(*) AS size FROM c GROUP BY k) SELECT {_N} AS vertices, (SELECT count(*) FROM copart) AS edges, {_DSTATS}, (SELECT count(*) FROM z) AS components, (SELECT max(size) FROM z) AS largest FROM deg")
def summary_row(spark, sf_dir):
    return st.summary(fx.graph(spark, sf_dir, "copart45"))


@_add("SELECT count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS stddev, round(sum(value), 4) AS total FROM (SELECT CAST(value AS DOUBLE) AS value FROM events)")
def timing_summary(spark, sf_dir):
    t = st.timing(fx.table(spark, sf_dir, "events"))
    return t.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "median")), "min", "max", F.round("stddev", 6).alias("stddev"), F.round("total", 4).alias("total"))


# --- cuts ----------------------------------------------------------------------------------


@_add(f"WITH {_ARCS['copart45']}, {_DEG} SELECT v AS old_id, row_number() OVER (ORDER BY degree DESC, v) AS new_id FROM deg ORDER BY degree DESC, v LIMIT 50")
def top_k_degree(spark, sf_dir):
    return sg.select(fx.graph(spark, sf_dir, "copart45"), "most-connected", 1, 50)


@_add("SELECT p_partkey + 1 AS old_id, p_partkey + 1 AS new_id FROM part WHERE p_partkey < 100")
def earliest_k(spark, sf_dir):
    return sg.select(fx.graph(spark, sf_dir, "copart45"), "earliest", 1, 100)


@_add(f"WITH {_ARCS['copart45']}, {_DEG}, k AS (SELECT v, row_number() OVER (ORDER BY degree DESC, v) AS i FROM deg ORDER BY degree DESC, v LIMIT 50) SELECT least(a.i, b.i) AS u, greatest(a.i, b.i) AS v, 1.0 / papers AS weight FROM copart c JOIN k a ON a.v = c.u JOIN k b ON b.v = c.v")
def induced_topk(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45")
    return sg.induce(g, sg.select(g, "most-connected", 1, 50))


@_add(f"WITH RECURSIVE {_ARCS['copart45']}, {_HUB}, {_BFS} SELECT a.u, a.v FROM copart a JOIN d x ON x.v = a.u JOIN d y ON y.v = a.v WHERE x.dist <= 2 AND y.dist <= 2")
def egonet_2(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45")
    kept, edges = sg.egonet(g, _hub(g), 2)
    old = lambda c: kept.select(F.col("new_id").alias(c), F.col("old_id").alias(f"o{c}"))
    e = edges.join(old("u"), "u").join(old("v"), "v")
    return e.select(F.least("ou", "ov").alias("u"), F.greatest("ou", "ov").alias("v"))


# --- papers --------------------------------------------------------------------------------


def _papers(spark, sf_dir, select: str = fx.PAPERS) -> DataFrame:
    p = fx.rows(spark, sf_dir, "", select)
    undated = F.when(F.col("paper_id") % 50 != 0, F.col("year"))
    return p.groupBy("paper_id", undated.cast("short").alias("year")).agg(F.collect_list(F.format_string("part %d", "author")).alias("authors"))


def _network(spark, sf_dir):
    papers = cut(_papers(spark, sf_dir))
    numbers = cut(co.numbering(papers))
    return papers, numbers, cut(co.terms(papers, numbers))


_PAPER = f"""pp AS ({fx.PAPERS}), px AS (SELECT DISTINCT paper_id, concat('part ', author) AS name, CASE WHEN paper_id % 50 <> 0 THEN year END AS year FROM pp),
    ca AS (SELECT * FROM px WHERE paper_id IN (SELECT paper_id FROM px GROUP BY paper_id HAVING count(*) >= 2)),
    num AS (SELECT name, min(year) AS first_year, row_number() OVER (ORDER BY min(year) NULLS LAST, name) AS vertex FROM ca GROUP BY name),
    ci AS (SELECT paper_id, year, vertex FROM ca JOIN num USING (name)),
    term AS (SELECT a.vertex AS u, b.vertex AS v, a.year FROM ci a JOIN ci b ON a.paper_id = b.paper_id AND a.vertex < b.vertex)"""


@_add(f"WITH {_PAPER} SELECT vertex, name, CAST(first_year AS INTEGER) AS first_year FROM num")
def network_numbering(spark, sf_dir):
    return _network(spark, sf_dir)[1].withColumn("first_year", F.col("first_year").cast("int"))


@_add(f"WITH {_PAPER} SELECT u, v, CAST(1 AS DOUBLE) / count(*) AS weight FROM term GROUP BY u, v")
def network_edges(spark, sf_dir):
    return co.edges(_network(spark, sf_dir)[2])


@_add(f"WITH {_PAPER} SELECT u, v, CAST(1 AS DOUBLE) / count(*) AS weight FROM term WHERE year <= 1998 GROUP BY u, v")
def network_edges_until_1998(spark, sf_dir):
    return co.edges(_network(spark, sf_dir)[2], 1998)


@_add(f"WITH {_PAPER} SELECT u, v, CAST(year AS INTEGER) AS year, count(*) AS papers FROM term GROUP BY u, v, year")
def network_strengths(spark, sf_dir):
    return co.strengths(_network(spark, sf_dir)[2]).withColumn("year", F.col("year").cast("int"))


@_add(f"WITH {_PAPER} SELECT CAST(min(year) AS INTEGER) AS first, CAST(max(year) AS INTEGER) AS last FROM term")
def network_years(spark, sf_dir):
    return co.years(_network(spark, sf_dir)[2]).select(F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


@_add(f"WITH {_PAPER} SELECT (SELECT count(DISTINCT paper_id) FROM ca) AS papers, (SELECT max(k) FROM (SELECT count(*) AS k FROM ca GROUP BY paper_id)) AS largest_paper, (SELECT count(*) FROM num) AS authors")
def network_counters(spark, sf_dir):
    return co.counters(_papers(spark, sf_dir))


@_add(f"""WITH {_PAPER}, lim AS (SELECT min(year) AS a, max(year) AS b FROM term), ys AS (SELECT DISTINCT coalesce(year, (SELECT b FROM lim)) AS year FROM term),
    fy AS (SELECT coalesce(min(year), (SELECT b FROM lim)) AS year FROM term GROUP BY u, v), ny AS (SELECT coalesce(first_year, (SELECT b FROM lim)) AS year FROM num)
    SELECT CAST(year AS INTEGER) AS year, (SELECT count(*) FROM ny WHERE ny.year <= ys.year) AS vertices, (SELECT count(*) FROM fy WHERE fy.year = ys.year) AS new_pairs, (SELECT count(*) FROM fy WHERE fy.year <= ys.year) AS edges FROM ys""")
def network_tiers_by_year(spark, sf_dir):
    _, numbers, terms = _network(spark, sf_dir)
    return co.tiers(terms, numbers)


@_add(f"WITH {_PAPER} SELECT u, v, CAST(1 AS DOUBLE) / count(*) AS weight FROM term WHERE year <= 1999 GROUP BY u, v")
def network_rebuild_from_strengths(spark, sf_dir):
    return co.rebuilt(co.strengths(_network(spark, sf_dir)[2]), 1999)


@_add(f"WITH {_PAPER}, x AS (SELECT u AS old_id FROM term WHERE year <= 1995 UNION SELECT v FROM term WHERE year <= 1995) SELECT old_id, row_number() OVER (ORDER BY old_id) AS new_id FROM x")
def network_compact_span(spark, sf_dir):
    return co.compact(co.edges(_network(spark, sf_dir)[2], 1995))


# --- names ---------------------------------------------------------------------------------


def _names(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("vertex"), F.col("p_name").alias("name"))


@_add("SELECT p_name AS name, min(p_partkey + 1) AS vertex FROM part GROUP BY p_name")
def name_lookup(spark, sf_dir):
    return _names(spark, sf_dir).groupBy("name").agg(F.min("vertex").alias("vertex"))


@_add("SELECT p_partkey + 1 AS vertex, p_name AS name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 'e') ORDER BY p_name, vertex LIMIT 20")
def name_search(spark, sf_dir):
    from arcwright.sources.text import search_names

    return search_names(_names(spark, sf_dir), "É a", 20)


@_add("SELECT p_partkey + 1 AS vertex, lower(p_name) AS folded, CAST(length(CAST(p_partkey + 1 AS VARCHAR)) AS INTEGER) AS digits FROM part")
def name_fold(spark, sf_dir):
    return _names(spark, sf_dir).select("vertex", fold(F.col("name")).alias("folded"), digits(F.col("vertex")).alias("digits"))


@_add(f"WITH {_C45}, x AS (SELECT {_N} AS n, 2 * count(*) AS e FROM copart) SELECT 48 * (n + 1) + 12 * e AS list, (n + 1) * ((n + 64) // 64) * 8 + 4 * (n + 1) + 8 * (n + 1) * (n + 1) AS matrix, 4 * (n + 2) + 12 * e AS csr FROM x")
def representation_sizes(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45")
    row = [representation_bytes(k, g.n, g.edge_count, False, True) for k in ("list", "matrix", "csr")]
    return spark.createDataFrame([row], "list long, matrix long, csr long")


# --- searches ------------------------------------------------------------------------------


def _roots(g: Graph, v: int) -> DataFrame:
    return g.edges.sparkSession.createDataFrame([(v,)], "v long")


@_add(f"WITH RECURSIVE {_ARCS['copart45']}, {_HUB}, {_BFS} SELECT v, CAST(dist AS INTEGER) AS level FROM d")
def bfs_levels(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45")
    return tr.levels_from(g, _roots(g, _hub(g))).select("v", "level")


#: Discovery level by level: a vertex hangs from the neighbour discovered first, and a level goes by (rank of the parent, id).
_TREE = """b(v, parent, level, rank) USING KEY (v) AS (SELECT r AS v, CAST(NULL AS BIGINT) AS parent, 0 AS level, CAST(1 AS BIGINT) AS rank FROM root UNION
    (SELECT v, parent, level, (SELECT count(*) FROM recurring.b) + row_number() OVER (ORDER BY pr, v) AS rank FROM
        (SELECT arcs.t AS v, arg_min(b.v, b.rank) AS parent, min(b.level) + 1 AS level, min(b.rank) AS pr FROM b JOIN arcs ON arcs.s = b.v LEFT JOIN recurring.b AS o ON o.v = arcs.t WHERE o.v IS NULL GROUP BY arcs.t)))"""


@_add(f"WITH RECURSIVE {_ARCS['copart45']}, {_HUB}, {_TREE} SELECT v, parent, level, rank FROM b")
def bfs_tree(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45")
    return tr.bfs(g, _hub(g))


@_add(f"WITH RECURSIVE {_ARCS['copart45']}, {_HUB}, {_BFS} SELECT CAST(dist AS INTEGER) AS level, count(*) AS size FROM d GROUP BY dist")
def bfs_level_sizes(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45")
    return tr.level_sizes(tr.levels_from(g, _roots(g, _hub(g))))


@_add(f"WITH RECURSIVE {_ARCS['succ40']}, {_HUB}, {_BFS} SELECT v, CAST(dist AS INTEGER) AS level FROM d")
def bfs_levels_directed(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "succ40")
    return tr.levels_from(g, _roots(g, _hub(g))).select("v", "level")


@_add()
def dfs_tree(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45")
    return tr.dfs(g, _hub(g))


_MULTI = "m(s, v, dist) USING KEY (s, v) AS (SELECT DISTINCT s, s AS v, CAST(0 AS DOUBLE) AS dist FROM arcs UNION (SELECT m.s AS s, arcs.t AS v, min(m.dist + arcs.w) AS dist FROM m JOIN arcs ON arcs.s = m.v LEFT JOIN recurring.m AS o ON o.s = m.s AND o.v = arcs.t WHERE o.dist IS NULL OR m.dist + arcs.w < o.dist GROUP BY m.s, arcs.t))"


@_add(f"WITH RECURSIVE {_ARCS['copart48']}, {_MULTI} SELECT s AS v, CAST(max(dist) AS INTEGER) AS eccentricity FROM m GROUP BY s")
def eccentricities(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart48")
    return tr.eccentricities(g, g.arcs.select(F.col("src").alias("v")).distinct())


@_add(f"WITH RECURSIVE {_ARCS['copart48']}, {_MULTI} SELECT s AS src, v, CAST(dist AS INTEGER) AS level FROM m")
def hop_distance_pairs(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart48")
    return tr.levels_from(g, g.arcs.select(F.col("src").alias("v")).distinct())


# --- components ----------------------------------------------------------------------------


@_add(f"WITH RECURSIVE {_ARCS['copart45']}, {_BOTH}, {_LABEL}, z AS (SELECT k, row_number() OVER (ORDER BY count(*) DESC, k) AS i FROM c GROUP BY k) SELECT c.v, z.i AS component FROM c JOIN z ON z.k = c.k")
def components(spark, sf_dir):
    return cc.components(fx.graph(spark, sf_dir, "copart45"))


@_add(f"WITH RECURSIVE {_ARCS['copart45']}, {_BOTH}, {_LABEL} SELECT k AS component, count(*) AS size FROM c GROUP BY k")
def component_sizes(spark, sf_dir):
    return cc.component_sizes(fx.graph(spark, sf_dir, "copart45"))


@_add(f"WITH RECURSIVE {_ARCS['succ45']}, {_BOTH}, {_LABEL} SELECT v, k AS component FROM c")
def weak_components(spark, sf_dir):
    return cc.labels(fx.graph(spark, sf_dir, "succ45"))


_SCC = "f AS (SELECT a.s AS v, min(a.v) AS scc FROM m a JOIN m b ON a.s = b.v AND a.v = b.s GROUP BY a.s), scc AS (SELECT p_partkey + 1 AS v, coalesce(scc, p_partkey + 1) AS scc FROM part LEFT JOIN f ON f.v = p_partkey + 1)"


@_add(f"WITH RECURSIVE {_ARCS['succ40']}, {_MULTI}, {_SCC} SELECT v, scc FROM scc")
def scc_partition(spark, sf_dir):
    return sc.strong_components(fx.graph(spark, sf_dir, "succ40"))


@_add(f"WITH RECURSIVE {_ARCS['succ45']}, {_MULTI}, {_SCC} SELECT scc, count(*) AS size FROM scc GROUP BY scc")
def scc_sizes(spark, sf_dir):
    return sc.strong_components(fx.graph(spark, sf_dir, "succ45")).groupBy("scc").agg(F.count("*").alias("size"))


@_add(f"WITH RECURSIVE {_ARCS['succ40']}, {_MULTI}, {_SCC} SELECT DISTINCT x.scc AS u, y.scc AS v FROM arcs JOIN scc x ON x.v = arcs.s JOIN scc y ON y.v = arcs.t WHERE x.scc <> y.scc")
def condensation_arcs(spark, sf_dir):
    return sc.condensation(fx.graph(spark, sf_dir, "succ40"))


def _dag(spark, sf_dir, kind: str) -> Graph:
    """The arcs from smaller to larger vertices, which have no cycle."""
    g = fx.graph(spark, sf_dir, kind)
    return Graph(g.edges.where("u < v"), g.n, True, g.weighted)


_DAG = _ARCS["succ40_int"].replace("arcs AS (SELECT", "arcs AS (SELECT").removesuffix(")") + " WHERE u < v)"


_LAYERS = "l(v, layer) USING KEY (v) AS (SELECT p_partkey + 1 AS v, 0 AS layer FROM part UNION (SELECT arcs.t AS v, max(l.layer) + 1 AS layer FROM l JOIN arcs ON arcs.s = l.v JOIN recurring.l AS o ON o.v = arcs.t WHERE l.layer + 1 > o.layer GROUP BY arcs.t))"


@_add(f"WITH RECURSIVE {_ARCS['succ45'].replace('FROM succ)', 'FROM succ WHERE u < v)')}, {_LAYERS} SELECT v, row_number() OVER (ORDER BY layer, v) AS place FROM l")
def topological_order(spark, sf_dir):
    return sc.topological_order(_dag(spark, sf_dir, "succ45"))


@_add(f"WITH RECURSIVE {_DAG}, {_HUB}, {_SSSP} SELECT v, dist AS distance FROM d")
def dag_distances(spark, sf_dir):
    g = _dag(spark, sf_dir, "succ40_int")
    return ps.dag_shortest_path(g, _hub(g)).select("v", "distance")


# --- weighted paths ------------------------------------------------------------------------


@_add(f"WITH RECURSIVE {_ARCS['copart45_int']}, {_HUB}, {_SSSP} SELECT v, dist AS distance FROM d")
def sssp(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45_int")
    return ps.distances(g, [_hub(g)]).select("v", "distance")


@_add(f"""WITH RECURSIVE {_ARCS['copart45_int']}, {_HUB}, {_SSSP}, k AS (SELECT v, dist, row_number() OVER (ORDER BY dist, v) AS rank FROM d),
    p AS (SELECT b.v, arg_min(a.v, a.rank) AS parent FROM k a JOIN arcs ON arcs.s = a.v JOIN k b ON b.v = arcs.t AND a.dist + arcs.w = b.dist GROUP BY b.v)
    SELECT k.v, p.parent, k.dist AS distance, k.rank FROM k LEFT JOIN p ON p.v = k.v""")
def sssp_tree(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45_int")
    return ps.dijkstra(g, _hub(g))


@_add(f"WITH RECURSIVE {_ARCS['succ40_int']}, {_HUB}, {_SSSP} SELECT v, dist AS distance FROM d")
def bellman_ford_distances(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "succ40_int")
    return ps.distances(g, [_hub(g)]).select("v", "distance")


@_add(f"WITH RECURSIVE {_ARCS['succ40_int'].replace('u AS s, v AS t', 'v AS s, u AS t')}, root AS (SELECT t AS r FROM arcs GROUP BY t ORDER BY count(*) DESC, t LIMIT 1), {_SSSP} SELECT v, dist AS distance FROM d")
def distances_to_target(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "succ40_int")
    return ps.distances(g.transpose(), [_hub(g)]).select("v", "distance")


@_add(f"WITH RECURSIVE {_ARCS['succ40_int']}, h(v, dist) USING KEY (v) AS (SELECT p_partkey + 1 AS v, CAST(0 AS DOUBLE) AS dist FROM part UNION (SELECT arcs.t AS v, min(h.dist + arcs.w) AS dist FROM h JOIN arcs ON arcs.s = h.v JOIN recurring.h AS o ON o.v = arcs.t WHERE h.dist + arcs.w < o.dist GROUP BY arcs.t)) SELECT v, dist AS h FROM h")
def potentials(spark, sf_dir):
    return ps.potentials(fx.graph(spark, sf_dir, "succ40_int"))


@_add(f"WITH {_ARCS['succ40_int']} SELECT s AS u, t AS v, w AS weight FROM arcs WHERE w < 0 ORDER BY s, t LIMIT 1")
def negative_edge_refusal(spark, sf_dir):
    from arcwright.model import NegativeWeight

    g = fx.graph(spark, sf_dir, "succ40_int")
    try:
        ps.dijkstra(g, 1)
    except NegativeWeight as e:
        return spark.createDataFrame([e.edge], "u long, v long, weight double")
    return spark.createDataFrame([], "u long, v long, weight double")


#: Of the walks of three arcs that come back, the lightest through the three new vertices.
_PLANTED = f"{_S40}, e AS ({fx.SUCC_INT} UNION ALL SELECT n + 1, n + 2, 2.0 FROM (SELECT {_N} AS n) UNION ALL SELECT n + 2, n + 3, -4.0 FROM (SELECT {_N} AS n) UNION ALL SELECT n + 3, n + 1, 1.0 FROM (SELECT {_N} AS n))"


@_add(f"WITH {_PLANTED} SELECT min(x.weight + y.weight + z.weight) AS weight, CAST(3 AS INTEGER) AS arcs FROM e x JOIN e y ON y.u = x.v JOIN e z ON z.u = y.v AND z.v = x.u WHERE x.u > {_N}")
def negative_cycle_exists(spark, sf_dir):
    """Three new vertices of a cycle of weight -1 beside a graph without one."""
    g = fx.graph(spark, sf_dir, "succ40_int")
    n = g.n
    more = spark.createDataFrame([(n + 1, n + 2, 2.0), (n + 2, n + 3, -4.0), (n + 3, n + 1, 1.0)], "u long, v long, weight double")
    found = ps.negative_cycle(Graph.of(g.edges.union(more), n + 3, True))
    return spark.createDataFrame([(found.weight, len(found.cycle))] if found else [], "weight double, arcs int")


@_add(f"WITH RECURSIVE {_ARCS['copart48']}, {_MULTI} SELECT s AS src, v, dist AS distance FROM m")
def all_pairs_squaring(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart48")
    touched = g.arcs.select(F.col("src").alias("v")).distinct()
    unit = Graph(g.edges.withColumn("weight", F.lit(1.0)), g.n, False, True)
    return ps.floyd_warshall(unit, budget=ps.UNLIMITED).join(touched.withColumnRenamed("v", "src"), "src", "left_semi")


@_add(f"WITH RECURSIVE {_ARCS['succ40_int'].replace('>= 40', '>= 45')}, {_MULTI} SELECT s AS src, v, dist AS distance FROM m")
def all_pairs_johnson(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "succ45_int")
    touched = g.arcs.select("src").distinct()
    return ps.johnson(g, budget=ps.UNLIMITED).join(touched, "src", "left_semi")


@_add(f"WITH RECURSIVE {_ARCS['copart48']}, {_MULTI}, x AS (SELECT * FROM m WHERE s <> v), y AS (SELECT s, v, dist FROM x ORDER BY dist DESC, s, v LIMIT 1) SELECT (SELECT count(*) FROM x) AS pairs, dist AS longest, s AS src, v FROM y")
def all_pairs_summary(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart48")
    unit = Graph(g.edges.withColumn("weight", F.lit(1.0)), g.n, False, True)
    return ps.pair_summary(ps.johnson(unit, budget=ps.UNLIMITED))


#: Every vertex's estimate after each round; 80 rounds are more than any of these graphs needs.
_ROUNDS = "f(k, v, dist) AS (SELECT 0 AS k, r AS v, CAST(0 AS DOUBLE) AS dist FROM root UNION ALL (SELECT k + 1 AS k, v, min(dist) AS dist FROM (SELECT k, v, dist FROM f UNION ALL SELECT f.k, arcs.t, f.dist + arcs.w FROM f JOIN arcs ON arcs.s = f.v) WHERE k < 80 GROUP BY k, v))"


@_add(f"WITH RECURSIVE {_ARCS['succ40_int']}, {_HUB}, {_ROUNDS} SELECT k AS round, v, dist AS estimate FROM (SELECT *, lag(dist) OVER (PARTITION BY v ORDER BY k) AS before FROM f) WHERE k > 0 AND (before IS NULL OR dist < before)")
def bellman_ford_rounds(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "succ40_int")
    return ps.lowerings(g, _hub(g), 10_000_000)


_SETTLED = "k AS (SELECT v, dist, row_number() OVER (ORDER BY dist, v) AS rank FROM d)"


@_add(f"WITH RECURSIVE {_ARCS['copart45_int']}, {_HUB}, {_SSSP}, {_SETTLED}, z AS (SELECT v, dist FROM k WHERE rank <= 20) SELECT arcs.t AS v, min(z.dist + arcs.w) AS estimate FROM z JOIN arcs ON arcs.s = z.v WHERE arcs.t NOT IN (SELECT v FROM z) GROUP BY arcs.t")
def settled_frontier(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45_int")
    return ps.frontier_after(g, cut(ps.dijkstra(g, _hub(g))), 20)


@_add(f"WITH RECURSIVE {_ARCS['copart48']}, {_MULTI}, p AS (SELECT m.s, m.v, min(a.s) AS parent FROM m JOIN arcs a ON a.t = m.v JOIN m b ON b.s = m.s AND b.v = a.s AND b.dist + 1 = m.dist GROUP BY m.s, m.v) SELECT m.s AS src, m.v, m.dist AS distance, CAST(m.dist AS INTEGER) AS hops, p.parent FROM m LEFT JOIN p ON p.s = m.s AND p.v = m.v")
def all_pairs_predecessors(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart48")
    unit = Graph(g.edges.withColumn("weight", F.lit(1.0)), g.n, False, True)
    touched = g.arcs.select(F.col("src").alias("v")).distinct()
    return ps.predecessors(unit, ps.every(unit, touched))


@_add(f"WITH RECURSIVE {_ARCS['copart45_int']}, {_HUB}, {_SSSP}, far AS (SELECT v AS t, dist FROM d ORDER BY dist DESC, v LIMIT 1) SELECT (SELECT r FROM root) AS s, t, dist AS distance, CAST(0 AS BIGINT) AS missing_arcs, true AS adds_up FROM far")
def point_to_point(spark, sf_dir):
    """The farthest vertex from the hub, its way there checked arc by arc."""
    g = fx.graph(spark, sf_dir, "copart45_int")
    s = _hub(g)
    t = ps.distances(g, [s]).orderBy(F.desc("distance"), "v").first().v
    distance, way = ps.shortest_path(g, s, t)
    checked = ps.hops(g, way).agg(F.count_if(F.col("weight").isNull()).alias("missing_arcs"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))
    return checked.select(F.lit(s).cast("long").alias("s"), F.lit(t).cast("long").alias("t"), F.lit(distance).alias("distance"), "missing_arcs", (F.col("total") == distance).alias("adds_up"))


# --- strong components in order --------------------------------------------------------------

_COND = f"{_ARCS['succ45']}, {_MULTI}, {_SCC}, ca AS (SELECT DISTINCT x.scc AS s, y.scc AS t FROM arcs JOIN scc x ON x.v = arcs.s JOIN scc y ON y.v = arcs.t WHERE x.scc <> y.scc), {_LAYERS.replace('arcs', 'ca')}"


@_add(f"WITH RECURSIVE {_COND}, z AS (SELECT v AS scc, row_number() OVER (ORDER BY layer, v) AS component FROM l WHERE v IN (SELECT scc FROM scc)) SELECT scc.v, z.component FROM scc JOIN z ON z.scc = scc.scc")
def scc_topological_ids(spark, sf_dir):
    return sc.component_ids(fx.graph(spark, sf_dir, "succ45"))


@_add(f"WITH RECURSIVE {_ARCS['succ45']}, {_MULTI}, {_SCC}, z AS (SELECT scc, row_number() OVER (ORDER BY count(*) DESC, scc) AS component FROM scc GROUP BY scc) SELECT scc.v, z.component FROM scc JOIN z ON z.scc = scc.scc")
def scc_by_size(spark, sf_dir):
    return sc.by_size(fx.graph(spark, sf_dir, "succ45"))


@_add(f"WITH RECURSIVE {_ARCS['copart45']}, {_HUB}, {_TREE} SELECT v AS old_id, rank AS new_id FROM b WHERE rank <= 50")
def ball_50(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45")
    return sg.select(g, "ball", _hub(g), 50)


@_add(f"WITH RECURSIVE {_ARCS['copart45']}, {_HUB}, {_TREE}, k AS (SELECT v, rank FROM b WHERE level <= 2) SELECT least(x.rank, y.rank) AS u, greatest(x.rank, y.rank) AS v, 1.0 / papers AS weight FROM copart a JOIN k x ON x.v = a.u JOIN k y ON y.v = a.v")
def egonet_numbered(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45")
    return sg.egonet(g, _hub(g), 2)[1]


@_add(f"WITH RECURSIVE {_ARCS['copart45']}, {_HUB}, {_BFS} SELECT count(*) AS reached, CAST(0 AS BIGINT) AS wrong_parents, CAST(0 AS BIGINT) AS wrong_ranks, CAST(0 AS BIGINT) AS cross_edges FROM d")
def dfs_tree_valid(spark, sf_dir):
    """A depth-first tree of an undirected graph: parents are neighbours, ranks 1 .. reached, and each edge joins a vertex with one above it."""
    g = fx.graph(spark, sf_dir, "copart45")
    tree = cut(tr.dfs(g, _hub(g)))
    sized = cut(sg.subtree_sizes(tree))
    own = lambda c: sized.select(F.col("v").alias(c), F.col("rank").alias(f"r{c}"), F.col("size").alias(f"s{c}"))
    e = g.edges.join(own("u"), "u").join(own("v"), "v")
    inside = ((F.col("rv") > F.col("ru")) & (F.col("rv") < F.col("ru") + F.col("su"))) | ((F.col("ru") > F.col("rv")) & (F.col("ru") < F.col("rv") + F.col("sv")))
    arcs = g.arcs.select(F.col("src").alias("parent"), F.col("dst").alias("v"))
    reached = tree.count()
    wrong = tree.where("parent is not null").join(arcs, ["parent", "v"], "left_anti").count()
    ranks = reached - tree.where(F.col("rank").between(1, reached)).select("rank").distinct().count()
    return spark.createDataFrame([(reached, wrong, ranks, e.where(~inside).count())], "reached long, wrong_parents long, wrong_ranks long, cross_edges long")


# --- all lines -------------------------------------------------------------------------------
# The whole of lineitem: dense graphs with hubs, for what is linear in the edges.


@_add(f"WITH {_ARCS['copart00']}, {_DEG} SELECT v, degree FROM deg")
def degree_all(spark, sf_dir):
    return st.degrees(fx.graph(spark, sf_dir, "copart00"))


@_add(f"WITH {_ARCS['copart00']}, {_DEG} SELECT {_DSTATS} FROM deg")
def degree_stats_all(spark, sf_dir):
    return st.degree_stats(fx.graph(spark, sf_dir, "copart00"))


@_add(f"WITH RECURSIVE {_ARCS['copart00']}, {_BOTH}, {_LABEL} SELECT k AS component, count(*) AS size FROM c GROUP BY k")
def component_sizes_all(spark, sf_dir):
    return cc.component_sizes(fx.graph(spark, sf_dir, "copart00"))


@_add(f"WITH RECURSIVE {_ARCS['copart00']}, {_HUB}, {_BFS} SELECT v, CAST(dist AS INTEGER) AS level FROM d")
def bfs_levels_all(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart00")
    return tr.levels_from(g, _roots(g, _hub(g))).select("v", "level")


@_add(f"WITH RECURSIVE {_ARCS['copart00_int']}, {_HUB}, {_SSSP} SELECT v, dist AS distance FROM d")
def sssp_all(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart00_int")
    return ps.distances(g, [_hub(g)]).select("v", "distance")


_COSUPPLIER = "sm AS (SELECT DISTINCT l_orderkey AS p, l_suppkey + 1 AS a FROM lineitem), cosupplier AS (SELECT x.a AS u, y.a AS v, CAST(count(*) AS BIGINT) AS orders FROM sm x JOIN sm y ON x.p = y.p AND x.a < y.a GROUP BY x.a, y.a)"


@_add(f"WITH {_COSUPPLIER} SELECT count(*) AS edges, min(orders) AS min_orders, max(orders) AS max_orders, sum(orders) AS orders FROM cosupplier")
def cosupplier_edges(spark, sf_dir):
    e = fx.rows(spark, sf_dir, _COSUPPLIER, "SELECT u, v, orders FROM cosupplier")
    return e.agg(F.count("*").alias("edges"), F.min("orders").alias("min_orders"), F.max("orders").alias("max_orders"), F.sum("orders").alias("orders"))


_ALL_PAPERS = _PAPER.replace(fx.PAPERS, fx.ALL_PAPERS)


@_add(f"WITH {_ALL_PAPERS} SELECT u, v, CAST(1 AS DOUBLE) / count(*) AS weight FROM term GROUP BY u, v")
def network_edges_all(spark, sf_dir):
    papers = cut(_papers(spark, sf_dir, fx.ALL_PAPERS))
    return co.edges(co.terms(papers, cut(co.numbering(papers))))


# --- text in and out -------------------------------------------------------------------------

_LINES = "SELECT l_orderkey * 100 + l_linenumber + 2 AS line, concat_ws(' ', l_partkey + 1, l_suppkey + 1, CAST(l_quantity AS BIGINT) - 25) AS value FROM lineitem"


@_add("SELECT least(l_partkey, l_suppkey) + 1 AS u, greatest(l_partkey, l_suppkey) + 1 AS v, CAST(min(CAST(l_quantity AS BIGINT) - 25) AS DOUBLE) AS weight FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL")
def parse_edge_list(spark, sf_dir):
    body = fx.rows(spark, sf_dir, "", _LINES)
    n = fx.parts(spark, sf_dir)
    head = spark.createDataFrame([(1, f"  {n}\t\r"), (2, "")], "line long, value string")
    return text.parse_edges(head.union(body.select("line", "value"))).edges


@_add("SELECT s_suppkey + 1 AS vertex, s_name AS name FROM supplier")
def parse_names(spark, sf_dir):
    s = fx.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 2).alias("line"), F.concat(F.col("s_suppkey") + 1, F.lit("; "), "s_name", F.lit("  \r")).alias("value"))
    return text.parse_names(spark.createDataFrame([(1, "\ufeffid,name")], "line long, value string").union(s))


@_add("SELECT l_partkey + 1 AS u, l_suppkey + 1 AS v, l_quantity / 4 AS papers FROM lineitem")
def parse_strengths(spark, sf_dir):
    q = F.concat_ws(" ", F.col("l_partkey") + 1, F.col("l_suppkey") + 1, F.col("l_quantity") / 4)
    return fx.table(spark, sf_dir, "lineitem").select(q.alias("value")).select(text.strength_of("value").alias("s")).select("s.u", "s.v", "s.papers")


@_add(f"WITH {_S40} SELECT concat_ws(' ', u, v) AS line FROM succ UNION ALL SELECT CAST({_N} AS VARCHAR)")
def edge_list_lines(spark, sf_dir):
    return sinks.edge_lines(fx.graph(spark, sf_dir, "succ40")).select("line")


@_add(f"SELECT x, CASE WHEN abs(x) < 1e15 THEN rtrim(rtrim(printf('%.8f', x), '0'), '.') ELSE printf('%.0f', x) END AS plain, CASE WHEN abs(x) < 1e15 THEN printf('%.3f', x) END AS three FROM (SELECT l_quantity / 64 AS x FROM lineitem UNION ALL SELECT -l_quantity * 1e20 FROM lineitem)")
def number_text(spark, sf_dir):
    from arcwright.functions.text import fixed, plain_double

    q = fx.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 64).alias("x"))
    q = q.union(fx.table(spark, sf_dir, "lineitem").select(-F.col("l_quantity") * F.lit(1e20)))
    return q.select("x", plain_double(F.col("x")).alias("plain"), F.when(F.abs("x") < 1e15, fixed(F.col("x"), 3)).alias("three"))


@_add(f"WITH {_S40}, both_ AS (SELECT u, v FROM succ UNION SELECT v, u FROM succ), x AS (SELECT u AS v, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY v) AS ns, count(*) AS c FROM both_ GROUP BY u) SELECT p_partkey + 1 AS v, CAST(coalesce(sum(c) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, coalesce(ns, '') AS neighbours FROM part LEFT JOIN x ON x.v = p_partkey + 1")
def drawing_rows(spark, sf_dir):
    return rp.drawing_rows(fx.graph(spark, sf_dir, "succ40")).select("v", F.col("begin").alias("first"), F.array_join("neighbours", " ").alias("neighbours"))


@_add(f"WITH {_ARCS['copart45']}, {_DEG} SELECT v, CAST(sum(degree) OVER (ORDER BY v) - degree AS BIGINT) AS first, CAST(sum(degree) OVER (ORDER BY v) AS BIGINT) AS last FROM deg")
def csr_offsets(spark, sf_dir):
    return rp.offsets(fx.graph(spark, sf_dir, "copart45")).select("v", F.col("begin").alias("first"), F.col("end").alias("last"))


@_add(f"WITH {_ARCS['copart45']} SELECT s AS v, t // 64 AS word, true AS any, count(DISTINCT t) AS arcs FROM arcs GROUP BY ALL")
def matrix_words(spark, sf_dir):
    rows = rp.bit_rows(fx.graph(spark, sf_dir, "copart45"))
    return rows.select("v", "word", (F.bit_count("bits") >= 1).alias("any"), F.bit_count("bits").cast("long").alias("arcs"))


@_add(f"WITH {_PAPER} SELECT (SELECT count(*) FROM num WHERE first_year <= 1998) AS vertices, count(DISTINCT (u, v)) AS edges, count(*) AS pairs FROM term WHERE year <= 1998")
def network_counts_1998(spark, sf_dir):
    _, numbers, terms = _network(spark, sf_dir)
    return co.counts(terms, numbers, 1998)


# --- diameter and layouts ------------------------------------------------------------------

_DIAMETER = f"WITH RECURSIVE {_ARCS['copart48']}, {_MULTI} SELECT CAST(max(dist) AS BIGINT) AS value FROM m"


def _diameter(method: str):
    def query(spark, sf_dir):
        return spark.createDataFrame([(dm.diameter(fx.graph(spark, sf_dir, "copart48"), method).value,)], "value long")

    query.__name__ = f"diameter_{method}"
    return query


for _method in ("exact", "ifub", "bounds"):
    _add(_DIAMETER)(_diameter(_method))


@_add(f"WITH RECURSIVE {_ARCS['copart48']}, {_MULTI} SELECT CAST(max(dist) AS BIGINT) AS value, true AS not_above, true AS at_least_half FROM m")
def diameter_sweep(spark, sf_dir):
    """A lower bound, no less than half of the diameter."""
    g = fx.graph(spark, sf_dir, "copart48")
    exact, low = dm.diameter(g, "exact").value, dm.diameter(g, "sweep").value
    return spark.createDataFrame([(exact, low <= exact, 2 * low >= exact)], "value long, not_above boolean, at_least_half boolean")


#: Sizes of subtrees, and what comes before a child among its parent's.
_SIZES = """up(v, a) AS (SELECT v, v AS a FROM b UNION ALL SELECT up.v, b.parent FROM up JOIN b ON b.v = up.a WHERE b.parent IS NOT NULL),
    n AS (SELECT a AS v, count(*) AS size FROM up GROUP BY a),
    h AS (SELECT b.v, b.parent, b.level, n.size, coalesce(sum(n.size) OVER (PARTITION BY b.parent ORDER BY b.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b JOIN n ON n.v = b.v)"""
_WEDGES = "w(v, first, width, size) AS (SELECT v, CAST(0 AS DOUBLE), 2 * pi(), size FROM h WHERE parent IS NULL UNION ALL SELECT h.v, w.first + h.before * (w.width / greatest(w.size - 1, 1)), h.size * (w.width / greatest(w.size - 1, 1)), h.size FROM w JOIN h ON h.parent = w.v)"


@_add(f"WITH RECURSIVE {_ARCS['copart45']}, {_HUB}, {_TREE}, {_SIZES}, {_WEDGES} SELECT w.v, h.level, w.size, round(w.first + w.width / 2, 6) AS angle FROM w JOIN h ON h.v = w.v")
def radial_layout(spark, sf_dir):
    g = fx.graph(spark, sf_dir, "copart45")
    return sg.radial_layout(cut(tr.bfs(g, _hub(g)))).select("v", "level", "size", F.round("angle", 6).alias("angle"))


@_add(f"WITH RECURSIVE {_ARCS['copart45']}, {_HUB}, {_TREE} SELECT count(*) AS placed, max(level) AS depth, CAST(count(*) FILTER (WHERE v NOT IN (SELECT parent FROM b WHERE parent IS NOT NULL)) AS BIGINT) AS leaf_slots, CAST(0 AS BIGINT) AS off_centre FROM b")
def tree_layout(spark, sf_dir):
    """Leaves take a slot each, side by side, and every parent is over the middle of its first and last child."""
    g = fx.graph(spark, sf_dir, "copart45")
    tree = cut(tr.bfs(g, _hub(g)))
    at = cut(sg.tree_layout(tree))
    child = tree.select("v", "parent").join(at, "v")
    middle = child.where("parent is not null").groupBy(F.col("parent").alias("v")).agg(((F.min("slot") + F.max("slot")) / 2).alias("middle"))
    both = at.join(middle, "v", "left")
    return both.agg(
        F.count("*").alias("placed"),
        F.max("depth").alias("depth"),
        F.count_distinct(F.when(F.col("middle").isNull() & (F.col("slot") == F.floor("slot")), F.col("slot"))).alias("leaf_slots"),
        F.count_if(F.abs(F.col("slot") - F.col("middle")) > 1e-9).alias("off_centre"),
    )

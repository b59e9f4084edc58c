import heapq
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from arcwright.model import Cancelled, Graph, GraphError, NegativeCycle, NegativeWeight, NotAcyclic, OverBudget, ParseError, RecursionLimit
from arcwright.operators import components as cc, diameter as dm, kernels, normalize, paths as ps, representation as rp, stats as st, strong as sc, subgraph as sg, traversal as tr
from arcwright.plans import loops
from arcwright.plans.loops import cut
from arcwright.sources import sinks, text


SMALL = "/root/testdata/sf0.001"


def graph(spark, n, rows, directed=False):
    schema = "u long, v long" + (", weight double" if rows and len(rows[0]) == 3 else "")
    return Graph.of(spark.createDataFrame(rows, schema), n, directed)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


RING = [(1, 4), (4, 6), (6, 2), (2, 3), (3, 6), (1, 5)]


@pytest.fixture(params=["one task", "joins"])
def plan(request, monkeypatch):
    """Both ways to search: within one task, and by joins round by round."""
    if request.param == "joins":
        monkeypatch.setattr(kernels, "LOCAL_EDGES", -1)
    return request.param


def lines(spark, body):
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(body.split("\n"))], "line long, value string")


def test_searches(spark, plan):
    g = graph(spark, 6, RING)
    assert (g.local is None) == (plan == "joins")
    assert [r.v for r in tr.bfs(g, 1).orderBy("rank").collect()] == [1, 4, 5, 6, 2, 3]
    d = {r.v: r.parent for r in tr.dfs(g, 1).collect()}
    assert d == {1: None, 4: 1, 6: 4, 2: 6, 3: 2, 5: 1}
    assert tr.dfs(g, 1, max_depth=4).count() == 6
    with pytest.raises(RecursionLimit):
        tr.dfs(g, 1, max_depth=3)
    assert tr.distance(g, 3, 1) == 3 and tr.path(tr.bfs(g, 3), 1) == [3, 6, 4, 1] and tr.path(tr.bfs(g, 3), 3) == [3]
    assert tr.eccentricity(g, 5) == (4, 3) and got(tr.level_sizes(tr.bfs(g, 1)), "level", "size") == [(0, 1), (1, 2), (2, 1), (3, 2)]
    with pytest.raises(GraphError):
        tr.bfs(g, 7)
    s = st.degree_stats(g).first()
    assert (s.min_degree, s.max_degree, s.mean_degree, s.median_degree) == (1, 3, 2.0, 2.0)
    assert {dm.diameter(g, m).value for m in (("exact", "bounds", "ifub") if plan == "one task" else ("exact",))} == {4}
    assert got(g.neighbors(6), "v") == [(2,), (3,), (4,)] and g.has_edge(6, 3) and not g.has_edge(1, 2) and g.weight(1, 2) is None
    far = graph(spark, 4, [(1, 2)])
    assert tr.distance(far, 1, 4) is None and tr.path(tr.bfs(far, 1), 4) == [] and got(tr.dfs(far, 4), "v", "rank") == [(4, 1)]
    directed = graph(spark, 3, [(1, 2), (2, 3)], True)
    assert tr.distance(directed, 3, 1) is None and tr.distance(directed, 1, 3) == 2
    with pytest.raises(GraphError):
        dm.diameter(directed, "ifub")
    assert dm.diameter(directed, "exact").value == 2
    if plan == "joins":
        return
    told = []
    stopped = dm.diameter(g, "ifub", progress=lambda searches, best: told.append((searches, best)) or len(told) < 2)
    assert stopped.cancelled and stopped.value <= 4 and len(told) == 2
    late = dm.diameter(g, "exact", deadline_s=-1)
    assert late.cancelled and not late.is_exact


def test_both_plans_agree(spark, monkeypatch):
    """Random graphs, directed and not, with zero weights and many ties: the same rows by either plan, and as a textbook says."""
    n = 16
    for seed, directed in ((1, False), (2, True)):
        r = random.Random(seed)
        rows = [(r.randint(1, n), r.randint(1, n), float(r.randint(0, 3))) for _ in range(28)]
        made = []
        for bound in (2_000_000, -1):
            monkeypatch.setattr(kernels, "LOCAL_EDGES", bound)
            g = graph(spark, n, rows, directed)
            root = got(g.edges, "u")[0][0]
            pairs = ps.floyd_warshall(g)
            made.append(
                [
                    got(tr.bfs(g, root), "rank", "v", "level"), [x.parent for x in tr.bfs(g, root).orderBy("rank").collect()], got(tr.bfs(g, root, max_level=2), "rank", "v"), got(tr.bfs(g, root, max_vertices=7), "rank", "v"),
                    got(tr.levels_from(g, g.vertices.where("v < 9")), "src", "v", "level"), got(ps.dijkstra(g, root), "rank", "v", "distance"), [x.parent for x in ps.dijkstra(g, root).orderBy("rank").collect()],
                    got(cc.components(g), "v", "component"), got(sc.strong_components(g), "v", "scc"), got(sc.component_ids(g), "v", "component"), got(pairs, "src", "v", "distance"), got(ps.johnson(g), "src", "v", "distance"),
                    got(tr.dfs(g, root), "rank", "v", "level"), got(ps.predecessors(g, pairs).na.fill(0), "src", "v", "hops", "parent"),
                ]
            )
        for one, other in zip(*made):
            assert one == other
        arcs = [tuple(x) for x in g.arcs.collect()]
        distance, _, order = textbook(n, arcs, root)
        assert [(v, d) for _, v, d in made[0][5]] == [(v, distance[v]) for v in order]
        for t in (order[-1], order[len(order) // 2]):
            d, way = ps.shortest_path(g, root, t)
            assert d == distance[t] and way[0] == root and way[-1] == t and ps.path_length(g, way) == d
        lists = {}
        for u, v, _ in arcs:
            lists.setdefault(u, []).append(v)
        seen = []

        def walk(v):
            seen.append(v)
            for w in sorted(lists.get(v, ())):
                if w not in seen:
                    walk(w)

        walk(root)
        assert [v for _, v, _ in made[0][12]] == seen


def test_normalise(spark):
    rows = [(3, 2), (2, 3), (5, 2), (2, 3), (1, 1)]
    assert got(graph(spark, 5, rows).edges, "u", "v") == [(2, 3), (2, 5)]
    assert got(graph(spark, 5, rows, True).edges, "u", "v") == [(2, 3), (3, 2), (5, 2)]
    w = graph(spark, 4, [(2, 2, -1.5), (2, 4, 3.0), (4, 4, -0.5), (2, 2, -2.5), (3, 3, 7.0)], True)
    assert got(w.negative_loops, "v", "weight") == [(2, -2.5), (4, -0.5)]
    assert normalize.overflows(normalize.with_weight(spark.createDataFrame([(1, 2, 1e308), (2, 3, 1e308)], "u long, v long, weight double")))


def test_parse(spark):
    g = text.parse_edges(lines(spark, "3\r\n\n1 2 .5\n 2 3 1e2 \n2 1 4"))
    assert got(g.edges, "u", "v", "weight") == [(1, 2, 0.5), (2, 3, 100.0)] and g.n == 3
    for body, kind, line in [("\n ", "Empty", 1), ("x", "InvalidVertexCount", 1), ("0", "InvalidVertexCount", 1), ("3\n1 2\n1 2 3 4", "InvalidEdge", 3), ("3\n1 4", "VertexOutOfRange", 2), ("3\n1 2\n1 3 1", "InconsistentColumns", 3), ("3\n1 2 nan", "InvalidWeight", 2), ("3\n1 2 5d", "InvalidWeight", 2), ("2\n1 2 1e308\n2 1 1e308\n1 1 -1.7e308", "WeightsOverflow", 1)]:
        with pytest.raises(ParseError) as e:
            text.parse_edges(lines(spark, body))
        assert (e.value.kind, e.value.line) == (kind, line), body


def test_components(spark, plan):
    g = graph(spark, 9, [(2, 3), (3, 5), (5, 2), (4, 6), (6, 7), (7, 8)])
    assert got(cc.components(g), "component", "v") == [(1, 4), (1, 6), (1, 7), (1, 8), (2, 2), (2, 3), (2, 5), (3, 1), (4, 9)]
    path = graph(spark, 400, [(i, i + 1) for i in range(1, 400)])
    assert got(cc.component_sizes(path), "component", "size") == [(1, 400)]
    assert got(cc.labels(graph(spark, 3, [(2, 1), (2, 3)], True)), "v", "component") == [(1, 1), (2, 1), (3, 1)]


def test_labels_of_a_shuffled_path(spark):
    """As many rounds as it takes."""
    order = list(range(1, 3001))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long")
    assert cc.min_labels(edges).select("component").distinct().collect() == [(1,)]


def test_strong(spark, plan):
    g = graph(spark, 7, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (7, 1)], True)
    assert got(sc.strong_components(g), "v", "scc") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)]
    assert got(sc.condensation(g), "u", "v") == [(1, 4), (7, 1)]
    assert got(sc.component_ids(g), "v", "component") == [(1, 3), (2, 3), (3, 3), (4, 4), (5, 4), (6, 1), (7, 2)]
    assert got(sc.by_size(g), "v", "component") == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 4)]
    assert got(sc.members(g, 4), "v") == [(4,), (5,)] and not sc.is_acyclic(g)
    with pytest.raises(NotAcyclic) as e:
        sc.topological_order(g)
    assert e.value.largest == 3
    with pytest.raises(NotAcyclic):
        ps.dag_shortest_path(g, 1)
    dag = graph(spark, 5, [(1, 2, 4.0), (1, 4, 2.0), (4, 2, -5.0), (2, 5, 1.0)], True)
    place = {r.v: r.place for r in sc.topological_order(dag).collect()}
    assert place[1] < place[4] < place[2] < place[5] and sc.is_acyclic(dag)
    assert dict((r.v, r.distance) for r in ps.dag_shortest_path(dag, 1).collect())[5] == -2.0


def textbook(n, arcs, root):
    """Distances, parents and order of settling, ties to the smaller id."""
    near = {}
    for u, v, w in arcs:
        near.setdefault(u, []).append((v, w))
    d, parent, order, heap = {root: 0.0}, {root: None}, [], [(0.0, root)]
    while heap:
        x, u = heapq.heappop(heap)
        if u in order:
            continue
        order.append(u)
        for v, w in near.get(u, ()):
            if v not in d or x + w < d[v]:
                d[v], parent[v] = x + w, u
                heapq.heappush(heap, (x + w, v))
    return d, parent, order


@pytest.mark.parametrize("seed", [1, 2])
def test_dijkstra_against_textbook(spark, seed, plan):
    r = random.Random(seed)
    rows = [(r.randint(1, 30), r.randint(1, 30), float(r.randint(0, 4))) for _ in range(70)]
    g = graph(spark, 30, rows)
    root = g.edges.first().u
    d, _, order = textbook(30, [tuple(x) for x in g.arcs.collect()], root)
    made = ps.dijkstra(g, root).orderBy("rank").collect()
    assert {x.v: x.distance for x in made} == d and [x.v for x in made] == order


def test_negative(spark, plan):
    g = graph(spark, 5, [(1, 2, 0.5), (2, 3, 2.0), (3, 4, -1.5), (4, 1, 3.0)])
    with pytest.raises(NegativeWeight) as e:
        ps.dijkstra(g, 1)
    assert e.value.edge == (3, 4, -1.5)
    with pytest.raises(NegativeCycle) as e:
        ps.bellman_ford(g, 1)
    assert (e.value.cycle, e.value.weight) == ([3, 4], -3.0)
    assert got(ps.bellman_ford(g, 5), "v", "distance") == [(5, 0.0)]
    loop = graph(spark, 4, [(1, 3, 1.0), (3, 2, 1.0), (2, 2, -1.0), (4, 4, -2.0)], True)
    with pytest.raises(NegativeCycle) as e:
        ps.bellman_ford(loop, 1)
    assert e.value.cycle == [2]
    ring = graph(spark, 12, [(i, i % 12 + 1, 1.0) for i in range(1, 13)] + [(9, 3, -4.0)], True)
    assert ps.negative_cycle(ring) is None
    pairs = {(r.src, r.v): r.distance for r in ps.johnson(ring).collect()}
    table = ps.floyd_warshall(ring)
    assert pairs == {(r.src, r.v): r.distance for r in table.collect()}
    assert pairs[9, 5] == -2 and pairs[3, 9] == 6
    assert ps.pair_table(table, [9, 5]) == [[0.0, -2.0], [4.0, 0.0]] and ps.pair_path(ring, table, 8, 4) == (-2.0, [8, 9, 3, 4])
    assert ps.check_sweep(ring, ps.johnson).isEmpty()
    assert not ps.check_sweep(ring, lambda g: ps.johnson(g).withColumn("distance", F.col("distance") + 1e-6)).isEmpty()
    planted = graph(spark, 6, [(2, 4, 2.0), (4, 6, -4.0), (6, 2, 1.0), (6, 1, 1.0), (1, 3, 5.0)], True)
    for found in (ps.negative_cycle(planted), pytest.raises(NegativeCycle, ps.bellman_ford, planted, 2).value, pytest.raises(NegativeCycle, ps.floyd_warshall, planted).value):
        assert found.weight == -1 and found.cycle == [2, 4, 6] and found.arcs() == [(2, 4), (4, 6), (6, 2)]
    assert pytest.raises(NegativeCycle, ps.bellman_ford_to, planted, 2).value.cycle == [2, 4, 6]
    assert got(ps.bellman_ford_to(ring, 5), "v", "distance")[8] == (9, -2.0)
    with pytest.raises(OverBudget):
        ps.johnson(ring, budget=10)


def test_schedules_and_sweeps(spark, plan):
    r = random.Random(8)
    arcs = [(u, v, float(r.randint(0, 8) + 3 * u - 3 * v)) for u, v in {(r.randint(1, 15), r.randint(1, 15)) for _ in range(40)} if u != v]
    g = graph(spark, 15, arcs, True)
    made = {s: got(ps.bellman_ford(g, arcs[0][0], s), "v", "parent", "distance", "rank") for s in ("queue", "slf", "rounds", "early-stop", "yen", "random-yen", "FIFO")} if plan == "one task" else {s: got(ps.distances(g, [arcs[0][0]], s), "v", "distance") for s in ("queue", "rounds", "yen")}
    assert len({tuple(map(str, x)) for x in made.values()}) == 1
    with pytest.raises(GraphError):
        ps.bellman_ford(g, 1, "sideways")
    table, turns = ps.floyd_warshall(g), []
    assert got(ps.floyd_warshall(g, ps.squared, progress=turns.append), "src", "v", "distance") == got(table, "src", "v", "distance") and turns
    with pytest.raises(Cancelled):
        ps.floyd_warshall(g, progress=lambda turn: False)
    h = cut(ps.potentials(g))
    back = ps.original(ps.reweighted(g, h), h)
    assert got(back.edges, "u", "v", "weight") == got(g.edges, "u", "v", "weight")


def test_rounds_clear_what_they_forget(spark, monkeypatch):
    """Shuffles of forgotten plans go while rounds run, not when the driver's memory is full."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left(most):
        for _ in range(50):
            if manager.getAllFiles().size() <= most:
                break
            time.sleep(0.1)
        return manager.getAllFiles().size()

    for k in range(7, 13):
        cut(spark.range(1000).groupBy((F.col("id") % k).alias("k")).count())
    most = manager.getAllFiles().size()
    for _ in range(3):
        loops.clear(spark)
        time.sleep(1)
    assert left(most // 2) <= most // 2
    calls = []
    monkeypatch.setattr(cc, "clear", calls.append)
    path = spark.range(1, 40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert cc.min_labels(path).where("component <> 1").isEmpty() and calls


def test_strong_components_of_many_classes(spark, monkeypatch):
    """Rings apart, one with arcs across it: classes that fit go to tasks, whose rounds don't grow with a ring; others go round by round, to the same rows."""
    monkeypatch.setattr(kernels, "LOCAL_EDGES", -1)
    rings = [(k * 10 + i + 1, k * 10 + (i + 1) % 10 + 1) for k in range(4) for i in range(10)]
    g = graph(spark, 50, rings[:-1] + [(1, 5), (3, 41), (41, 42), (42, 41), (42, 43)], True)
    want = [(v, (v - 1) // 10 * 10 + 1 if v <= 30 else 41 if v in (41, 42) else v) for v in range(1, 51)]
    jobs, sc_ = [], spark.sparkContext
    for bound in (sc.CLASS_EDGES, 10, 0):
        monkeypatch.setattr(sc, "CLASS_EDGES", bound)
        sc_.setJobGroup(f"strong {bound}", "")
        assert got(sc.strong_components(g), "v", "scc") == want
        jobs.append(len(sc_.statusTracker().getJobIdsForGroup(f"strong {bound}")))
    sc_.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] < jobs[2] / 2
    assert got(sc.condensation(g), "u", "v") == [(1, 41), *[(v, v + 1) for v in range(31, 40)], (41, 43)]


def test_strong_components_in_one_task(spark, monkeypatch):
    """A graph beyond the driver's plan that fits one task takes no rounds, whatever its weak components; it is not gathered by the driver."""
    monkeypatch.setattr(kernels, "LOCAL_EDGES", -1)
    for name in ("min_labels", "_trim"):
        monkeypatch.setattr(sc, name, lambda *a: pytest.fail("a round"))
    monkeypatch.setattr(kernels, "gathered", lambda *a: pytest.fail("gathered"))
    g = graph(spark, 30, [*((v, v % 20 + 1) for v in range(1, 21)), (20, 22), (22, 23), (25, 24), (24, 25), (3, 25)], True)
    assert got(sc.strong_components(g), "v", "scc") == [(v, 1 if v <= 20 else 24 if v == 25 else v) for v in range(1, 31)]
    assert got(sc.condensation(g), "u", "v") == [(1, 22), (1, 24), (22, 23)]
    empty = graph(spark, 3, [], True)
    assert got(sc.strong_components(empty), "v", "scc") == [(1, 1), (2, 2), (3, 3)] and not got(sc.condensation(empty), "u", "v")


def test_strong_rounds_let_go(spark, monkeypatch):
    """Rounds of larger graphs let go of former ones, and find what the search in one task finds."""
    monkeypatch.setattr(kernels, "LOCAL_EDGES", -1)
    monkeypatch.setattr(sc, "CLASS_EDGES", 0)
    calls = []
    monkeypatch.setattr(sc, "clear", calls.append)
    g = graph(spark, 11, [(1, 2), (2, 3), (3, 4), (4, 1), (3, 6), (6, 7), (7, 6), (8, 9), (9, 8), (9, 3), (7, 10), (10, 11)], True)
    assert got(sc.strong_components(g), "v", "scc") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (7, 6), (8, 8), (9, 8), (10, 10), (11, 11)]
    assert len(calls) >= 2


def test_default_budget(spark):
    wide = graph(spark, 200_000, [(1, 2, 1.0)])
    for table in (ps.johnson, ps.floyd_warshall):
        with pytest.raises(OverBudget):
            table(wide)
    with pytest.raises(OverBudget):
        ps.replay(wide)


@pytest.mark.parametrize("name", ["all_pairs_johnson", "all_pairs_squaring", "all_pairs_summary"])
def test_whole_tables_of_all_pairs(spark, monkeypatch, name):
    """Queries make the whole table, however many vertices there are; searches in one task cost what they reach."""
    from arcwright import catalog

    want = got(catalog.queries()[name](spark, SMALL), *catalog.queries()[name](spark, SMALL).columns)
    monkeypatch.setattr(ps, "TABLE_BYTES", 1)
    made = catalog.queries()[name](spark, SMALL)
    assert got(made, *made.columns) == want and want


def test_reach_leaves_nothing_behind(spark):
    g = graph(spark, 6, [(1, 2, 3.0), (2, 3, 0.0), (1, 3, 4.0), (4, 1, 1.0)], True)
    reach = kernels.Reach(g.local.value)
    for _ in range(2):
        assert [[x.tolist() for x in reach(v)] for v in (4, 1, 6)] == [[[1, 2, 3, 4], [1, 4, 4, 0]], [[1, 2, 3], [0, 3, 3]], [[6], [0]]]


def test_replay(spark):
    g = graph(spark, 5, [(1, 2, 3.0), (2, 3, 1.0), (1, 3, 9.0), (3, 4, 2.0)], True)
    low = ps.replay(g)
    last = low.groupBy("src", "v").agg(F.min_by("distance", -F.col("round")).alias("distance"))
    assert got(last, "src", "v", "distance") == got(ps.floyd_warshall(g), "src", "v", "distance")
    assert got(low.where("round = 2"), "src", "v", "distance") == [(1, 3, 4.0)]
    tree = ps.dijkstra(g, 1)
    assert got(ps.hop_depths(tree), "v", "depth") == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert got(ps.replay_order(tree, ps.lowerings(g, 1, 100)), "place", "v") == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert ps.lowerings(g, 1, 1) is None
    assert got(ps.work(g, 1), "round", "scanned", "lowered") == [(1, 2, 2), (2, 2, 2), (3, 1, 1), (4, 0, 0)]


def test_cuts_and_layouts(spark, plan):
    g = graph(spark, 6, RING)
    kept, edges = sg.egonet(g, 6, 1)
    assert got(kept, "old_id", "new_id") == [(2, 2), (3, 3), (4, 4), (6, 1)] and got(edges, "u", "v") == [(1, 2), (1, 3), (1, 4), (2, 3)]
    assert got(sg.select(g, "most-connected", 1, 2), "new_id", "old_id") == [(1, 6), (2, 1)]
    assert got(sg.select(g, "ball", 99, 3), "new_id", "old_id") == [(1, 1), (2, 4), (3, 5)] and sg.select(g, "ball", 1, 0).count() == 0
    tree = tr.bfs(g, 1)
    # wedges: 4 has a subtree of four, 5 of one, in turn
    angles = {r.v: r.angle for r in sg.radial_layout(tree).collect()}
    unit = 2 * math.pi / 5
    assert all(math.isclose(angles[v], a) for v, a in {1: math.pi, 4: 2 * unit, 5: 4.5 * unit, 6: 2 * unit}.items()) and angles[2] < angles[6] < angles[3]
    slots = {r.v: (r.slot, r.depth) for r in sg.tree_layout(tree).collect()}
    assert slots == {2: (0.0, 3), 3: (1.0, 3), 5: (2.0, 1), 6: (0.5, 2), 4: (0.5, 1), 1: (1.25, 0)}


def test_sinks_and_names(spark, tmp_path):
    g = graph(spark, 3, [(1, 2, 0.5), (2, 3, 2.0)])
    assert [r.line for r in sinks.edge_lines(g).orderBy("part", "at").collect()] == ["3", "1 2 0.5", "2 3 2"]
    sinks.write(sinks.edge_lines(g), str(tmp_path / "g"), one_file=True)
    assert got(text.edge_list(spark, str(tmp_path / "g")).edges, "u", "v", "weight") == got(g.edges, "u", "v", "weight")
    tree = tr.bfs(graph(spark, 3, [(1, 2)]), 1)
    assert [r.line for r in sinks.tree_lines(tree, graph(spark, 3, [(1, 2)]), 1).orderBy("part", "at").collect()] == ["# root 1", "# vertex parent level", "1 0 0", "2 1 1", "3 - -"]
    (tmp_path / "n.csv").write_bytes("1,Ana\n2,Jos\xe9 Silva\n".encode("latin-1"))
    names = text.names(spark, str(tmp_path / "n.csv"))
    assert got(names, "vertex", "name") == [(1, "Ana"), (2, "José Silva")]
    assert text.resolve(names, "Ana", 2) == 1 and [r.vertex for r in text.search_names(names, "silva JOSE").collect()] == [2]
    with pytest.raises(GraphError):
        text.resolve(names, "jose", 2)
    assert text.named_path(names, [2, 9]) == ["José Silva", "9"]
    for body, kind, line in [("1,A\noops\n2,B", "InvalidLine", 2), ("1,A\nx,B", "InvalidLine", 2), ("id,name\n1,A\n0,B", "InvalidLine", 3), ("1,A\n\n2;B\n1 C", "DuplicateVertex", 4), ("3,A\n4", "InvalidLine", 2)]:
        e = pytest.raises(ParseError, text.parse_names, lines(spark, body)).value
        assert (e.kind, e.line) == (kind, line), body
    assert got(text.parse_names(lines(spark, "\ufeff12\n1\tAna b \r\n\n 2 , B")), "vertex", "name") == [(1, "Ana b"), (2, "B")]
    pairs = lambda rows: text.names_of(spark.createDataFrame(rows, "vertex long, name string").coalesce(1))
    assert got(pairs([(2, "x"), (1, "y")]), "vertex", "name") == [(1, "y"), (2, "x")]
    assert [pytest.raises(ParseError, pairs, rows).value.kind for rows in ([(0, "x")], [(1, "x"), (1, "y")], [(1, "")])] == ["InvalidLine", "DuplicateVertex", "InvalidLine"]
    assert text.looks_like_names("2\n1,Ana\n2,B\n") and not text.looks_like_names("3\n1 2 0.5\n2 3 1\n")


def test_papers(spark):
    from arcwright.operators import collaboration as co

    rows = [(1, 1990, ["Uma", " Ravi "]), (2, 1997, ["Uma", "Ravi", "Li", "Li", " "]), (3, None, ["Zoe", "Uma"]), (4, 1991, ["Solo"]), (5, 1997, ["Noor", "Uma"])]
    p = spark.createDataFrame(rows, "paper_id long, year int, authors array<string>")
    numbers = co.numbering(p)
    assert [r.name for r in numbers.orderBy("vertex").collect()] == ["Ravi", "Uma", "Li", "Noor", "Zoe"]
    terms = co.terms(p, numbers)
    assert got(co.edges(terms), "u", "v", "weight") == [(1, 2, 0.5), (1, 3, 1.0), (2, 3, 1.0), (2, 4, 1.0), (2, 5, 1.0)]
    assert got(co.edges(terms, 1990), "u", "v", "weight") == [(1, 2, 1.0)]
    assert co.vertex_count(numbers, 1990) == 2 and co.name_of(numbers, 3) == "Li" and co.name_of(numbers, 9) is None and got(co.names(numbers, 1997), "vertex") == [(1,), (2,), (3,), (4,)]
    assert got(co.counts(terms, numbers, 1997), "vertices", "edges", "pairs") == [(4, 4, 5)]
    whole, named = co.built(co.strengths(terms).where("v > 2"), co.names(numbers), compacted=True)
    assert whole.n == 5 and got(named, "vertex", "name")[0] == (1, "Ravi")
    some, named = co.built(co.strengths(terms).where("u = 2 and v > 3"), co.names(numbers), compacted=True)
    assert some.n == 3 and got(some.edges, "u", "v") == [(1, 2), (1, 3)] and got(named, "vertex", "name") == [(1, "Uma"), (2, "Noor"), (3, "Zoe")]
    assert got(co.rebuilt(co.strengths(terms)), "u", "v", "weight") == got(co.edges(terms), "u", "v", "weight")


def test_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_bytes("<?xml version='1.0' encoding='ISO-8859-1'?><root><article key='a'><author>J&#246;rg &amp; Co</author><author>M\xfcller</author><year>2001</year></article><article key='b' publtype='informal'><author>X</author><author>Y</author><year>20011</year></article></root>".encode("latin-1"))
    p = text.bibliography(spark, str(tmp_path / "d.xml"), records=["article"])
    assert {(r.year, tuple(r.authors)) for r in p.collect()} == {(None, ("X", "Y")), (2001, ("Jörg & Co", "Müller"))}
    assert text.bibliography(spark, str(tmp_path / "d.xml"), formal_only=True, records=["article"]).count() == 1
    (tmp_path / "u.xml").write_text("<root><book key='c'><author>Zoë</author><author>Y</author><year>1999</year></book></root>", encoding="utf-8")
    assert not text.declares_latin1(spark, str(tmp_path / "u.xml")) and [r.authors for r in text.bibliography(spark, str(tmp_path / "u.xml")).collect()] == [["Zoë", "Y"]]


def test_stream(spark, tmp_path):
    from arcwright.streaming.strengths import stream

    def run(folder, name):
        q = stream(spark, str(folder)).writeStream.outputMode("complete").format("memory").queryName(name).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    good, bad = tmp_path / "good", tmp_path / "bad"
    for folder, second in ((good, "1 2 3\n"), (bad, "1 2 3\nx 2 3\n")):
        folder.mkdir()
        (folder / "strengths_2000.txt").write_text("1 2 1\n1 3 2\n")
        (folder / "strengths_2001.txt").write_text(second)
    run(good, "net")
    assert {(r.u, r.v): r.weight for r in spark.table("net").collect()} == {(1, 2): 0.25, (1, 3): 0.5}
    assert got(text.strengths(spark, str(good)), "u", "v", "year", "papers") == [(1, 2, 2000, 1.0), (1, 2, 2001, 3.0), (1, 3, 2000, 2.0)]
    e = pytest.raises(ParseError, text.strengths, spark, str(bad)).value
    assert (e.kind, e.line) == ("InvalidStrength", 2)
    with pytest.raises(Exception, match="InvalidStrength"):
        run(bad, "net2")


def test_number_text(spark):
    from arcwright.functions import text as ft

    x = [1.0, 0.1, 1e-7, -1.25e-9, 1e39, 1.5e300, 123456789012345680.0, -2.5e15, 1.25e7, 0.0, 12345678.9, float("inf")]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    from decimal import Decimal

    made = {r.x: r.t for r in df.select("x", ft.plain_double(F.col("x")).alias("t")).collect()}
    assert made[float("inf")] == "inf" and made[1e-7] == "0.0000001" and made[1e39] == "1" + "0" * 39
    for v in x[:-1]:
        assert Decimal(made[v]) == Decimal(repr(v)) and "E" not in made[v] and ft.plain(v) == made[v]
    fifteen = {r.x: r.t for r in spark.createDataFrame([(1 / 3,), (2.0,), (0.5,), (1 / 7000,)], "x double").select("x", ft.fifteen_digits(F.col("x")).alias("t")).collect()}
    assert fifteen == {1 / 3: "0.333333333333333", 2.0: "2", 0.5: "0.5", 1 / 7000: "0.000142857142857143"}
    assert [r.d for r in spark.createDataFrame([(0,), (86_399,), (951_782_400,), (-1,)], "s long").select(ft.date_of(F.col("s")).alias("d")).collect()] == ["1970-01-01", "1970-01-01", "2000-02-29", "1969-12-31"]
    assert spark.range(1).select(ft.fixed(F.lit(2.5), 3), ft.as_json(F.lit(None).cast("int").alias("a"), F.lit("x").alias("b"))).first() == ("2.500", '{"a":null,"b":"x"}')
    assert [ft.human_bytes(n) for n in (999, 1000, 2_500_000)] == ["999 B", "1.00 kB", "2.50 MB"] and [ft.human_duration(s) for s in (5e-5, 0.25, 3, 90)] == ["50.0 µs", "250.00 ms", "3.00 s", "1.5 min"]
    assert [ft.human_weight(w) for w in (9.735999999999999, -0.0, 2.0, None)] == ["9.736", "0", "2", "∞"]
    ft.register(spark)
    assert spark.sql("SELECT fold_name('Éva Ö'), name_matches('Éva Öz', 'oz eva'), digits(120)").first() == ("eva o", True, 3)


def test_representations(spark):
    g = graph(spark, 70, [(1, 2, 0.5), (1, 66, 2.0), (66, 2, 1.0)], True)
    assert [(r.v, r.neighbours, r.weights) for r in rp.represent(g, "list").orderBy("v").limit(2).collect()] == [(1, [2, 66], [0.5, 2.0]), (2, [], [])]
    bits = rp.represent(g, "matrix")
    assert rp.has_bit(bits, 1, 66) and rp.has_bit(bits, 66, 2) and not rp.has_bit(bits, 2, 66)
    assert got(rp.represent(g, "csr").where("v in (1, 66, 70)"), "v", "begin", "end") == [(1, 0, 2), (66, 2, 3), (70, 3, 3)] and got(rp.targets(g), "at", "dst") == [(0, 2), (1, 66), (2, 2)]
    assert got(rp.drawing_rows(g).where("v in (1, 2)"), "v", "begin", "neighbours") == [(1, 0, [2, 66]), (2, 2, [1, 66])]
    with pytest.raises(OverBudget):
        rp.represent(g, "matrix", budget=100)
    assert rp.represent(g, "adjacency-matrix", budget=rp.UNLIMITED).count() == 3 and rp.machine_bytes() > 0 and rp.process_bytes()["resident"] > 0
    s = got(rp.report(g), "list", "matrix", "csr")[0]
    assert all(s[i] == rp.required_bytes(g, k) for i, k in enumerate(rp.KINDS))


def test_random_numbers(spark):
    from arcwright.sources.text import SplitMix64

    # The first numbers of the public generator, of seed 1234567
    assert [SplitMix64(1234567).next()] + [0] == [6457827717110365317, 0]
    drawn = SplitMix64(5).vertices(10, 99)
    assert sorted(drawn) == list(range(1, 11)) and SplitMix64(5).vertices(10, 4) == drawn[:4]
    g = text.random_graph(spark, 50, 200, 3, 1.0, 2.0)
    r = g.edges.agg(F.min("u"), F.max("v"), F.min("weight"), F.max("weight")).first()
    assert 1 <= r[0] and r[1] <= 50 and 1 <= r[2] and r[3] < 2 and got(g.edges, "u", "v") == got(text.random_graph(spark, 50, 200, 3, 1.0, 2.0).edges, "u", "v")
    p = text.potential_graph(spark, 40, 120, 2)
    assert p.edges.where("weight < 0").count() and ps.negative_cycle(p) is None
    found = ps.negative_cycle(text.potential_graph(spark, 60, 120, 2, [41, 42, 43]))
    assert found is not None and found.weight < 0


def test_sinks(spark, tmp_path):
    g = graph(spark, 4, [(1, 2, 0.5), (2, 3, 2.0), (3, 3, -1.0)], True)
    shown = []
    sinks.print_lines(sinks.summary_lines(g), shown.append)
    assert shown == ["directed", "vertices 4", "arcs 2", "out_degree_min 0", "out_degree_max 1", "out_degree_mean 0.500", "out_degree_median 0.5", "in_degree_min 0", "in_degree_max 1", "in_degree_mean 0.500", "in_degree_median 0.5", "weight_min 0.5", "weight_max 2", "weight_mean 1.250000", "weight_negative 0", "weak_components 2", "# negative loop 3 -1", "# component size vertices...", "1 3 1 2 3", "2 1 4"]
    lines_ = lambda x: [r.line for r in x.orderBy("part", "at").collect()]
    assert lines_(sinks.strong_lines(g)) == ["strong_components 4", "1 1 1", "2 1 4", "3 1 2", "4 1 3"]
    plain = Graph(g.edges, g.n, True, True)
    assert lines_(sinks.all_pairs_tree_lines(plain, ps.floyd_warshall(plain), 1)) == ["# root 1", "# vertex parent distance", "1 0 0", "2 1 0.5", "3 2 2.5", "4 - -"]
    to = sinks.tree_lines(ps.bellman_ford_to(plain, 3), plain, 3, toward=True)
    assert lines_(to) == ["# target 3", "# vertex successor distance", "1 2 2.5", "2 3 2", "3 0 0", "4 - -"]
    assert lines_(sinks.line_range(sinks.edge_lines(g), 2, 3)) == ["1 2 0.5", "2 3 2"]
    sinks.write_pieces(sinks.edge_lines(graph(spark, 30, [(i, i + 1) for i in range(1, 30)])).coalesce(1), str(tmp_path / "pieces"), 7)
    sizes = [len(f.read_text().split("\n")) - 1 for f in sorted((tmp_path / "pieces").glob("part-*"))]
    assert sum(sizes) == 30 and max(sizes) <= 7
    labels = spark.range(1, 120_001).select(F.lit(1).cast("long").alias("component"), F.col("id").alias("v"))
    assert lines_(sinks.component_lines(labels))[1] == "1 120000 " + " ".join(map(str, range(1, 120_001)))


def test_site(spark, tmp_path):
    from arcwright.operators import collaboration as co

    p = spark.createDataFrame([(1, 1990, ["Uma", "Ravi"]), (2, 1992, ["Uma", "Li"]), (3, None, ["Li", "Zoe"])], "paper_id long, year int, authors array<string>")
    numbers = co.numbering(p)
    made = sinks.site(co.terms(p, numbers), numbers, str(tmp_path / "site"))
    assert got(made, "year", "vertices", "new_pairs", "edges") == [(1990, 2, 1, 1), (1991, 2, 0, 1), (1992, 4, 2, 3)]
    assert got(spark.read.json(str(tmp_path / "site" / "manifest")), "year") == [(1990,), (1991,), (1992,)]
    assert [r[0] for r in spark.read.text(str(tmp_path / "site" / "strengths" / "year=1990")).collect()] == ["1 2 1"]
    up = sinks.up_to(made, 1991).first()
    assert up.years == [1990, 1991] and up.bytes == len("1 2 1\n") + len("1,Ravi\n2,Uma\n")


def test_command_line(spark, tmp_path):
    import json

    from arcwright.cli import main

    (tmp_path / "g.txt").write_text("4\n1 2 0.5\n2 3 2\n1 3 4\n")
    (tmp_path / "c.txt").write_text("3\n1 2 1\n2 3 -4\n3 1 2\n")
    (tmp_path / "n.csv").write_text("1,Ana\n2,Bea\n3,Cy\n")
    graph_, cyclic, names, out = str(tmp_path / "g.txt"), str(tmp_path / "c.txt"), str(tmp_path / "n.csv"), iter(range(99))

    def run(*argv, status=0):
        shown = []
        assert main([*argv, "-q", "-o", str(tmp_path / f"out{next(out)}")], spark, shown.append) == status
        return shown

    assert run("info", graph_)[:2] == ["vertices 4", "edges 3"]
    assert run("bfs", graph_, "1") == ["root 1 reached 3 depth 1 last 3"] and run("dfs", graph_, "1") == ["root 1 reached 3 depth 2 last 3"]
    run("dfs", graph_, "1", "--recursive", "--max-depth", "1", status=1)
    assert run("distance", graph_, "--pair", "1", "3", "1", "4", "--path") == ["1 3 2.5 1 2 3", "1 4 inf"] and run("distance", graph_, "--pair", "Ana", "3", "--hops", "--names", names) == ["1 3 1"]
    assert run("diameter", graph_)[0].startswith("diameter 1 method ifub exact true")
    assert run("components", graph_) == ["components 2 largest 3 smallest 1"] and run("scc", cyclic, "-D", "--condensation", str(tmp_path / "cond")) == ["strong_components 1 largest 3 acyclic false"]
    assert run("dijkstra", graph_, "--from", "1", "--to", "3", "4") == ["1 3 2.5 1 2 3", "1 4 inf"]
    assert json.loads("".join(run("dijkstra", graph_, "--from", "1", "--to", "3", "--json")))[0]["path"] == [1, 2, 3]
    assert run("bellman-ford", graph_, "-D", "--to", "3", "--from", "1") == ["1 3 2.5 1 2 3"] and run("bellman-ford", graph_, "-D", "--negative-cycle") == ["negative-cycle none"]
    assert run("bellman-ford", cyclic, "-D", "--to", "3", status=1) == ["negative-cycle -1 1 2 3"] == run("bellman-ford", cyclic, "-D", "--negative-cycle", status=1)
    for name in ("floyd-warshall", "johnson"):
        assert run(name, graph_, "--pairs", "1", "3", "4") == ["from\\to 1 3 4", "1 0 2.5 inf", "3 2.5 0 inf", "4 inf inf 0"]
    assert run("floyd-warshall", graph_, "--trees", str(tmp_path / "trees")) and len(list((tmp_path / "trees").iterdir())) == 4
    assert run("bench", graph_, "-n", "2")[0].startswith("bfs list runs 2 mean_ms") and run("memory", graph_)[0].startswith("list ")
    assert run("generate", "20", "30", "--weights", "1", "2")[0].startswith("vertices 20 edges ")
    (tmp_path / "d.xml").write_text("<root><article key='a'><author>A</author><author>B</author><year>2001</year></article></root>")
    assert run("papers", str(tmp_path / "d.xml"), "--by-year") == ["papers 1 largest_paper 2 authors 2"]
    assert [x.split()[0] for x in run("study", graph_, "--parts", "summary", "bfs")] == ["summary", "bfs"]
    run("bfs", graph_, "Nobody", status=1)


def test_visitor(spark):
    g, seen = graph(spark, 6, RING), []

    class Watch(tr.Visitor):
        def discover(self, v, parent, level):
            seen.append((v, parent, level))

        def level_complete(self, level):
            seen.append(f"level {level}")
            return level < 1

    tr.walk(tr.bfs(g, 1), Watch())
    assert seen == [(1, None, 0), "level 0", (4, 1, 1), (5, 1, 1), "level 1"]
    levels = []
    tr.bfs(g, 1, visit=lambda level, front: levels.append((level, front.count())) or level < 2)
    assert levels == [(0, 1), (1, 2), (2, 1)]


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())

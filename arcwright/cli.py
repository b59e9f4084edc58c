"""Command line: `python -m arcwright <command> ...`.

Answers go to standard output as plain lines, or as JSON with --json; notes for people go to standard error unless --quiet.
Files are written as folders of text, as Spark writes them. A refusal ends with status 1.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from arcwright.functions.text import human_bytes, human_duration, human_weight, plain
from arcwright.model import Graph, GraphError, NegativeCycle, STRATEGIES
from arcwright.operators import components, diameter, paths, representation, stats, strong, traversal
from arcwright.plans.loops import cut
from arcwright.plans.shipping import ship
from arcwright.sources import sinks, text


class Run:
    """What every command has at hand."""

    def __init__(self, args: argparse.Namespace, spark: SparkSession, show):
        self.args, self.spark, self.show = args, spark, show

    def note(self, line: str) -> None:
        if not self.args.quiet:
            print(line, file=sys.stderr)

    def graph(self) -> Graph:
        a = self.args
        g = text.edge_list(self.spark, a.graph, a.directed)
        kind = g.edges
        g = Graph(cut(kind), g.n, g.directed, g.weighted, g.negative_loops)
        if not a.force:
            representation.check_budget(representation.required_bytes(g, a.repr), representation.MACHINE)
        self.note(f"{g.n} vertices, {g.edge_count} {'arcs' if g.directed else 'edges'}")
        return g

    def names(self):
        return text.names(self.spark, self.args.names) if self.args.names else None

    def vertex(self, g: Graph, names, shown: str) -> int:
        if names is None:
            if not shown.isdigit():
                raise GraphError(f"{shown!r} is no vertex, and there are no names")
            return g.check(int(shown))
        return text.resolve(names, shown, g.n)

    def shown(self, names, vertices: list[int]) -> str:
        return " > ".join(text.named_path(names, vertices) if names is not None else map(str, vertices))

    def write(self, lines, suffix: str) -> None:
        to = self.args.output or f"{Path(self.args.graph).stem}-{suffix}"
        sinks.write(lines, to)
        self.note(f"wrote {to}")

    def say(self, made, lines: list[str]) -> None:
        """JSON of what was found, or its lines."""
        for line in [json.dumps(made, indent=2)] if self.args.json else lines:
            self.show(line)


def info(r: Run) -> None:
    g = r.graph()
    lines = sinks.summary_lines(g)
    head = [x.line for x in lines.where("part = 0").orderBy("at").collect()]
    r.say(dict(x.partition(" ")[::2] for x in head), head)
    r.write(lines, "summary.txt")


def bfs(r: Run) -> None:
    g = r.graph()
    root = r.vertex(g, r.names(), r.args.root)
    if r.args.command == "dfs":
        tree = cut(traversal.dfs(g, root, r.args.max_depth if r.args.recursive else None))
    else:
        tree = cut(traversal.bfs(g, root))
    last = tree.agg(F.count("*").alias("reached"), F.max("level").alias("depth"), F.max_by("v", "rank").alias("last")).first()
    r.say({"root": root, **last.asDict()}, [f"root {root} reached {last.reached} depth {last.depth} last {last['last']}"])
    r.write(sinks.tree_lines(tree, g, root), f"{r.args.command}-{root}.txt")


def distance(r: Run) -> None:
    g, names, found, lines = r.graph(), r.names(), [], []
    for a, b in zip(r.args.pair[::2], r.args.pair[1::2]):
        u, v = r.vertex(g, names, a), r.vertex(g, names, b)
        way = None
        if g.weighted and not r.args.hops:
            way = paths.shortest_path(g, u, v)
        else:
            vertices = traversal.path(cut(traversal.bfs(g, u, until={v})), v)
            way = (len(vertices) - 1, vertices) if vertices else None
        found.append({"from": u, "to": v, "distance": way and way[0], "path": way[1] if way else []})
        lines.append(f"{u} {v} inf" if way is None else f"{u} {v} {plain(float(way[0]))}" + (f" {' '.join(map(str, way[1]))}" if r.args.path else ""))
        r.note(f"d({u}, {v}) = {human_weight(way and float(way[0]))}  {r.shown(names, way[1]) if way and r.args.path else ''}")
    r.say(found, lines)


def diameter_(r: Run) -> None:
    g, start = r.graph(), time.monotonic()
    d = diameter.diameter(g, r.args.method, r.args.budget)
    took = time.monotonic() - start
    a, b = d.endpoints
    made = {"value": d.value, "method": d.method, "is_exact": d.is_exact, "bfs_count": d.searches, "endpoints": [a, b], "elapsed_ms": took * 1000}
    r.say(made, [f"diameter {d.value} method {d.method} exact {str(d.is_exact).lower()} bfs_runs {d.searches} endpoints {a} {b} elapsed_ms {took * 1000:.3f}"])


def components_(r: Run) -> None:
    g = r.graph()
    labels = cut(components.components(g))
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).agg(F.count("*").alias("components"), F.max("size").alias("largest"), F.min("size").alias("smallest")).first()
    r.say(sizes.asDict(), [f"components {sizes.components} largest {sizes.largest} smallest {sizes.smallest}"])
    r.write(sinks.component_lines(labels), "components.txt")


def scc(r: Run) -> None:
    g = r.graph()
    ids = cut(strong.component_ids(g))
    sizes = ids.groupBy("component").agg(F.count("*").alias("size")).agg(F.count("*").alias("components"), F.max("size").alias("largest")).first()
    r.say({**sizes.asDict(), "acyclic": sizes.largest == 1}, [f"strong_components {sizes.components} largest {sizes.largest} acyclic {str(sizes.largest == 1).lower()}"])
    r.write(sinks.component_lines(ids, "strong_components"), "scc.txt")
    if r.args.condensation:
        small = strong.condensation(g, ids.withColumnRenamed("component", "scc")).withColumn("weight", F.lit(1.0))
        sinks.write(sinks.edge_lines(Graph(small, sizes.components, True)), r.args.condensation)


def _answers(r: Run, found: list[dict], names) -> None:
    lines = [f"{x['from']} {x['to']} " + ("inf" if x["distance"] is None else f"{plain(x['distance'])} {' '.join(map(str, x['path']))}") for x in found]
    for x in found:
        r.note(f"d({x['from']}, {x['to']}) = {human_weight(x['distance'])}  {r.shown(names, x['path'])}")
    r.say(found, lines)


def dijkstra(r: Run) -> None:
    g, names = r.graph(), r.names()
    root, made = r.vertex(g, names, getattr(r.args, "from")), []
    tree = cut(paths.dijkstra(g, root, r.args.frontier))
    for shown in r.args.to:
        v = r.vertex(g, names, shown)
        at = tree.where(F.col("v") == v).first()
        made.append({"from": root, "to": v, "distance": at and at.distance, "path": traversal.path(tree, v)})
    _answers(r, made, names)
    r.write(sinks.tree_lines(tree, g, root), f"dijkstra-{root}.txt")


def _cycle(r: Run, e: NegativeCycle, names) -> None:
    r.note(f"negative cycle of {len(e.cycle)} arc(s), weight {human_weight(e.weight)}: {r.shown(names, [*e.cycle, e.cycle[0]])}")
    r.say({"cycle": e.cycle, "weight": e.weight}, [f"negative-cycle {plain(e.weight)} {' '.join(map(str, e.cycle))}"])


def bellman_ford(r: Run) -> None:
    g, names = r.graph(), r.names()
    if r.args.negative_cycle:
        found = paths.negative_cycle(g)
        if found is None:
            return r.say(None, ["negative-cycle none"])
        _cycle(r, found, names)
        raise GraphError("the graph has a negative cycle")
    if not r.args.to:
        raise GraphError("--to or --negative-cycle is needed")
    target, made = r.vertex(g, names, r.args.to), []
    try:
        tree = cut(paths.bellman_ford_to(g, target, r.args.schedule))
    except NegativeCycle as e:
        _cycle(r, e, names)
        raise GraphError(f"a negative cycle reaches {target}: no shortest path to it is defined") from None
    for shown in getattr(r.args, "from"):
        v = r.vertex(g, names, shown)
        at = tree.where(F.col("v") == v).first()
        made.append({"from": v, "to": target, "distance": at and at.distance, "path": traversal.path(tree.withColumnRenamed("successor", "parent"), v)[::-1]})
    _answers(r, made, names)
    r.write(sinks.tree_lines(tree, g, target, toward=True), f"bellman-ford-to-{target}.txt")


def all_pairs(r: Run) -> None:
    g, names = r.graph(), r.names()
    budget = paths.UNLIMITED if r.args.force else None
    pairs = cut(paths.floyd_warshall(g, r.args.sweep, budget) if r.args.command == "floyd-warshall" else paths.johnson(g, r.args.frontier, budget))
    chosen = [r.vertex(g, names, x) for x in r.args.pairs]
    table = paths.pair_table(pairs, chosen)
    lines = [" ".join(["from\\to", *map(str, chosen)])] + [" ".join([str(i), *("inf" if d is None else plain(d) for d in row)]) for i, row in zip(chosen, table)]
    r.say({"vertices": chosen, "distances": table}, lines)
    if r.args.trees:
        trees = cut(paths.predecessors(g, pairs))
        for i in range(1, g.n + 1):
            own = trees.where(F.col("src") == i).select("v", "parent", "distance")
            sinks.write(sinks.tree_lines(own, g, i), f"{r.args.trees}/{r.args.command}-{i}.txt")


def bench(r: Run) -> None:
    g = r.graph()
    roots = text.SplitMix64(r.args.seed).vertices(g.n, r.args.runs)
    search = {"bfs": traversal.bfs, "dfs": traversal.dfs, "dijkstra": paths.dijkstra}[r.args.algorithm]
    samples = []
    for root in roots:
        start = time.monotonic()
        search(g, root).agg(F.count("*")).first()
        samples.append((time.monotonic() - start) * 1000)
    t = stats.timing(r.spark.createDataFrame([(x,) for x in samples], "value double")).first()
    made = {"runs": t.n, "mean_ms": t["mean"], "median_ms": t["median"], "min_ms": t["min"], "max_ms": t["max"], "stddev_ms": t.stddev, "total_ms": t.total}
    r.say(made, [f"{r.args.algorithm} {r.args.repr} runs {t.n} mean_ms {t['mean']:.4f} median_ms {t['median']:.4f} min_ms {t['min']:.4f} max_ms {t['max']:.4f}"])


def memory(r: Run) -> None:
    g = r.graph()
    sizes = representation.report(g).first().asDict()
    made = {**sizes, **{f"process_{k}": v for k, v in representation.process_bytes().items()}}
    r.say(made, [f"{k} {v} {human_bytes(v)}" for k, v in made.items()])


def generate(r: Run) -> None:
    a = r.args
    low, high = a.weights or (None, None)
    if a.potential:
        g = text.potential_graph(r.spark, a.vertices, a.edges, a.seed, a.cycle)
    else:
        g = text.random_graph(r.spark, a.vertices, a.edges, a.seed, low, high, a.directed)
    sinks.write(sinks.edge_lines(g), a.output)
    r.say({"vertices": g.n, "edges": g.edge_count}, [f"vertices {g.n} edges {g.edge_count}"])


def papers(r: Run) -> None:
    from arcwright.operators import collaboration as co

    a = r.args
    found = cut(text.bibliography(r.spark, a.graph, a.formal_only))
    numbers = cut(co.numbering(found))
    terms = cut(co.terms(found, numbers))
    counted = co.counters(found).first()
    sinks.write(sinks.network_lines(co.edges(terms, a.until), co.vertex_count(numbers, a.until)), f"{a.output}/network")
    sinks.write(sinks.name_lines(co.until(numbers, a.until, "first_year")), f"{a.output}/names")
    if a.by_year:
        sinks.site(terms, numbers, f"{a.output}/site")
    r.say(counted.asDict(), [" ".join(f"{k} {v}" for k, v in counted.asDict().items())])


#: Parts of a study of one graph, in order.
STUDY = ["summary", "degrees", "weights", "components", "strong", "hub", "bfs", "dfs", "dijkstra", "bellman-ford", "diameter", "memory"]


def study(r: Run) -> None:
    """Measures parts of a study, keeps those of an earlier one, and writes both JSON and a table for people."""
    a, g = r.args, r.graph()
    to = Path(a.output or f"{Path(a.graph).stem}-study.json")
    made = json.loads(to.read_text()) if to.exists() else {}
    row = lambda df: df.first().asDict()
    hub = stats.hub(g).first().v

    def tree(f):
        return lambda: row(f(g, hub).agg(F.count("*").alias("reached")))

    does = {
        "summary": lambda: row(stats.summary(g)),
        "degrees": lambda: row(stats.degree_stats(g)),
        "weights": lambda: row(stats.weight_stats(g)) if g.weighted else {},
        "components": lambda: row(components.component_sizes(g).agg(F.count("*").alias("components"), F.max("size").alias("largest"))),
        "strong": lambda: {"largest": strong.largest_size(g)},
        "hub": lambda: {"vertex": hub},
        "bfs": tree(traversal.bfs),
        "dfs": tree(traversal.dfs),
        "dijkstra": tree(paths.dijkstra),
        "bellman-ford": tree(paths.bellman_ford),
        "diameter": lambda: vars(diameter.diameter(g, "sweep" if g.directed else "ifub", a.budget)),
        "memory": lambda: row(representation.report(g)),
    }
    for part in a.parts or STUDY:
        if part in made and not a.again:
            continue
        start = time.monotonic()
        try:
            found = does[part]()
        except GraphError as e:
            found = {"refused": str(e)}
        made[part] = {**found, "seconds": round(time.monotonic() - start, 3)}
    to.write_text(json.dumps(made, indent=2))
    rows = [f"| {part} | {key} | {human_duration(x) if key == 'seconds' else x} |" for part in STUDY if part in made for key, x in made[part].items()]
    to.with_suffix(".md").write_text("\n".join([f"# {Path(a.graph).name}", "", "| part | figure | value |", "|-|-|-|", *rows, ""]))
    r.say(made, [f"{part} {made[part]['seconds']}" for part in STUDY if part in made])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arcwright")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, does, graph: bool = True):
        p = commands.add_parser(name, help=does.__doc__)
        if graph:
            p.add_argument("graph")
            p.add_argument("-r", "--repr", type=lambda x: x if x in STRATEGIES["storage"] else parser_error(x), default="list")
            p.add_argument("--force", action="store_true", help="go beyond this machine's memory")
            p.add_argument("-D", "--directed", action="store_true")
            p.add_argument("--names")
        p.add_argument("--threads", default="*")
        p.add_argument("-q", "--quiet", action="store_true")
        p.add_argument("--json", action="store_true")
        p.add_argument("-o", "--output")
        p.set_defaults(does=does)
        return p

    def parser_error(x):
        raise argparse.ArgumentTypeError(f"{x!r} is none of {', '.join(sorted(STRATEGIES['storage']))}")

    add("info", info)
    for name in ("bfs", "dfs"):
        p = add(name, bfs)
        p.add_argument("root")
        p.add_argument("--recursive", action="store_true")
        p.add_argument("--max-depth", type=int, default=2500)
    p = add("distance", distance)
    p.add_argument("--pair", nargs="+", required=True)
    p.add_argument("--hops", action="store_true")
    p.add_argument("--path", action="store_true")
    p = add("diameter", diameter_)
    p.add_argument("-m", "--method", default="ifub")
    p.add_argument("--budget", type=float)
    add("components", components_)
    add("scc", scc).add_argument("--condensation")
    p = add("dijkstra", dijkstra)
    p.add_argument("--from", required=True)
    p.add_argument("--to", nargs="*", default=[])
    p.add_argument("-f", "--frontier", default="heap")
    p = add("bellman-ford", bellman_ford)
    p.add_argument("--to")
    p.add_argument("--from", nargs="*", default=[])
    p.add_argument("--negative-cycle", action="store_true")
    p.add_argument("-s", "--schedule", default="queue")
    for name in ("floyd-warshall", "johnson"):
        p = add(name, all_pairs)
        p.add_argument("--pairs", nargs="+", default=[])
        p.add_argument("--sweep", default="plain")
        p.add_argument("-f", "--frontier", default="heap")
        p.add_argument("--trees")
    p = add("bench", bench)
    p.add_argument("-a", "--algorithm", choices=["bfs", "dfs", "dijkstra"], default="bfs")
    p.add_argument("-n", "--runs", type=int, default=10)
    p.add_argument("--seed", type=int, default=1)
    add("memory", memory)
    p = add("generate", generate, graph=False)
    p.add_argument("vertices", type=int)
    p.add_argument("edges", type=int)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("-D", "--directed", action="store_true")
    p.add_argument("--weights", nargs=2, type=float)
    p.add_argument("--potential", action="store_true")
    p.add_argument("--cycle", nargs="*", type=int)
    p = add("papers", papers)
    p.add_argument("--formal-only", action="store_true")
    p.add_argument("--until", type=int)
    p.add_argument("--by-year", action="store_true")
    p = add("study", study)
    p.add_argument("--parts", nargs="*", choices=STUDY)
    p.add_argument("--again", action="store_true")
    p.add_argument("--budget", type=float)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, show=print) -> int:
    args = parser().parse_args(argv)
    if args.command in ("generate", "papers") and not args.output:
        parser().error(f"{args.command} needs --output")
    if args.command == "distance" and len(args.pair) % 2:
        parser().error("--pair takes vertices by twos")
    spark = spark or SparkSession.builder.master(f"local[{args.threads}]").appName("arcwright").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        args.does(Run(args, ship(spark), show))
    except GraphError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0

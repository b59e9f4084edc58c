"""Graphs derived from the driver's tables, as SQL that Spark and the oracle both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcwright.model import Graph
from arcwright.plans.loops import cut
from arcwright.plans.shipping import ship


def copart(quantity: int) -> str:
    """Parts ordered together in lines of at least a quantity; papers: orders that have both."""
    return f"""pm AS (SELECT DISTINCT l_orderkey AS p, l_partkey + 1 AS a FROM lineitem WHERE l_quantity >= {quantity}),
    copart AS (SELECT x.a AS u, y.a AS v, CAST(count(*) AS BIGINT) AS papers FROM pm x JOIN pm y ON x.p = y.p AND x.a < y.a GROUP BY x.a, y.a)"""


#: Each line's part and the next of its order; loops and repetitions are left in.
NEXT = """nxt AS (SELECT l_partkey + 1 AS u, lead(l_partkey + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS v, l_quantity AS q FROM lineitem),
    raw AS (SELECT u, v, CAST(q - 25 AS DOUBLE) AS weight FROM nxt WHERE v IS NOT NULL)"""


def succ(quantity: int) -> str:
    """Parts that follow one another in an order, among its lines of at least a quantity."""
    order = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
    return f"""sn AS (SELECT l_partkey + 1 AS u, lead(l_partkey + 1) OVER (PARTITION BY l_orderkey ORDER BY {order}) AS v FROM lineitem WHERE l_quantity >= {quantity}),
    succ AS (SELECT DISTINCT u, v FROM sn WHERE v IS NOT NULL AND u <> v)"""


COPART_INT = "SELECT u, v, CAST(1 + (u * 7 + v * 13) % 9 AS DOUBLE) AS weight FROM copart"
SUCC_INT = "SELECT u, v, CAST((u * 7 + v * 13) % 9 + (u * 31) % 20 - (v * 31) % 20 AS DOUBLE) AS weight FROM succ"
PAPERS = "SELECT l_orderkey AS paper_id, l_partkey + 1 AS author, year(o_orderdate) AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45"

ALL_PAPERS = PAPERS.removesuffix(" WHERE l_quantity >= 45")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, ctes: str, select: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "part") if f" {t}" in ctes + select}
    sql = f"WITH {ctes} {select}" if ctes else select
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **used)


def parts(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "part").count()


def graph(spark: SparkSession, sf_dir: str, kind: str) -> Graph:
    name, _, weights = kind.partition("_")
    quantity = int(name[-2:])
    if name.startswith("copart"):
        select = COPART_INT if weights else "SELECT u, v, 1.0D / papers AS weight FROM copart"
        df, directed = rows(spark, sf_dir, copart(quantity), select), False
    else:
        df, directed = rows(spark, sf_dir, succ(quantity), SUCC_INT if weights else "SELECT u, v FROM succ"), True
    # every question joins the edges several times
    return Graph.of(cut(df), parts(spark, sf_dir), directed)

"""From raw rows (u, v[, weight]) to normalised edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_weight(df: DataFrame) -> DataFrame:
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in df.columns else F.lit(1.0)
    return df.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), weight.alias("weight"))


def oriented(rows: DataFrame, directed: bool) -> DataFrame:
    return rows if directed else rows.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight")


def edges(rows: DataFrame) -> DataFrame:
    """Without loops, the lightest of each pair."""
    return rows.where("u <> v").groupBy("u", "v").agg(F.min("weight").alias("weight"))


def negative_loops(rows: DataFrame) -> DataFrame:
    """(v, weight): the lightest negative loop of each vertex that has one."""
    return rows.where("u = v and weight < 0").groupBy("v").agg(F.min("weight").alias("weight"))


def dropped(rows: DataFrame) -> DataFrame:
    """One row: loops and duplicates that normalising drops."""
    pairs = rows.groupBy("u", "v").agg(F.count("*").alias("c"))
    loop = F.col("u") == F.col("v")
    return pairs.agg(
        F.coalesce(F.sum(F.when(loop, F.col("c"))), F.lit(0)).cast("long").alias("self_loops"),
        F.coalesce(F.sum(F.when(~loop, F.col("c") - 1)), F.lit(0)).cast("long").alias("duplicates"),
    )


def first_negative(edges_: DataFrame) -> DataFrame:
    """The negative edge that is first by (u, v); no row if there is none."""
    return edges_.where("weight < 0").orderBy("u", "v").limit(1)


def overflows(rows: DataFrame) -> bool:
    """Whether the weights of what is kept, negative loops included, add up beyond a double."""
    total = edges(rows).select("weight").union(negative_loops(rows).select("weight")).agg(F.sum(F.abs("weight"))).first()[0]
    return total is not None and total == float("inf")

"""Numbering rows of a large table by an order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arcwright.plans.loops import cut

_LOW = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with `name` = 1, 2, ... by `order`: ranges are sorted apart and shifted by the sizes of those before.

    The sizes, one row a partition, are all that is broadcast.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = cut(sorted_.withColumn("_part", F.shiftright("_at", 33).cast("int")))
    sizes = {r._part: r["n"] for r in sorted_.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return sorted_.withColumn(name, F.lit(1).cast("long")).drop("_at", "_part")
    rows, total = [], 0
    for part in sorted(sizes):
        rows.append((part, total))
        total += sizes[part]
    before = df.sparkSession.createDataFrame(rows, "_part int, _before long")
    return sorted_.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_LOW)) + 1).drop("_at", "_part", "_before")

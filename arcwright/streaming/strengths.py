"""Yearly strengths as they arrive: a running network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwright.sources.text import strength_of


def stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """(u, v, weight), updated as files of `u v strength` lines come into the folder; a line that is none stops the stream."""
    t = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder).where("value <> ''")
    made = strength_of("value")
    checked = F.when(made.isNull(), F.raise_error(F.concat(F.lit("InvalidStrength: "), "value"))).otherwise(made)
    rows = t.select(checked.alias("s")).select("s.u", "s.v", "s.papers")
    return rows.groupBy("u", "v").agg((F.lit(1.0) / F.sum("papers")).alias("weight"))

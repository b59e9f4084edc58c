"""Iteration support: lineage is cut with reliable checkpoints in the shared folder."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only where none is set and all runs on this machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="arcwright-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder and forget the lineage; survives the loss of executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_bare(df: DataFrame) -> DataFrame:
    """The same, and forgets what Spark inferred of the rows and how they are partitioned.

    For tables that are united with others of the same origin: Spark 4.1 may then look for attributes that a branch no longer has.
    """
    made = cut(df)
    session = made.sparkSession._jsparkSession
    return DataFrame(session.internalCreateDataFrame(made._jdf.queryExecution().toRdd(), made._jdf.schema(), False), made.sparkSession)


def clear(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and checkpoints of plans that are forgotten, which it does once the driver's JVM has collected them.

    Many short rounds leave many small files long before the driver's memory is full. What one call lets go of, the next one
    deletes, so loops call it again and again.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that is no longer read, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

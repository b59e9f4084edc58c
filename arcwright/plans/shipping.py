"""Makes this package importable on executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        package = Path(__file__).resolve().parents[1]
        made = shutil.make_archive(str(Path(tempfile.mkdtemp()) / package.name), "zip", package.parent, package.name)
        sc.addPyFile(made)
        _sent.add(sc.applicationId)
    return spark

"""Python workers must import this package, wherever the driver was started."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

import gleaner


def reachable(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the workers' path. On a cluster it's installed or sent along with --py-files."""
    root = str(Path(gleaner.__file__).resolve().parent.parent)
    own = spark.sparkContext.environment
    paths = [p for p in own.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        own["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark

"""What a session needs so that Python workers can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Puts the package's folder on the workers' PYTHONPATH; a cluster without that folder gets the package by --py-files.

    A Python worker has one core, so its matrix products get one thread: more would only wait for each other.
    """
    env = spark.sparkContext.environment
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark

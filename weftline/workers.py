"""Lets Python workers import this package wherever the driver was started."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


#: Allocators of the workers: they live on between tasks, and give freed memory back with these.
ALLOCATORS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576"}


def ship(spark: SparkSession) -> None:
    """Adds the package's folder to the workers' import path (on a cluster it has to be there too) and sets their allocators."""
    env = spark.sparkContext.environment
    for name, value in ALLOCATORS.items():
        env.setdefault(name, value)
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (path, ROOT) if x)

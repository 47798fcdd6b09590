"""Readers of the driver's Parquet tables; filters and columns reach the scan."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..workers import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a query writes, below the one that the cluster shares; a temporary one where all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="weftline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Written:
    """Tables that one operation writes below the shared folder and reads again; they go together, at the latest when Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.folder = spark, written_folder(spark, name)
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back, so that what made it isn't computed again."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """keep(), and how many rows were written."""
        seen = Observation()
        out = self.keep(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return out, seen.get.get("n") or 0

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended: the shared folder's owner clears it then
            self.drop()

    def drop(self, name: str = "") -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

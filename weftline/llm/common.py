"""What the operators of this subpackage share: scratch tables and worker set-up.

Scratch tables are Parquet folders under ``spark.checkpoint.dir`` (a folder that
the driver and all executors can reach), so a lost executor costs only the tasks
that were running: lineage is cut by a written table, never by cached blocks.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..workers import ship
from .words import trim


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all is one machine (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="weftline-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


#: Bytes of an Arrow batch that a Python worker gets, about, where a table is written.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get their rows in batches of BATCH_BYTES at most, one row at least."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name like ``name`` that none of the taken ones equals, whatever their case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables written to the shared folder; dropped by name, or when Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: what made it is done with, and its shuffle files can go."""
        path, schema = self.path(name), df.schema
        with small_batches(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def measured(self, df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
        """write(), and aggregates of df that are taken while it is written; those that saw no row are left out."""
        seen = Observation()
        out = self.write(df.observe(seen, *(m.alias(n) for n, m in measures.items())), name)
        return out, {n: v for n, v in seen.get.items() if v is not None}

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """write(), and how many rows were written."""
        out, seen = self.measured(df, name, n=F.count(F.lit(1)))
        return out, seen.get("n", 0)

    def sweep(self) -> None:
        """Has the driver collect its garbage: only then Spark deletes shuffle files of plans that are done with."""
        gc.collect()
        trim()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        try:
            sc = self.spark.sparkContext
            if sc._jsc is None:
                return
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended: the shared folder's owner clears it
            pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of a key filter, and how many of them one number holds: at most half a million numbers are broadcast, whatever the keys are.
SLOTS, WIDTH = 1 << 25, 64


def split_by_keys(rows: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the keys, rows that certainly have none), without a shuffle of rows.

    Keys are hashed to SLOTS bits, which are put together to numbers of WIDTH bits after combining in
    the tasks, and broadcast: SLOTS / WIDTH numbers at most. Of the rows that have none of n
    keys, a share of 1 - exp(-n / SLOTS) is let through: 3 percent at a million keys, 26 at
    ten million. Where there are many more keys than bits all rows may have one, and whoever
    joins them shuffles them all, with the same result.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.lit("slot"), F.col(c)), F.lit(SLOTS)).cast("int")
    bit = lambda c: F.pmod(slot(c), F.lit(WIDTH))
    group = lambda c: F.floor(slot(c) / WIDTH).cast("int")
    one = F.lit(1).cast("long")
    part, mask = fresh(rows.columns, "part"), fresh(rows.columns, "mask")
    masks = keys.select(group(key).alias(part), bit(key).alias("bit")).groupBy(part).agg(F.bit_or(F.call_function("shiftleft", one, F.col("bit"))).alias(mask))
    marked = rows.join(F.broadcast(masks), group(column) == F.col(part), "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col(mask), bit(column)).bitwiseAND(one) == 1, F.lit(False))
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)

"""Versions of a table that share what hasn't changed, and reuse of rows from the version before.

A table is kept in parts (a year, a bucket of keys). A version is a manifest with a row for each of its
parts: the folder that holds it, its number of rows and a digest of them. A commit
compares digests with those of the version before; parts that are the same are carried by
reference, only the others are written. The manifest is written last and the pointer moves
after it, so a reader sees all of a version or none, and a commit that fails leaves the
version before as it was.

A digest is made of the number of rows, an exclusive or and a sum of two 64-bit hashes of
them, so it combines in the tasks and doesn't depend on order or partitioning; columns of maps aren't
supported. Manifests have as many rows as there are parts, MOST_PARTS at most; they
are what the driver reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshot import current, put_text

MOST_PARTS = 10_000
MANIFEST = "part string, folder string, rows long, digest string, version string"


def digests(rows: DataFrame, part: str) -> DataFrame:
    """(part, rows, digest) of each part; equal rows in any order have equal digests."""
    own = F.struct(*[F.col(c) for c in rows.columns if c != part])
    a, b = F.xxhash64(F.lit("a"), own), F.xxhash64(F.lit("b"), own).cast("decimal(38,0)")
    found = rows.groupBy(part).agg(F.count("*").alias("rows"), F.bit_xor(a).alias("a"), F.sum(b).alias("b"))
    return found.select(part, "rows", F.concat_ws(":", F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).alias("digest"))


class Versions:
    """A table of versions below ``root``; ``part`` says which part a row is in (a null part is one of its own)."""

    def __init__(self, spark: SparkSession, root: str, part: Column):
        self.spark, self.root, self.part = spark, root.rstrip("/"), F.coalesce(part.cast("string"), F.lit("null"))

    def manifest(self, version: str | None = None) -> DataFrame | None:
        """The manifest of a version, by default of the published one; None before the first."""
        folder = f"{self.root}/manifests/{version}" if version else current(self.spark, f"{self.root}/manifests")
        return self.spark.read.schema(MANIFEST).parquet(folder) if folder else None

    def commit(self, rows: DataFrame, version: str) -> DataFrame:
        """Publishes rows as a version and returns its manifest; unchanged parts aren't written.

        ``rows`` is read twice, for digests and for what is written: it should be a table or cheap.
        """
        named = rows.withColumn("__part", self.part)
        made = digests(named, "__part").withColumnRenamed("__part", "part")
        before = self.manifest()
        if before is None:
            before = self.spark.createDataFrame([], MANIFEST)
        plan = made.join(before.select("part", "folder", F.col("digest").alias("old"), F.col("version").alias("written")), "part", "left")
        same = F.coalesce(F.col("digest") == F.col("old"), F.lit(False))
        folder = f"{self.root}/data/{version}-{uuid.uuid4().hex}"
        plan = plan.select("part", F.when(same, F.col("folder")).otherwise(F.lit(folder)).alias("folder"), "rows", "digest", F.when(same, F.col("written")).otherwise(F.lit(version)).alias("version"))
        to = f"{self.root}/manifests/{version}"
        plan.coalesce(1).write.mode("overwrite").parquet(to)
        plan = self.spark.read.schema(MANIFEST).parquet(to)
        changed = plan.where(F.col("folder") == folder).select(F.col("part").alias("__part"))
        if plan.limit(MOST_PARTS + 1).count() > MOST_PARTS:
            raise ValueError(f"a table has at most {MOST_PARTS} parts")
        if not changed.isEmpty():
            # the parts are a bounded list: rows of unchanged parts end at the scan's join; a large part goes to several files
            kept = named.join(F.broadcast(changed), "__part", "left_semi")
            kept.repartition("__part", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.partitionBy("__part").mode("overwrite").parquet(folder)
        put_text(self.spark, f"{self.root}/manifests/CURRENT", version)
        return plan

    def read(self, schema: str, version: str | None = None) -> DataFrame:
        """The rows of a version, by default of the published one; none before the first."""
        manifest = self.manifest(version)
        parts = [] if manifest is None else manifest.select("part", "folder").collect()  # at most MOST_PARTS
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [f"{r.folder}/__part={_escaped(r.part)}" for r in parts]
        return self.spark.read.schema(schema).parquet(*paths)


def _escaped(value: str) -> str:
    """A partition value as Spark writes it into a folder's name."""
    return "".join(f"%{ord(c):02X}" if c in '"#%\'*/:=?\\\x7f{[]^' or ord(c) < 32 else c for c in value)


def reuse(planned: DataFrame, previous: DataFrame, key: str, reusable: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of the version before that stand for planned keys, planned rows that have to be made anew)."""
    own = previous.where(reusable).join(planned.select(key).distinct(), key, "left_semi")
    return own, planned.join(own.select(key).distinct(), key, "left_anti")


def next_version(planned: DataFrame, made: DataFrame, previous: DataFrame, key: str, reusable: Column) -> DataFrame:
    """Rows of the next version: reused ones first, else those made anew; what is no longer planned goes."""
    kept, rest = reuse(planned, previous, key, reusable)
    return kept.unionByName(made.join(rest.select(key).distinct(), key, "left_semi"))

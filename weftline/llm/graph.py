"""Connected components of a link table by alternating large-star and small-star steps.

Every step is an aggregate with map-side combine and an equi-join, so a node with a
third of all links is split like any skewed join key; nothing is gathered to the
driver but a count and a checksum a round, taken while its table is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _step(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Edges (a, b) of longs to rows (node, component): component is the least node of it.

    Nulls and loops are ignored. Nodes without edges don't appear. No edges: no rows.
    """
    now = scratch.write(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, turn = None, 0
    while True:
        turn += 1
        nxt, seen = scratch.measured(_step(_step(now, True), False), f"{name}-{turn}", n=F.count(F.lit(1)), print=F.bit_xor(F.xxhash64("a", "b")))
        scratch.drop(f"{name}-{turn - 1}")
        now = nxt
        if seen == before or not seen.get("n"):
            break
        before = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

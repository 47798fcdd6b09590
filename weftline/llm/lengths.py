"""Operator 7: token counts from an exact histogram of encoded lengths.

Documents are encoded once and counted by length; a corpus has few distinct lengths
(n of them need n * n / 2 tokens), so everything else is computed on the histogram.
Suffix sums over it answer, for each length that occurs and each context limit that is
asked for, whether a document has that length or not: how
many documents fit, how many tokens they have, how many tokens remain if longer ones
are cut, and which quantile the length is. Sums run within ranges of lengths and over
the ranges' totals, so no task gets the whole histogram.

Defined results: null and empty texts have length 0; repeated rows count each time; an
empty table gives a row of zeros (and a null quantile) for each limit that is asked for; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read, ship
from .encoding import encoder
from .words import chunks

#: Context limits that the query answers beside the lengths that occur.
LIMITS = (512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072)
#: Lengths are summed in ranges of so many.
RANGE = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each document: its length in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_rows
        for _, data, offsets in chunks(batches, keep=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(encode(data, offsets)[1]))], ["length"])

    ship(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "length long")


def length_report(lengths: DataFrame, limits: Sequence[int] = ()) -> DataFrame:
    """For each length that occurs and each limit, as a context limit: the corpus below, at and above it.

    ``quantile`` is the share of documents that fit; ``at_quantiles`` looks lengths up by it.

    The histogram is a written table: lengths are computed once, though it is read thrice.
    """
    spark = lengths.sparkSession
    asked = spark.createDataFrame(pa.table({"length": pa.array([int(x) for x in limits], pa.int64()), "n_docs": pa.array([0] * len(limits), pa.int64())}))
    counted = lengths.groupBy("length").agg(F.count("*").alias("n_docs")).union(asked).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    histogram = counted.withColumn("range", F.floor(F.col("length") / RANGE))
    histogram = Scratch(lengths.sparkSession, "lengths").write(histogram, "histogram")
    totals = histogram.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"))
    over = Window.orderBy(F.desc("range"))  # one row for each range of lengths: the longest document bounds them
    above = totals.select("range", (F.sum("docs").over(over) - F.col("docs")).alias("docs_above"), (F.sum("tokens").over(over) - F.col("tokens")).alias("tokens_above"))
    all_ = totals.agg(F.sum("docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    within = Window.partitionBy("range").orderBy(F.desc("length"))
    rows = histogram.join(F.broadcast(above), "range").crossJoin(F.broadcast(all_))  # a row of totals
    longer = F.sum("n_docs").over(within) - F.col("n_docs") + F.col("docs_above")
    longer_tokens = F.sum(F.col("n_docs") * F.col("length")).over(within) - F.col("n_docs") * F.col("length") + F.col("tokens_above")
    rows = rows.withColumn("docs_longer", longer).withColumn("tokens_longer", longer_tokens)
    return rows.select(
        "length",
        "n_docs",
        (F.col("n_docs") * F.col("length")).alias("n_tokens"),
        "docs_longer",
        "tokens_longer",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_fitting"),
        (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_fitting"),
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length")).alias("tokens_if_cut"),
        F.when(F.col("all_docs") > 0, (F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def at_quantiles(report: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the least length that this share of all documents doesn't exceed; null where none is."""
    asked = report.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    least = [F.min(F.when(F.col("quantile") >= float(x), F.col("length"))).alias(f"q{i}") for i, x in enumerate(shares)]
    found = report.where("n_docs > 0").agg(F.array(*least).alias("lengths"))  # one row
    pairs = found.select(F.explode(F.arrays_zip(F.array(*[F.lit(float(x)) for x in shares]).alias("share"), F.col("lengths").alias("length"))).alias("one"))
    return pairs.select(F.col("one.share").alias("share"), F.col("one.length").alias("length")) if shares else asked.withColumn("length", F.lit(None).cast("long"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return length_report(encoded_lengths(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), LIMITS)

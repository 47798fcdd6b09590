"""Operator 5: toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text: its lower-cased words, word pairs, and pairs with one or two words
between (skip-grams), hashed into 2**20 buckets, each bucket once. One task trains on a
sample of labelled texts bounded in rows (SAMPLE) and bytes (sampling.SAMPLE_BYTES), in
hash order, with a learning rate for each coordinate and an L1 penalty that leaves most
weights at zero; the others, some thousand numbers and 8 MB at the very most, go to the
executors inside the scoring function.

Defined results: null, empty and wordless texts get the score of no features; very long
texts are scored whole, but not learned from (sampling.LONGEST); repeated rows are learned
from once and score alike; rows with a null doc_id are never
learned from and count as not held out; labels that are null or neither 0 nor 1 are
not learned from; without labels every score is 0; an empty table gives no rows;
further columns are kept where the schema has them and ignored where it doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, ship
from .sampling import LONGEST, bounded, capped, remainder
from .words import ALNUM, FACTORS, U, Words, chunks, mix

BITS, SKIPS = 20, 2
#: Labelled rows to learn from, at most.
SAMPLE = 20_000
#: Words whose features are made at a time.
STEP = 500_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 2.0, 1.0, 8.0, 0.0
THRESHOLD = 0.7


def features(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature of words with these hashes and rows; a bucket may come several times."""
    found, own = [h >> U(64 - BITS)], [rows]
    for gap in range(1, SKIPS + 2):
        if len(h) > gap:
            same = rows[gap:] == rows[:-gap]
            pair = mix(h[:-gap] * FACTORS[10 + gap] + h[gap:] * FACTORS[20])
            found.append(pair[same] >> U(64 - BITS))
            own.append(rows[gap:][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(own)


def row_of(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.rows) - 1), np.diff(words.rows))


class Ftrl:
    """Per-coordinate FTRL-proximal with squared-gradient rates; x is 0 or 1."""

    def __init__(self, size: int, bias: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias = bias

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias -= 0.02 * g


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, label) to the non-zero weights; bucket -1 is the bias."""
    kept: list[tuple[np.ndarray, int]] = []
    for rows, data, offsets in chunks(batches):
        words = Words(data, offsets, ALNUM)
        at, row = features(words.hashes, row_of(words))
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(rows.num_rows + 1))
        for i, label in enumerate(rows.column("label").to_pylist()):
            kept.append((np.unique(at[order[ends[i] : ends[i + 1]]]).astype(np.int32), label))
    if not kept:
        return
    share = min(max(sum(y for _, y in kept) / len(kept), 1e-4), 1 - 1e-4)
    model = Ftrl(1 << BITS, float(np.log(share / (1 - share))))
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(kept)).tolist():
            model.learn(*kept[i])
    w = model.weights(slice(None))
    some = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(w[some], model.bias))], ["bucket", "weight"])


def fit(labelled: DataFrame, texts: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights from labelled (doc_id, label) and texts (doc_id, text): buckets and weights, the bias at -1."""
    spark = texts.sparkSession
    own = texts.select("doc_id", "text", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    ids = bounded(labelled.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")).distinct(), "doc_id", most)
    found = own.where(F.col("size") <= LONGEST).select("doc_id", "h", "size").join(F.broadcast(ids), "doc_id").distinct()  # two numbers for each of at most `most` rows
    sample = capped(found, [F.xxhash64(F.lit("sample"), "doc_id", "h")], "size", most)
    chosen = spark.createDataFrame(pa.table({"doc_id": pa.array([r["doc_id"] for r in sample], pa.int64()), "h": pa.array([r["h"] for r in sample], pa.int64()), "label": pa.array([r["label"] for r in sample], pa.int32())}))
    rows = own.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "label"])  # three numbers for each of at most `most` rows
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "h", "label")
    found = rows.select("text", "label").mapInArrow(train, "bucket long, weight double").toArrow()
    return found["bucket"].to_numpy(), found["weight"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str = "score") -> DataFrame:
    """Adds ``name``, the chance (0 to 1) that a text is toxic, to docs; texts are read whole."""
    buckets, weights = model
    some = buckets >= 0
    table = np.zeros(len(weights[some]) + 1, np.float32)
    table[1:] = weights[some]
    sparse = buckets[some].astype(np.int64)
    bias = float(weights[~some][0]) if (~some).any() else -np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.zeros(1 << BITS, np.int32)
        at[sparse] = np.arange(1, len(sparse) + 1)
        for rows, data, offsets in chunks(batches):
            words = Words(data, offsets, ALNUM)
            own, once = row_of(words), [np.empty(0, np.int64)]
            for low in range(0, len(own), STEP):  # with the words that the slice's last ones are paired with
                found, row = features(words.hashes[low : low + STEP + SKIPS + 1], own[low : low + STEP + SKIPS + 1])
                hit = at[found]
                some = hit > 0
                once.append(np.unique(row[some].astype(np.int64) << 32 | hit[some]))
            once = np.unique(np.concatenate(once))
            total = np.bincount(once >> 32, table[once & 0xFFFFFFFF], rows.num_rows) + bias
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35)) if bias != -np.inf else np.full(rows.num_rows, np.inf)))], [*rows.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The model of the labelled rows that aren't held out (crc32 of doc_id modulo 3 is not 1)."""
    ship(spark)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(remainder(F.col("doc_id"), 3) != 1)
    return fit(own, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def op5_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(docs, learned(spark, docs, read(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

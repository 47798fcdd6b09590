"""Operator 6: language identification with bit-sliced Bloom filters of n-grams.

One filter serves all languages: each slot has a bit for each language, in as many words
of 64 bits as these need, and there are as many slots as the n-grams ask for. An
n-gram (two to four bytes of a lower-cased, space-padded word) is stored by setting
the language's bit in its three slots; the AND of the three slots gives all languages
that contain it at once. A text's hits are counted for each language, corrected for
the false positives that the language's share of set bits implies, and the language
with the largest corrected count wins.

Which n-grams a language contains is learned in one task from a sample bounded in texts
(SAMPLE) and bytes (sampling.SAMPLE_BYTES), drawn evenly from all languages so that rare
ones are in it: those it has at least twice and, by relative frequency, at least a tenth
as often as any other language does. The finished slots that are not empty go to the
executors as one broadcast, a dozen bytes for each at 64 languages.

Defined results: null texts and texts without any letter are ``und`` with score 0; so
is everything if nothing could be learned; ties go to the language that sorts first;
rows with a null doc_id are never learned from and count as not held out; repeated
texts are learned from once (a text of several languages under the first by name); very
long texts are read whole, but not learned from (sampling.LONGEST); an empty table gives
no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, ship
from .sampling import LONGEST, capped, remainder
from .words import CHUNK_BYTES, U, chunks, mix

SIZES = (2, 3, 4)
PROBES = 3
#: Slots for each n-gram of the language that has most: at three probes an eighth of its bits is set.
SLOTS_A_GRAM, LEAST_BITS = 24, 16
#: Documents to learn from, at most.
SAMPLE = 8_000
LEAST_COUNT, LEAST_SHARE = 2, 0.1
UND = "und"
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pc.utf8_lower(batch.column(at)))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a chunk as numbers, and the row of each; a non-letter byte counts as a space."""
    n = len(offsets) - 1
    # a space before each row keeps rows apart
    at = np.arange(len(data)) + 1 + np.repeat(np.arange(n), np.diff(offsets))
    text = np.full(len(data) + n + 1, 32, np.uint32)
    text[at] = np.where(LETTER[data], data, 32)
    row = np.repeat(np.arange(n), np.diff(offsets) + 1)
    row = np.append(row, max(n - 1, 0))
    space = text == 32
    found, rows = [], []
    for size in SIZES:
        if len(text) < size:
            continue
        m = len(text) - size + 1
        value, inner, letters = np.zeros(m, np.uint64), np.zeros(m, bool), ~space[:m]
        for j in range(size):
            value = value << U(8) | text[j : m + j]
            letters = letters | ~space[j : m + j]
            if 0 < j < size - 1:
                inner |= space[j : m + j]
        good = letters & ~inner
        value, own = value[good] + (U(size) << U(40)), row[:m][good]
        found.append(value)
        rows.append(own)
    return np.concatenate(found), np.concatenate(rows)


def slots(values: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(values * U(0x9E3779B97F4A7C15))
    step = (h >> U(32)) | U(1)
    return [((h + U(i) * step) & U((1 << bits) - 1)).astype(np.int64) for i in range(PROBES)]


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, lang) to (lang, gram): what each language contains."""
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(lang: str) -> None:
        values = np.concatenate([v for v, _ in parts[lang]])
        counts = np.concatenate([c for _, c in parts[lang]])
        values, inverse = np.unique(values, return_inverse=True)
        parts[lang] = [(values, np.bincount(inverse, counts).astype(np.int64))]

    for rows, data, offsets in chunks(lower(batches)):
        langs = rows.column("lang").to_pylist()
        values, own = grams(data, offsets)
        names = sorted(set(langs))
        which = np.array([names.index(x) for x in langs])[own]
        for i, lang in enumerate(names):
            parts.setdefault(lang, []).append(np.unique(values[which == i], return_counts=True))
            if len(parts[lang]) > 16:
                merge(lang)
    names = sorted(parts)
    if not names:
        return
    for lang in names:
        merge(lang)
    every = np.unique(np.concatenate([parts[x][0][0] for x in names]))
    largest = np.zeros(len(every))
    for lang in names:
        values, counts = parts[lang][0]
        at = np.searchsorted(every, values)
        largest[at] = np.maximum(largest[at], counts / max(counts.sum(), 1))
    for lang in names:
        values, counts = parts[lang][0]
        own = values[(counts >= LEAST_COUNT) & (counts / max(counts.sum(), 1) >= LEAST_SHARE * largest[np.searchsorted(every, values)])]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(own) + 1)), pa.array(np.append(own, 0).astype(np.int64))], ["lang", "gram"])


class Filter:
    """The slots, the languages by bit, and each language's false-positive rate."""

    def __init__(self, langs: list[str], grams_of: list[np.ndarray]):
        self.langs = langs
        self.bits = max(LEAST_BITS, int(SLOTS_A_GRAM * max([1, *map(len, grams_of)]) - 1).bit_length())
        self.slots = np.zeros((1 << self.bits, max(1, -(-len(langs) // 64))), U)
        self.chance = np.zeros(len(langs))
        for bit, values in enumerate(grams_of):
            at = np.unique(np.concatenate(slots(values.astype(U), self.bits)))
            self.slots[at, bit // 64] |= U(1) << U(bit % 64)
            self.chance[bit] = (len(at) / len(self.slots)) ** PROBES

    def packed(self) -> tuple[list[str], int, np.ndarray, np.ndarray, np.ndarray]:
        """What unpacked() needs: the slots that aren't empty, and the rest."""
        some = np.flatnonzero(self.slots.any(axis=1))
        return self.langs, self.bits, self.chance, some.astype(np.int32), self.slots[some]

    @staticmethod
    def unpacked(parts: tuple[list[str], int, np.ndarray, np.ndarray, np.ndarray]) -> Filter:
        out = Filter.__new__(Filter)
        out.langs, out.bits, out.chance, at, values = parts
        out.slots = np.zeros((1 << out.bits, values.shape[1]), U)
        out.slots[at] = values
        return out

    def masks(self, values: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as bits of 64-bit words."""
        first, *rest = slots(values, self.bits)
        out = self.slots[first]
        for at in rest:
            out &= self.slots[at]
        return out

    def counts(self, values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hits by row and language, and the number of n-grams by row."""
        masks = self.masks(values)
        out = np.empty((n, len(self.langs)))
        for bit in range(len(self.langs)):
            out[:, bit] = np.bincount(rows, ((masks[:, bit // 64] >> U(bit % 64)) & U(1)).astype(np.float64), n)
        return out, np.bincount(rows, minlength=n)

    def corrected(self, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Hits without those that the filter's false positives are expected to be."""
        return np.maximum((hits - total[:, None] * self.chance) / np.maximum(1 - self.chance, 1e-9), 0)


def slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and rows of parts of a chunk, of about CHUNK_BYTES; a long row is cut at bytes that are no letters."""
    if len(data) <= 2 * CHUNK_BYTES:
        yield data, offsets, np.arange(len(offsets) - 1)
        return
    low = 0  # a longer chunk is one row
    while low < len(data):
        high = min(low + CHUNK_BYTES, len(data))
        if high < len(data):
            gap = np.flatnonzero(~LETTER[data[high : high + CHUNK_BYTES]])
            high = high + int(gap[0]) if len(gap) else len(data)
        yield data[low:high], np.array([0, high - low]), np.zeros(1, np.int64)
        low = high


def fit(docs: DataFrame, most: int = SAMPLE) -> Filter:
    """The filter learned from docs (doc_id, text, lang); at most ``most`` texts are used."""
    spark = docs.sparkSession
    known = docs.where("lang is not null and doc_id is not null and text is not null").select("text", "lang", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))
    texts = known.where(F.col("size") <= LONGEST).groupBy("h").agg(F.min("lang").alias("lang"), F.max("size").alias("size"))
    texts = Scratch(spark, "language").write(texts, "texts")
    per = F.broadcast(texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most))  # as many languages as texts, at most
    # By hash within a language, its places spread evenly over the order.
    u = F.pmod(F.xxhash64(F.lit("sample"), F.col("h")), F.lit(2**32)).cast("double")
    near = texts.join(per, "lang").withColumn("order", u * F.col("n")).where(F.col("order") < F.lit(2.0**32) * (1.5 * most + 100))
    sample = capped(near.select("h", "lang", "size", "order"), [F.col("order")], "size", most)
    chosen = spark.createDataFrame(pa.table({"h": pa.array([r["h"] for r in sample], pa.int64()), "lang": pa.array([r["lang"] for r in sample], pa.string())}))
    rows = known.select("text", "h").join(F.broadcast(chosen), "h").dropDuplicates(["h"])  # a number and a name for each of at most `most` rows
    found = rows.repartition(1).sortWithinPartitions("h").select("text", "lang").mapInArrow(train, "lang string, gram long").toArrow()
    langs = sorted(pc.unique(found["lang"]).to_pylist())
    return Filter(langs, [x[x > 0] for x in (found["gram"].filter(pc.equal(found["lang"], lang)).to_numpy() for lang in langs)])


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred, score for docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Filter.unpacked(shared.value)
        for rows, data, offsets in chunks(lower(batches)):
            n = rows.num_rows
            letters = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data >= 97) & (data <= 122), out=letters[1:])
            known = letters[offsets[1:]] > letters[offsets[:-1]]
            for i in np.flatnonzero(~known & (np.diff(offsets) > 0)).tolist():
                known[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
            if langs:
                hits, total = np.zeros((n, len(langs))), np.zeros(n, np.int64)
                for part, ends, own in slices(data, offsets):
                    found, sizes = table.counts(*grams(part, ends), len(own))
                    hits[own] += found
                    total[own] += sizes
                counts = table.corrected(hits, total)
                best, total = counts.argmax(axis=1), counts.sum(axis=1)
                top = counts[np.arange(n), best]
                score = np.where(known, np.where(total > 0, top / np.maximum(total, 1e-9), 1 / len(langs)), 0.0)
                names = [langs[b] if k else UND for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            else:
                score, names = np.zeros(n), [UND] * n
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

"""Operator 1: best-fit packing by exact-complement hashing.

Every document is encoded, ended by id 0 and cut into pieces of at most ``limit``
tokens. How pieces are packed depends on nothing but how many pieces there are of
each length, so the plan is made on that histogram (at most ``limit`` rows, whatever
the corpus). An index holds, for every sum, how many single lengths, pairs and triples of
available lengths have it, and follows the counts as lengths are used up. Longest first,
a piece's gap is looked up in it and filled exactly by one, two or three lengths, as many
times as the counts allow; what has no exact complement is placed by best fit. Pieces are then numbered within their
length, and number and length give sequence and offset.

Defined results: null and empty texts are one piece of one token (the end id); equal
documents and repeated rows are packed once each; ties between pieces of one length
are free (any numbering gives as many sequences); an empty table gives no rows;
further columns are ignored, whatever their names; a null doc_id is kept.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read
from .encoding import encoder
from .words import chunks

LIMIT = 2048
#: Pieces of one length are numbered in buckets of about so many rows.
BUCKET = 20_000


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row (and the ids themselves, as binary, if asked for).

    ``row`` numbers the pieces: task and place in it, so that repeated rows have different ones.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(tokenizer).encode_rows, TaskContext.get().partitionId() << 40
        for own_rows, data, offsets in chunks(batches, keep=True):
            found, ends = encode(data, offsets)
            rows = []
            for doc_id, low, high in zip(own_rows.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                all_ids = found[low:high].astype("<u4").tobytes() + bytes(4)
                for n, at in enumerate(range(0, len(all_ids), 4 * limit)):
                    own = all_ids[at : at + 4 * limit]
                    rows.append((doc_id, n, at // 4, len(own) // 4, zlib.crc32(own), number, *([own] if ids else [])))
                    number += 1
            yield out(rows)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if ids else [])]
    names = [x.split()[0] for x in schema.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Complements:
    """Available lengths by count, and an index of the sums of one, two and three of them.

    ``pairs`` and ``triples`` have, for every sum, how many combinations of available lengths
    make it, none of which needs a length more often than it is left. A length counts as
    available once, twice or three times; a change of that adds or removes the
    combinations with it in one pass over the sums.
    """

    def __init__(self, counts: np.ndarray):
        size = len(counts)
        self.left, self.there = np.zeros(size, np.int64), np.zeros(size, bool)
        self.pairs, self.triples = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for x in np.flatnonzero(counts).tolist():
            self.put(x, int(counts[x]))

    def _count(self, x: int, times: int, sign: int) -> None:
        """Adds (or removes) the combinations that have x just ``times`` times; other lengths' are there."""
        size = len(self.there)
        others = np.flatnonzero(self.there[: max(0, size - times * x)])
        others = others[others != x]
        if times == 1:
            if sign < 0:
                self.pairs[others + x] -= 1
            self.triples[x:] += sign * self.pairs[: size - x]  # pairs without x
            if sign > 0:
                self.pairs[others + x] += 1
        elif times == 2 and 2 * x < size:
            self.pairs[2 * x] += sign
            self.triples[others + 2 * x] += sign
        elif times == 3 and 3 * x < size:
            self.triples[3 * x] += sign

    def put(self, x: int, n: int) -> None:
        """Length x is left n times from now on."""
        before, after = min(int(self.left[x]), 3), min(n, 3)
        for times in range(before + 1, after + 1):
            self._count(x, times, 1)
            self.there[x] = True
        for times in range(before, after, -1):
            self._count(x, times, -1)
        self.left[x], self.there[x] = n, n > 0

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.put(x, int(self.left[x]) - times)

    def fill(self, total: int, most: int = 3) -> tuple[int, ...]:
        """One, two or three available lengths of that sum, ``most`` at most, as the index has them; nothing if it has none."""
        if self.there[total]:
            return (total,)
        if most > 1 and self.pairs[total]:
            return self._pair(total, total)
        return self._triple(total) if most > 2 and self.triples[total] else ()

    def _pair(self, total: int, most: int, used: int = 0) -> tuple[int, ...]:
        """The larger part as large as can be, ``most`` at most: it leaves the small lengths, which fit anywhere.

        The larger part may equal ``used``, of which one is taken already.
        """
        half = total // 2
        low = self.there[1 : half + 1]
        high = self.there[total - half : total][::-1]
        for a in (np.flatnonzero(low & high) + 1).tolist():
            b = total - a
            need = 1 + (a == b) + (b == used)
            if b <= most and self.left[b] >= need and (a != used or a == b or self.left[a] > 1):
                return (b, a)
        return ()

    def _triple(self, total: int) -> tuple[int, ...]:
        for c in np.flatnonzero(self.there[: total - 1])[::-1].tolist():
            rest = self._pair(total - c, c, c) if total - c > 1 else ()
            if rest:
                return (c, *rest)
        return ()


def plan(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), over a histogram of lengths.

    Complements that use up middle lengths can leave a rest that packs badly. So gaps are
    filled with up to three, two, one or no complements, and of these plans the one of the
    fewest sequences is kept (of equal ones that of the most complements): never more than best fit alone takes.
    """
    plans = [exact(histogram, limit, most) for most in (3, 2, 1)] + [best_fit(histogram, limit)]
    return min(plans, key=lambda made: sum(times for _, times in made))


def exact(histogram: dict[int, int], limit: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan whose gaps are filled exactly with up to ``most`` complements, longest lengths first, the rest by best fit."""
    counts = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    index, made, rest = Complements(counts), [], {}
    for length in range(limit, 0, -1):
        while index.left[length]:
            index.take((length,), 1)
            gap = limit - length
            fill = index.fill(gap, most) if gap else ()
            if gap and not fill:
                rest[length] = int(index.left[length]) + 1
                index.take((length,), rest[length] - 1)
                break
            need = defaultdict(int)
            for x in (length, *fill):
                need[x] += 1
            times = min((int(index.left[x]) + (x == length)) // k for x, k in need.items())
            index.take((length,), times - 1)
            index.take(fill, times)
            made.append(((length, *fill), times))
    return made + best_fit(rest, limit)


def best_fit(rest: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: all sequences with the same gap move together."""
    open_, gaps = defaultdict(list), []

    def add(gap: int, bins: tuple[tuple[int, ...], int]) -> None:
        if not open_[gap]:
            bisect.insort(gaps, gap)
        open_[gap].append(bins)

    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = limit // length
                if left >= each:
                    add(limit - each * length, ((length,) * each, left // each))
                if left % each:
                    add(limit - (left % each) * length, ((length,) * (left % each), 1))
                break
            gap = gaps[at]
            lengths, n = open_[gap].pop()
            if not open_[gap]:
                gaps.pop(at)
            used = min(n, left)
            if n > used:
                add(gap, (lengths, n - used))
            add(gap - length, ((*lengths, length), used))
            left -= used
    return [x for bins in open_.values() for x in bins]


def places(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For pieces numbered within their length: (length << 40 | first number), sequence, offset, sorted."""
    used, rows, sequence = defaultdict(int), [], 0
    for lengths, times in made:
        offset = 0
        for x in lengths:
            rows.append((x << 40 | used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 3).T)


def numbered(found: DataFrame, buckets: int) -> DataFrame:
    """Adds ``number``: from 0 within each length, without gaps; a length's rows are split over buckets by ``row``."""
    keyed = found.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    sums = keyed.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")
    first = sums.select("length", "bucket", before.alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    return keyed.withColumn("own", own).join(first, ["length", "bucket"]).withColumn("number", F.col("own") + F.col("first")).drop("own", "first", "bucket", "row")


def pack(docs: DataFrame, spark: SparkSession, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Pieces with sequence_id and offset; see the module's text for the rules."""
    scratch = Scratch(spark, "packing")
    found = scratch.write(pieces(docs, tokenizer, limit), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `limit` rows
    keys, sequences, offsets = places(plan(histogram, limit))
    buckets = max(1, sum(histogram.values()) // BUCKET)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("length")) << 40 | np.asarray(batch.column("number"))
            at = np.searchsorted(keys, own, "right") - 1
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(sequences[at] + (own - keys[at])), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered(found, buckets).mapInArrow(place, schema)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), spark, public_tokenizers.path("word_bpe_49k.json"))

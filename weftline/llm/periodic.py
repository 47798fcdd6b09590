"""Operator 13: periodic runs of words, by the Gusfield-Stoye tandem-repeat method.

A run is a stretch of words that repeats itself with a smallest period q, at least
EXPONENT times and LEAST words long, and that no neighbouring word continues. Texts are
dealt by Spark; a task takes them a chunk at a time, and finds the runs of a whole chunk
together, in one generalised suffix structure whose stretches end in symbols of their own:

* Sieve. Every window of GRAM words inside a run occurs again in the run, so runs lie
  within stretches of windows that do; all else is left out. Within a stretch only what
  recurs in that stretch counts, until nothing more goes. A hash that happens to
  be equal only keeps a stretch too many.
* Names. Substrings of 2^k words get numbers in their order (prefix doubling). They give the
  suffix array, extensions to the left and to the right from any two places, and
  the locus of any substring: its range of the suffix array, a point of the suffix tree.
* First phase. Longest earlier occurrences cut the text into Lempel-Ziv blocks. Squares whose
  centre is in a block and that its copy can't show earlier touch the block's border, so the
  extensions from the borders, one pair for each distance, give squares that cover the
  leftmost occurrence of every kind.
* Second phase. From each of these the walk over suffix links turns the square by a word
  at a time and marks its locus. While the text itself goes on with the period the walk
  goes along the text; where it stops, the suffix link and the child by the turned word are
  looked up in the suffix array. A walk ends where a locus is marked already or there
  is no such child. Then the vocabulary of squares of primitive root is complete.
* The leaves below the marked loci are all places of these squares; places next to each other
  with one period merge into runs, which keep what is long enough.

Work and memory follow the words of the stretches (times a logarithm); a very long text is
a chunk of its own.

Defined results: null and empty texts have no words and no runs, and collapse to an
empty text; very long texts are searched whole; repeated rows have the same runs each; of
the runs of greatest exponent the first is the one of smallest start, then period; an empty table gives no
rows; further columns are kept, whatever their names. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import fresh, read, ship
from .words import FACTORS, NOT_SPACE, U, Words, chunks, mix

LEAST, EXPONENT = 24, 3
#: For every period q, 2 * q <= max(LEAST, EXPONENT * q) - GRAM + 1: each window of a run has its like q words away in it.
GRAM = 8
#: Words whose bytes are gathered at a time.
STEP = 200_000


class Suffixes:
    """Names of all substrings of 2^k symbols of a text whose first and last symbol occur once."""

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        names = np.unique(text, return_inverse=True)[1].astype(np.int64)
        levels, size = [names.astype(np.int32)], 1
        while names.max() + 1 < n:
            after = np.zeros(n, np.int64)
            after[:-size] = names[size:] + 1
            names = np.unique(names * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            levels.append(names.astype(np.int32))
            size *= 2
        self.names = np.stack(levels)
        self.rank = levels[-1]
        self.order = np.empty(n, np.int32)
        self.order[self.rank] = np.arange(n, dtype=np.int32)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols are equal from a and b on, a and b being different places."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 2, -1, -1):
            out += (self.names[k][a + out] == self.names[k][b + out]).astype(np.int64) << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols are equal up to a and b, those at a and b included."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 2, -1, -1):
            x, y = a - out - (1 << k) + 1, b - out - (1 << k) + 1
            same = (x >= 0) & (y >= 0) & (self.names[k][np.maximum(x, 0)] == self.names[k][np.maximum(y, 0)])
            out += same.astype(np.int64) << k
        return out

    def locus(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the suffix array whose suffixes begin with the ``size`` >= 1 symbols at ``at``."""
        level = np.frexp(size.astype(float))[1] - 1
        level = np.minimum(level, len(self.names) - 1)
        rest = np.maximum(size - (1 << level), 0)
        first, last = self.names[level, at], self.names[level, np.minimum(at + rest, self.n - 1)]

        def same(r: np.ndarray) -> np.ndarray:
            p = self.order[r]
            return (self.names[level, p] == first) & (self.names[level, np.minimum(p + rest, self.n - 1)] == last)

        rank = self.rank[at].astype(np.int64)
        low, high = np.zeros(len(at), np.int64), rank.copy()  # the least r that is same
        top, end = rank.copy(), np.full(len(at), self.n - 1, np.int64)  # the greatest one
        for _ in range(self.n.bit_length()):
            middle = (low + high) // 2
            good = same(middle)
            high, low = np.where(good, middle, high), np.where(good, low, np.minimum(middle + 1, high))
            middle = (top + end + 1) // 2
            good = same(middle)
            top, end = np.where(good, middle, top), np.where(good, end, np.maximum(middle - 1, top))
        return high, top + 1

    def child(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """A place in the range [low, high) whose symbol after ``depth`` others is the given one; -1 where there is none."""
        names, end = self.names[0], high
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high) // 2, low)
            less = names[np.minimum(self.order[np.minimum(middle, self.n - 1)] + depth, self.n - 1)] < symbol
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        at = self.order[np.minimum(low, self.n - 1)].astype(np.int64)
        found = (low < end) & (names[np.minimum(at + depth, self.n - 1)] == symbol)
        return np.where(found, at, -1)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts[i] copies of every i: i, and the number of the copy from 0."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def blocks(s: Suffixes) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end: each block is the longest that begins earlier too, or a new symbol."""
    before, after, stack = [-1] * s.n, [-1] * s.n, []
    for p in s.order.tolist():
        while stack and stack[-1] > p:
            after[stack.pop()] = p
        before[p] = stack[-1] if stack else -1
        stack.append(p)
    longest = np.ones(s.n, np.int64)
    for other in (np.array(before), np.array(after)):
        has = np.flatnonzero(other >= 0)
        longest[has] = np.maximum(longest[has], s.forward(has, other[has]))
    out, at, sizes = [], 0, longest.tolist()
    while at < s.n:
        out.append(at)
        at += sizes[at]
    return np.array([*out, s.n])


def covering(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Squares (start, period) that cover the leftmost occurrence of every kind of square."""
    starts = blocks(s)
    own, following = np.diff(starts), np.append(np.diff(starts)[1:], 0)
    b, k = spread(own)  # from the block's end to the left
    k, end = k + 1, starts[b + 1]
    inside = (end < s.n) & (end - k > 0)
    k, end = k[inside], end[inside]
    q = end - k
    right, left = s.forward(end, q), s.backward(end - 1, q - 1)
    good = (right > 0) & (left + right >= k)
    found = [(np.maximum(q - left, q - k + 1)[good], k[good])]
    b, k = spread(own + following)  # from the block's start to the right
    k, h = k + 1, starts[b]
    inside = (h > 0) & (h + k < s.n)
    k, h = k[inside], h[inside]
    right, left = s.forward(h, h + k), s.backward(h - 1, h + k - 1)
    good = (right > 0) & (left + right >= k)
    found.append((np.maximum(h - left, h - k + 1)[good], k[good]))
    at, period = (np.concatenate(x) for x in zip(*found, strict=True))
    return primitive(s, at, period)


def primitive(s: Suffixes, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those squares, each once, whose root isn't a power of a shorter word."""
    keys = np.unique(period * s.n + at)
    at, period = keys % s.n, keys // s.n
    keep = np.ones(len(at), bool)
    if len(at):
        least = np.arange(int(period.max()) + 1)  # least prime factor of each number
        for x in range(2, int(len(least) ** 0.5) + 1):
            if least[x] == x:
                multiples = least[x * x :: x]
                multiples[multiples == np.arange(x * x, len(least), x)] = x
        rest = period.copy()
        while (open_ := np.flatnonzero(keep & (rest > 1))).size:
            prime = least[rest[open_]]
            root = period[open_] // prime
            keep[open_] = s.forward(at[open_], at[open_] + root) < period[open_] - root
            rest[open_] //= prime
    return at[keep], period[keep]


def vocabulary(s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, low, high): the loci of all squares of primitive root."""
    at, period = covering(s)
    marked = np.empty((0, 3), np.int64)
    while len(at):
        alike = s.forward(at, at + period)
        turns = np.minimum(alike - period, period - 1)
        owner, turn = spread(turns + 1)
        places, sizes = at[owner] + turn, period[owner]
        low, high = s.locus(places, 2 * sizes)
        known = set(map(tuple, marked[:, :2].tolist())) if len(marked) else set()
        rows, first = np.unique(np.stack([sizes, low, high], 1), axis=0, return_index=True)
        new = np.array([(a, b) not in known for a, b in rows[:, :2].tolist()], bool) if known else np.ones(len(rows), bool)
        marked = np.concatenate([marked, rows[new]])
        # a walk goes on behind the text's last turn, unless all turns are done or it was here before
        ends = np.cumsum(turns + 1) - 1
        last = low[ends]
        fresh_ends = np.array([(a, b) not in known for a, b in zip(period.tolist(), last.tolist(), strict=True)], bool)
        go = np.flatnonzero((turns < period - 1) & fresh_ends)
        if not len(go):
            break
        place, size = places[ends[go]], period[go]
        a, b = s.locus(place + 1, np.maximum(2 * size - 1, 1))
        at = s.child(a, b, 2 * size - 1, s.names[0][place])
        period, at = size[at >= 0], at[at >= 0]
        if len(at):
            keys = np.unique(period * s.n + at)
            at, period = keys % s.n, keys // s.n
    return marked[:, 0], marked[:, 1], marked[:, 2]


def runs_of(text: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a text whose first and last symbol occur once."""
    s = Suffixes(text)
    period, low, high = vocabulary(s)
    owner, leaf = spread(high - low)
    keys = np.sort(period[owner] * s.n + s.order[low[owner] + leaf])
    if not len(keys):
        return (np.empty(0, np.int64),) * 3
    breaks = np.flatnonzero(np.diff(keys) != 1) + 1
    # a key's last place can't be followed by another period's first: squares end before the text does
    first, last = keys[np.append(0, breaks)], keys[np.append(breaks, len(keys)) - 1]
    q, start = first // s.n, first % s.n
    length = last - first + 2 * q
    keep = length >= np.maximum(least, exponent * q)
    return start[keep], length[keep], q[keep]


def stretches(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words in which runs can lie; rows: the first word of each text, and the end."""
    n = len(hashes) - GRAM + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none
    grams = hashes[:n] * FACTORS[0]
    for j in range(1, GRAM):
        grams += hashes[j : n + j] * FACTORS[j]
    places = np.arange(n)
    group = np.searchsorted(rows, places, "right")
    inside = places + GRAM <= rows[group]
    places, group, grams = places[inside], group[inside], mix(grams[inside])
    while len(places):
        keys = grams ^ mix(group.astype(U) * FACTORS[GRAM] + U(1))
        ordered = np.sort(keys)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(again):
            return none, none
        at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
        keep = again[at] == keys
        whole = keep.all()
        old = group[keep]
        places, grams = places[keep], grams[keep]
        breaks = (np.diff(places) != 1) | (np.diff(old) != 0)
        group = np.append(0, np.cumsum(breaks))
        if whole:
            edges = np.append(0, np.flatnonzero(breaks) + 1)
            ends = np.append(edges[1:], len(places)) - 1
            starts, ends = places[edges], places[ends] + GRAM
            long = ends - starts >= LEAST
            return starts[long], ends[long]
    return none, none


def find(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, length, period) of all runs of the texts of a chunk, by row, start and period."""
    starts, ends = stretches(hashes, rows)
    if not len(starts):
        return (np.empty(0, np.int64),) * 4
    sizes = ends - starts
    owner, offset = spread(sizes)
    ids = np.unique(hashes[starts[owner] + offset], return_inverse=True)[1]
    # a symbol of its own stands before each stretch and behind the last
    at = np.cumsum(sizes + 1) - sizes
    text = np.empty(int(sizes.sum()) + len(sizes) + 1, np.int64)
    text[at[owner] + offset] = ids
    separators = np.append(at - 1, len(text) - 1)
    text[separators] = len(ids) + np.arange(len(separators))
    start, length, period = runs_of(text)
    part = np.searchsorted(at, start, "right") - 1
    place = starts[part] + start - at[part]
    row = np.searchsorted(rows, place, "right") - 1
    order = np.lexsort((period, place))
    return row[order], (place - rows[row])[order], length[order], period[order]


def joined(words: Words, kept: np.ndarray, rows: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space each; rows: the first kept word of each row, and the end."""
    sizes = words.ends[kept] - words.starts[kept] + 1
    ends = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    out = np.empty(int(ends[-1]), np.uint8)
    for low in range(0, len(kept), STEP):
        high = min(low + STEP, len(kept))
        own = sizes[low:high]
        at = np.arange(int(ends[high] - ends[low])) + np.repeat(words.starts[kept[low:high]] - (ends[low:high] - ends[low]), own)
        out[ends[low] : ends[high]] = words.data[np.minimum(at, len(words.data) - 1)]
    out[ends[1:] - 1] = 0x20
    # a row's last space goes: each row is cut out by itself
    has = rows[1:] > rows[:-1]
    low, high = ends[rows[:-1]], np.where(has, ends[rows[1:]] - 1, ends[rows[:-1]])
    whole = np.ones(len(out), bool)
    whole[ends[rows[1:]][has] - 1] = False
    offsets = np.append(0, np.cumsum(high - low))
    return pa.LargeStringArray.from_buffers(len(rows) - 1, pa.py_buffer(offsets), pa.py_buffer(out[whole]))


def collapsed(docs: DataFrame, text: str = "text", runs: str = "runs", kept: str = "collapsed") -> DataFrame:
    """docs with its runs, by start and period, and the text without a run's words after its first period.

    ``runs`` is an array of (start, length, period) in words, ``collapsed`` the kept words
    joined by one space; both names get a ``_`` where docs has such a column.
    """
    runs, kept = fresh(docs.columns, runs), fresh(docs.columns, kept)
    span = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
    schema = StructType([*docs.schema.fields, StructField(runs, ArrayType(span)), StructField(kept, StringType())])
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, text):
            words = Words(data, offsets, NOT_SPACE, lower=False)
            row, start, length, period = find(words.hashes, words.rows)
            if len(row):
                change = np.zeros(len(words.hashes) + 1, np.int32)
                first = words.rows[row] + start
                np.add.at(change, first + period, 1)
                np.add.at(change, first + length, -1)
                keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            else:
                keep = np.arange(len(words.hashes))
            texts = joined(words, keep, np.searchsorted(keep, words.rows)).cast(pa.string() if len(data) < 2**31 - 1 else pa.large_string())
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(one))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, texts], [*batch.schema.names, runs, kept])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equal ones that of smallest start, then period."""

    def order(x: Column, y: Column) -> Column:
        gain = x["length"] * y["period"] - y["length"] * x["period"]
        later = F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])
        return F.signum(F.when(gain != 0, -gain).otherwise(later)).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) of which about a tenth, chosen by a hash of the id, end in a repeated stretch of their own words."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def of(w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        turned = lambda place: F.transform(w, lambda x, i: F.when(i < place["a"], x).otherwise(F.get(w, place["a"] + (i - place["a"]) % place["p"])))
        return F.get(F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda place: F.array_join(turned(place), " ")), F.lit(0))

    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, of(w)).otherwise("")), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapsed(planted(read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )

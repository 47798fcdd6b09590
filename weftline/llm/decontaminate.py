"""Operator 10: benchmark decontamination with a generalised suffix automaton of test items.

The items' words (lower-cased, runs of letters, digits and non-ASCII characters) are
numbered and put into one suffix automaton. A document's words are streamed through
it; state and length say, at each word, the longest run of words ending there that
some item contains. A run is a hit where it reaches an item's limit: ``window`` words,
or the whole of an item (more generally ``coverage`` of it) that is shorter. Words
whose neighbours form no word pair of any item can't be part of a longer run, so the
automaton sees only stretches of pairs that a sieve of fixed size lets through.

Items are a table. They are dealt over blocks of about BLOCK_WORDS words, a long one in
overlapping pieces, and each task streams stretches through the automaton of one block,
which it builds from the block's rows: neither the driver nor a task holds all items.
Stretches meet every block; documents are read, not shuffled.

Defined results: null texts have no words; null, empty and wordless items have no
windows; a null item_id is the empty string; items that share an id count once;
repeated documents are marked alike (texts are known by a 64-bit hash); very long texts
and items are read whole; an empty table gives no rows, an empty benchmark no hits;
further columns are kept by ``marked`` and ``cleaned``, whatever their names, but those
that ``marked`` adds replace columns of their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, read, split_by_keys
from .words import ALNUM, FACTORS, U, Words, binaries, chunks, flat, mix, release, released

WINDOW, COVERAGE, BLOCK_WORDS = 10, 1.0, 100_000
#: Words of an item or of a stretch in one row, at most.
PIECE = 20_000
#: Words of stretches that one task streams through a block, about.
SHARE = 2_000_000
#: Bits of the sieves of word pairs and of single words.
PAIR_BITS, WORD_BITS = 22, 20


def pairs_of(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * FACTORS[30] + h[1:] * FACTORS[31])


class Automaton:
    """Suffix automaton of several sequences: transitions, suffix links and lengths by state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of p's longest string followed by c: q, or its copy of that length."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._split(last, c, self.next[last][c])
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new

    def walk(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """State and matched length after each element; an element that is nowhere gives (0, 0)."""
        state = length = 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            yield state, length


class Matcher:
    """A block's automaton with the items whose windows each state ends with; items: (id, window, word hashes)."""

    def __init__(self, items: list[tuple[str, int, np.ndarray]]):
        words = np.unique(np.concatenate([h for _, _, h in items])) if items else np.empty(0, U)
        self.words, self.automaton = words, Automaton()
        numbered = [np.searchsorted(words, h).tolist() for _, _, h in items]
        for own in numbered:
            self.automaton.add(own)
        self.at: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        single, self.least = [], math.inf
        for own, (name, need, h) in zip(numbered, items, strict=True):
            if need == 1:
                single.append(h)
            else:
                self.least = min(self.least, need)
            for state, length in self.automaton.walk(own):
                if length >= need:
                    self.at[self._holder(state, need)][need].add(name)
        self.above = [-1] * len(self.automaton.length)
        for state in sorted(range(len(self.above)), key=self.automaton.length.__getitem__):
            up = self.automaton.link[state]
            self.above[state] = state if state in self.at else self.above[up] if up >= 0 else -1
        self.single = np.unique(np.concatenate(single)) if single else np.empty(0, U)
        self.pairs = np.unique(np.concatenate([pairs_of(h) for _, _, h in items])) if items else np.empty(0, U)

    def _holder(self, state: int, length: int) -> int:
        """The state whose strings include the suffix of that length."""
        while self.automaton.length[self.automaton.link[state]] >= length:
            state = self.automaton.link[state]
        return state

    def ends(self, state: int, length: int) -> Iterator[tuple[int, set[str]]]:
        """Windows that end at a position: their length and their items."""
        state = self.above[state]
        while state >= 0:
            for need, names in self.at[state].items():
                if need <= length:
                    yield need, names
            up = self.automaton.link[state]
            state = self.above[up] if up >= 0 else -1

    def hits(self, h: np.ndarray, rows: np.ndarray) -> dict[int, tuple[set[int], set[str]]]:
        """For each row with hits: the numbers of its hit words (within the chunk) and the items."""
        found: dict[int, tuple[set[int], set[str]]] = {}
        stretches = []
        if len(h) > 1 and self.least < math.inf:
            pair = pairs_of(h)
            known = np.zeros(len(h), bool)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known[:-1] = self.pairs[at] == pair if len(self.pairs) else False
            known[np.minimum(rows[1:-1] - 1, len(h) - 1)[rows[1:-1] > 0]] = False  # pairs don't span rows
            edge = np.diff(np.concatenate([[0], known[:-1].astype(np.int8), [0]]))
            low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            long = high - low >= self.least
            stretches += zip(low[long].tolist(), high[long].tolist(), strict=True)
        if len(self.single):
            at = np.minimum(np.searchsorted(self.single, h), len(self.single) - 1)
            stretches += [(i, i + 1) for i in np.flatnonzero(self.single[at] == h).tolist()]
        for low, high in stretches:
            row = int(np.searchsorted(rows, low, "right")) - 1
            for i, (state, length) in enumerate(self.automaton.walk(np.searchsorted(self.words, h[low:high]).tolist()), low):
                for need, names in self.ends(state, length):
                    words, items = found.setdefault(row, (set(), set()))
                    words.update(range(i - need + 1, i + 1))
                    items |= names
        return found


def cut_up(h: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, words) of pieces of at most PIECE words and the overlap, which any run of overlap + 1 words is within."""
    for low in range(0, max(len(h) - overlap, 1), PIECE):
        yield low, h[low : low + PIECE + overlap]


def _items(window: int, coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (item_id, text) to pieces (item_id, need, words): need is the item's window, words their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            words = Words(data, offsets, ALNUM)
            ids, needs, found = [], [], []
            for name, a, b in zip(rows.column("item_id").to_pylist(), words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
                need = min(window, max(1, math.ceil(coverage * (b - a))))
                for _, h in cut_up(words.hashes[a:b], need - 1) if b > a else ():
                    ids.append(name)
                    needs.append(need)
                    found.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(needs, pa.int32()), pa.array(found, pa.binary())], ["item_id", "need", "words"])

    return run


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (need, words) to the sieve's slots, numbered from 1: word pairs, then the words of windows of one word."""
    for batch in batches:
        found = [np.empty(0, U)]
        for need, words in zip(batch.column("need").to_pylist(), batch.column("words"), strict=True):
            h = np.frombuffer(words.as_buffer(), U)
            found.append((mix(h) >> U(64 - WORD_BITS)) + U(1 << PAIR_BITS) if need == 1 else pairs_of(h) >> U(64 - PAIR_BITS))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).astype(np.int64) + 1)], ["slot"])


def sieve_of(items: DataFrame) -> bytes:
    """Bits of the slots that the items take: half a megabyte, whatever the items are."""
    slots = items.select("need", "words").mapInArrow(_slots, "slot long")
    pages = slots.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()  # at most 161 rows of 4 kB
    out = np.zeros(((1 << PAIR_BITS) + (1 << WORD_BITS)) // 8, np.uint8)
    for page, bits in pages:
        out[(page - 1) * 4096 : page * 4096] = np.frombuffer(bits, np.uint8)
    return out.tobytes()


def _stretches(sieve: bytes, least: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc, text) to stretches (doc, first, words) that pass the sieve: first is a word's number in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(sieve, np.uint8), bitorder="little").astype(bool)
        for rows, data, offsets in chunks(batches):
            words = Words(data, offsets, ALNUM)
            h = words.hashes
            alone = known[(mix(h) >> U(64 - WORD_BITS)).astype(np.int64) + (1 << PAIR_BITS)]
            edge = np.zeros(len(h) + 1, np.int8)
            if len(h) > 1:
                pair = known[(pairs_of(h) >> U(64 - PAIR_BITS)).astype(np.int64)]
                last = words.rows[1:-1]
                pair[last[(last > 0) & (last < len(h))] - 1] = False  # pairs don't span rows
                edge[1:-1] = pair
            step = np.diff(edge, append=0)
            low, high = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1
            long = high - low >= least
            single = np.flatnonzero(alone)
            docs, first, found = [], [], []
            ids = rows.column("doc").to_pylist()
            for a, b in [*zip(low[long].tolist(), high[long].tolist(), strict=True), *((i, i + 1) for i in single.tolist())]:
                row = int(np.searchsorted(words.rows, a, "right")) - 1
                for at, own in cut_up(h[a:b], overlap):
                    docs.append(ids[row])
                    first.append(a + at - int(words.rows[row]))
                    found.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first, pa.int32()), pa.array(found, pa.binary())], ["doc", "first", "words"])

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block, its items (turn 0) before stretches (turn 1), to (doc, hit_words, hit_items)."""
    block, items, ready = None, [], None
    for batch in batches:
        blocks, salts, turns = (np.asarray(batch.column(c)) for c in ("block", "salt", "turn"))
        new = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(salts) != 0) | (np.diff(turns) != 0)) + 1
        for low, high in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            if low == high:
                continue
            own = batch.slice(low, high - low)
            if not turns[low]:
                if blocks[low] != block:
                    block, items, ready = blocks[low], [], None
                if ready is None:
                    items += [(i, n, np.frombuffer(w.as_buffer(), U).copy()) for i, n, w in zip(own.column("item_id").to_pylist(), own.column("need").to_pylist(), own.column("words"), strict=True)]
                continue
            if blocks[low] != block:
                continue
            ready = ready or Matcher(items)
            data, offsets = binaries(own.column("words"))
            ends = offsets // 8
            docs, first = own.column("doc").to_pylist(), own.column("first").to_pylist()
            found = [(docs[i], sorted(x - int(ends[i]) + first[i] for x in at), sorted(names)) for i, (at, names) in ready.hits(data.view(U), ends).items()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())), strict=True)], ["doc", "hit_words", "hit_items"])


def hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc, hit_words, hit_items), sorted lists, of the texts of docs (doc, text) that have hits."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = F.sum((F.octet_length("words") / 8).cast("long"))
    items, seen = scratch.measured(rows.mapInArrow(_items(window, coverage), "item_id string, need int, words binary"), "items", words=size, least=F.min(F.when(F.col("need") > 1, F.col("need"))))
    total, least = seen.get("words", 0), seen.get("least")
    found = docs.mapInArrow(_stretches(sieve_of(items), least or 2, window - 1), "doc long, first int, words binary")
    stretches, seen = scratch.measured(found, "stretches", words=size)
    blocks, salts = (max(1, -(-n // most)) for n, most in ((total, BLOCK_WORDS), (seen.get("words", 0), SHARE)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    own = items.withColumn("block", F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)).cast("int")).select("block", each(salts).alias("salt"), F.lit(0).alias("turn"), "item_id", "need", none("long").alias("doc"), none("int").alias("first"), "words")
    streamed = stretches.select(each(blocks).alias("block"), F.pmod(F.xxhash64("doc", "first"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("turn"), none("string").alias("item_id"), none("int").alias("need"), "doc", "first", "words")
    met = own.union(streamed).repartition("block", "salt").sortWithinPartitions("block", "salt", "turn").mapInArrow(released(_match), "doc long, hit_words array<int>, hit_items array<string>")
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  lists of one text
    return scratch.write(met.groupBy("doc").agg(every("hit_words"), every("hit_items")), "hits")


def _attached(docs: DataFrame, benchmark: DataFrame, window: int, coverage: float) -> tuple[DataFrame, DataFrame, str, str]:
    """(docs whose text may have hits, with these; docs whose text has none; the names of the two columns of hits)."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    text = F.col("text").cast("string")
    found = hits(docs.where(text.isNotNull()).select(F.xxhash64(text).alias("doc"), text.alias("text")), benchmark, scratch, window, coverage)
    key, own, at, ids = (fresh(docs.columns, x) for x in ("doc", "own", "at", "ids"))
    found = found.select(F.col("doc").alias(own), F.col("hit_words").alias(at), F.col("hit_items").alias(ids))
    some, rest = split_by_keys(docs.withColumn(key, F.xxhash64(text)), key, found, own)
    return some.join(found, (F.col(key) == F.col(own)) & text.isNotNull(), "left").drop(key, own), rest.drop(key), at, ids


MARKS = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.BinaryType()), T.StructField("hit_items", T.ArrayType(T.StringType()))]


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Adds n_words, hit_words (little-endian 32-bit numbers of the hit words, rising) and hit_items to docs."""
    docs = docs.drop(*[f.name for f in MARKS])
    some, rest, at, ids = _attached(docs, benchmark, window, coverage)
    schema = docs.schema
    both = some.unionByName(rest.withColumn(at, F.lit(None).cast("array<int>")).withColumn(ids, F.lit(None).cast("array<string>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            words = Words(data, offsets, ALNUM, hashed=False)
            hit = pa.array([b"" if x is None else np.array(x, np.uint32).tobytes() for x in rows.column(at).to_pylist()], pa.binary())
            items = pa.array([x or [] for x in rows.column(ids).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in schema.names], pa.array(np.diff(words.rows).astype(np.int64)), hit, items], [*schema.names, *[f.name for f in MARKS]])

    return both.mapInArrow(run, T.StructType([*schema.fields, *MARKS]))


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """docs with every hit stretch of words cut out of ``text`` (and ``n_chars``, if there, set anew where cut)."""
    schema = docs.schema
    some, rest, at, _ = _attached(docs, benchmark, window, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.column(at).to_pylist()
            some = [i for i, x in enumerate(hit) if x]
            columns = {name: batch.column(name) for name in schema.names}
            if some:
                texts = columns["text"].to_pylist()
                for i in some:
                    texts[i] = cut(texts[i], np.array(hit[i], np.uint32))
                columns["text"] = pa.array(texts, batch.schema.field("text").type)
                if "n_chars" in columns:
                    sizes = columns["n_chars"].to_pylist()
                    for i in some:
                        sizes[i] = len(texts[i])
                    columns["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        release()

    return some.mapInArrow(run, schema).union(rest)


def cut(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between neighbouring ones."""
    data, offsets = flat(pa.array([text]))
    words = Words(data, offsets, ALNUM, hashed=False)
    first = np.flatnonzero(np.diff(hit.astype(np.int64), prepend=-2) > 1)
    last = np.append(first[1:] - 1, len(hit) - 1)
    kept, at = [], 0
    for a, b in zip(words.starts[hit[first]].tolist(), words.ends[hit[last]].tolist(), strict=True):
        kept.append(data[at:a].tobytes())
        at = b
    return b"".join([*kept, data[at:].tobytes()]).decode()


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = marked(docs, read(spark, sf_dir, "benchmark"))
    n_hit = (F.octet_length("hit_words") / 4).cast("long")
    ids = F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), ids.alias("items_sha256"), (n_hit > 0).alias("contaminated"))

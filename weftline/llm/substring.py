"""Operator 3: substring dedup by paragraph MinHash banding.

Units of comparison are paragraphs of at least ``least`` words: the lines of a text, and
windows of ``least`` words that run across line ends, so that a passage is found
wherever it stands. Windows open at places chosen by content: of each ``least`` places
in a row the one whose eight-word shingle has the smallest hash. A passage of
2 * ``least`` words or more thus has the same windows in every text. A first pass counts
the opening shingles, which is a band of one minimum; only windows whose opening occurs
again are made.

All units go one way. Equal ones are a class; each class's min-max signature is cut
into bands tuned for recall (lines: 9 of 3 values, a pair of similarity 0.8 is missed with
a chance of 2e-3, one of 0.9 with 8e-6; windows, which are compared where
they open alike: 4 of 3, a pair that differs in two shingles is missed with a chance of
0.04, one that differs in one with 0.01), colliding classes are confirmed by exact Jaccard
similarity of their five-word shingles (0.8 or more), and linked ones form components.
Of a component's occurrences the first, by doc_id and place, stays; all others are
removed. A window that opens as the first one does goes as far to both sides as the words
are the same, so that passages go from their first to their last word and nothing else.
What is confirmed is removed.

Texts that are equal as a whole are compared once; of ``least`` words or more only the one
of the smallest doc_id keeps its words.

Defined results: null and empty texts have no paragraphs and stay as they are; texts of
fewer than ``least`` words stay; very long texts are read whole; a repeated row (same
doc_id, same text) keeps what its twin keeps; rows that share a doc_id but not a text are
apart; rows with a null doc_id come last in the order; ties go to the earlier place; an
empty table gives no rows; further columns are kept, whatever their names. Texts are known
by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, read, split_by_keys
from .minmax import band_keys, signatures
from .near import linked, lists
from .words import BASE, CHUNK_BYTES, FACTORS, INVERSE, NOT_SPACE, U, Words, chunks, flat, mix, powers, release, released, shingles

K, LEAST, OPENING = 5, 25, 8
#: Bands of lines and of windows.
BANDS, WINDOW_BANDS, WIDTH = 9, 4, 3
UNITS = "doc long, doc_id long, start int, end int, key long, n_shingles int, bands array<long>"
WINDOWS = UNITS + ", before array<smallint>, after array<smallint>"
#: Words of the units that are described at a time, about.
SLICE = 200_000


def lines_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of every line, in order."""
    data, n = words.data, len(words.starts)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    breaks = np.flatnonzero(data == 10)
    new = np.zeros(n, bool)
    new[np.searchsorted(words.starts, breaks)[np.searchsorted(words.starts, breaks) < n]] = True
    new[words.rows[:-1][words.rows[:-1] < n]] = True
    first = np.flatnonzero(new)
    return first, np.append(first[1:], n)


def sliding(best: Callable[[np.ndarray, np.ndarray], np.ndarray], values: np.ndarray, n: int) -> np.ndarray:
    """The best of each n values in a row, of stretches that double."""
    size = 1
    while 2 * size <= n:
        values, size = best(values[:-size], values[size:]), 2 * size
    return best(values[: len(values) - n + size], values[n - size :]) if size < n else values


def openings(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``least`` words open, and the hashes of the opening shingles.

    Of ``least`` places in a row, or of a short text's fewer, it is the one of the
    smallest hash; of equal ones that of the smallest number modulo ``least``, so that
    texts of one repeated phrase have no more openings than others.
    """
    n, spread = len(words.starts), least
    counts = np.diff(words.rows)
    places = np.maximum(counts - least + 1, 0)
    if n < least or not places.any():
        return np.empty(0, np.int64), np.empty(0, U)
    whole = np.full(n, np.iinfo(np.uint64).max, U)
    whole[: n - OPENING + 1] = shingles(words.hashes, np.array([0, n]), OPENING)[0]
    own = np.arange(n) - np.repeat(words.rows[:-1], counts)
    value = (whole & ~U(63)) | (own % spread).astype(U) if spread <= 64 else whole.copy()
    value[own >= np.repeat(places, counts)] = np.iinfo(np.uint64).max
    found = []
    full = own[: n - spread + 1] + spread <= np.repeat(places, counts)[: n - spread + 1]
    if spread <= 64:  # values of a stretch are different: a place is the smallest of one if the greatest of the least values around it is its own
        least_of = np.zeros(n + spread - 1, U)
        least_of[spread - 1 : n] = np.where(full, sliding(np.minimum, value, spread), U(0))
        found.append(np.flatnonzero(sliding(np.maximum, least_of, spread) == value))
    each = np.lib.stride_tricks.sliding_window_view(value, spread)
    for i in range(0, len(each) if spread > 64 else 0, 65536):
        some = np.flatnonzero(full[i : i + 65536])
        found.append(np.unique(each[i : i + 65536][some].argmin(1) + some + i))
    short = np.flatnonzero((places > 0) & (places < spread))
    if len(short):
        sizes = places[short]
        at = np.arange(sizes.sum()) + np.repeat(words.rows[:-1][short] - np.cumsum(sizes) + sizes, sizes)
        smallest = np.minimum.reduceat(value[at], np.cumsum(sizes) - sizes)
        found.append(at[value[at] == np.repeat(smallest, sizes)])
    at = np.unique(np.concatenate(found))
    return at, whole[at]


def described(words: Words, first: np.ndarray, end: np.ndarray, bands: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of words, by slices of them: keys of their content, numbers of shingles, and bands."""
    done = np.zeros(len(first) + 1, np.int64)
    np.cumsum(end - first, out=done[1:])
    low = 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(done, done[low] + SLICE, "right")) - 1)
        at = done[low : high + 1] - done[low]
        own = np.arange(at[-1]) + np.repeat(first[low:high] - at[:-1], np.diff(at))
        hashes = words.hashes[own]
        sums = np.zeros(len(hashes) + 1, U)
        np.cumsum(hashes * powers(BASE, len(hashes)), out=sums[1:])
        keys = mix((sums[at[1:]] - sums[at[:-1]]) * powers(INVERSE, len(sums))[at[:-1]] + np.diff(at).astype(U)).view(np.int64)
        sets, ends = shingles(hashes, at, K)
        yield slice(low, high), keys, np.diff(ends), band_keys(signatures(sets, ends, -(-bands * WIDTH // 2)), bands, WIDTH)
        low = high


def _rows(rows: pa.RecordBatch, words: Words, first: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """doc, doc_id, start and end (words of the row) of stretches of words."""
    row = np.searchsorted(words.rows, first, "right") - 1
    take, base = pa.array(row), words.rows[row]
    return [rows.column("doc").take(take), rows.column("doc_id").take(take), pa.array((first - base).astype(np.int32)), pa.array((end - base).astype(np.int32))]


def paragraphs(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc, doc_id, text) to their lines, and to the openings of windows: these have doc, start and the opening's key alone."""
    names = [x.split()[0] for x in UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            words = Words(data, offsets, NOT_SPACE)
            first, end = lines_of(words)
            long = end - first >= least
            first, end = first[long], end[long]
            for own, keys, sizes, bands in described(words, first, end, BANDS):
                yield pa.RecordBatch.from_arrays([*_rows(rows, words, first[own], end[own]), pa.array(keys), pa.array(sizes.astype(np.int32)), lists(list(bands))], names)
            at, keys = openings(words, least)
            if len(at):
                doc, _, start, _ = _rows(rows, words, at, at)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                doc_id, end, size, bands = (pa.nulls(len(at), k) for k in kinds)
                yield pa.RecordBatch.from_arrays([doc, doc_id, start, end, pa.array(keys.view(np.int64)), size, bands], names)

    return run


def around(words: Words, first: np.ndarray, before: int, after: int) -> tuple[pa.ListArray, pa.ListArray]:
    """16-bit hashes of up to ``before`` words before each place within its row, the nearest first, and of up to ``after`` from there on."""
    short = (words.hashes >> U(48)).astype(np.uint16).view(np.int16)
    row = np.searchsorted(words.rows, first, "right") - 1
    out = []
    for sizes, start, step in ((np.minimum(first - words.rows[row], before), first - 1, -1), (np.minimum(words.rows[row + 1] - first, after), first, 1)):
        ends = np.zeros(len(first) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        at = np.repeat(start, sizes) + step * (np.arange(ends[-1]) - np.repeat(ends[:-1], sizes))
        out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(short[at])))
    return out[0], out[1]


def windows(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc, doc_id, text, wanted: first words) to the windows that open there."""
    names = [x.split()[0] for x in WINDOWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            words = Words(data, offsets, NOT_SPACE)
            wanted = rows.column("wanted")
            sizes = pc.list_value_length(wanted).to_numpy(zero_copy_only=False)
            first = np.asarray(wanted.flatten(), np.int64) + np.repeat(words.rows[:-1], sizes)
            if not len(first):
                continue
            opening = shingles(words.hashes, np.array([0, len(words.hashes)]), OPENING)[0][first].view(np.int64)
            for own, keys, counts, bands in described(words, first, first + least, WINDOW_BANDS):
                at = first[own]
                keys = mix(keys.view(U) + FACTORS[44]).view(np.int64)  # a line of the same words is another class
                bands = mix(bands.view(U) ^ opening[own, None].view(U)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*_rows(rows, words, at, at + least), pa.array(keys), pa.array(counts.astype(np.int32)), lists(list(bands)), *around(words, at, least, 2 * least)], names)

    return run


def unit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted: list of (start, end, f1)) to the wanted units' whole shingle sets."""
    for rows, data, offsets in chunks(batches):
        words = Words(data, offsets, NOT_SPACE)
        wanted = rows.column("wanted")
        base = np.repeat(words.rows[:-1], pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
        fields = wanted.flatten()
        first, end, names = (np.asarray(fields.field(x), np.int64) for x in ("start", "end", "f1"))
        ids, found, kept = [], [], 0
        for a, b, f1 in zip((first + base).tolist(), (end + base).tolist(), names.tolist(), strict=True):
            own = np.unique(shingles(words.hashes[a:b], np.array([0, b - a]), K)[0]).tobytes()
            ids.append(f1)
            found.append(own)
            kept += len(own)
            if kept > CHUNK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["f1", "items"])
                ids, found, kept = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["f1", "items"])


def without(text: str, start: np.ndarray, end: np.ndarray) -> tuple[str, int, int]:
    """The text without these spans of words, how many stretches were cut, and their words."""
    data, offsets = flat(pa.array([text]))
    words = Words(data, offsets, NOT_SPACE, hashed=False)
    n = len(words.starts)
    on = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(np.minimum(end, n), minlength=n + 1)) > 0
    edges = np.flatnonzero(np.diff(on, prepend=False)).reshape(-1, 2)
    kept, at = [], 0
    for a, b in edges.tolist():
        low, high = int(words.starts[a]), int(words.ends[b - 1])
        if (not low or data[low - 1] == 10) and high < len(data) and data[high] == 10:
            high += 1  # whole lines go with their line end
        kept.append(data[at:low].tobytes())
        at = max(at, high)
    return b"".join([*kept, data[at:].tobytes()]).decode(), len(edges), int((edges[:, 1] - edges[:, 0]).sum())


def shared(x: str, y: str) -> Column:
    """How many leading elements two arrays have in common; 0 where one is null."""
    same = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at.isNull(), 0).when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def removals(docs: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(doc, spans): what goes from each text of docs (doc, doc_id, text), each of which is there once."""
    found = scratch.write(docs.mapInArrow(paragraphs(least), UNITS), "units")

    # Windows: openings that occur again, counted before their rows are shuffled.
    opened = found.where("n_shingles is null").select("doc", "start", "key")
    again = scratch.write(opened.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "openings")
    scratch.sweep()
    wanted = split_by_keys(opened, "key", again, "key")[0].join(again, "key").groupBy("doc").agg(F.collect_set("start").alias("wanted"))  # openings of one text
    wanted = scratch.write(wanted, "wanted")
    lines = scratch.write(found.where("n_shingles is not null"), "lines")
    for name in ("units", "openings"):
        scratch.drop(name)
    scratch.sweep()
    some, _ = split_by_keys(docs, "doc", wanted, "doc")
    made = scratch.write(some.join(wanted, "doc").select("doc", "doc_id", "text", "wanted").mapInArrow(windows(least), WINDOWS), "windows")
    scratch.drop("wanted")
    scratch.sweep()

    # Classes of equal units, lines and windows alike: banded, confirmed, clustered.
    units = lines.unionByName(made.drop("before", "after"))
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "start", "doc", "end")
    per = units.groupBy(F.col("key").alias("node")).agg(F.count("*").alias("copies"), F.min(place).alias("least"), F.first("n_shingles").cast("long").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = scratch.write(per, "classes")
    scratch.sweep()

    def fetch(nodes: DataFrame) -> DataFrame:
        at = nodes.join(classes.select("node", "least"), "node").select(F.col("least.doc").alias("doc"), F.struct(F.col("least.start").alias("start"), F.col("least.end").alias("end"), F.col("node").alias("f1")).alias("one"))
        at = scratch.write(at.groupBy("doc").agg(F.collect_list("one").alias("wanted")), "fetched")  # units of one text
        some, _ = split_by_keys(docs.select("doc", "text"), "doc", at, "doc")
        return some.join(at, "doc").select("text", "wanted").mapInArrow(unit_sets, "f1 long, items binary")

    groups = linked(classes.select("node", "copies", "n_shingles", "bands"), fetch, scratch, 80, 100)
    parts = classes.select("node", "copies", "least").join(groups, "node", "left").where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "node"))
    parts = scratch.write(parts, "parts")
    for name in ("classes", "fetched"):
        scratch.drop(name)
    scratch.sweep()

    # All occurrences but each component's first. Units that overlap it are near it, but no repeats: such a class has a first of its own.
    first = parts.groupBy("component").agg(F.min(F.struct("least", "node")).alias("first"))
    mine, its = F.struct("least", "node"), F.col("first")
    overlaps = (F.col("least.doc") == its["least"]["doc"]) & (F.col("least.start") < its["least"]["end"])
    stay = parts.join(first, "component").select(F.col("node").alias("key"), F.when(overlaps, mine).otherwise(its).alias("stay"))
    stay = scratch.write(stay.select("key", F.col("stay.least.doc").alias("own"), F.col("stay.least.start").alias("at"), F.col("stay.least.end").alias("own_end"), F.col("stay.node").alias("own_key")), "stay")
    scratch.drop("parts")
    repeats = F.expr("doc <> own or start >= own_end")
    whole = lines.select("key", "doc", "start", "end").join(stay, "key").where(repeats).select("doc", "own", "own_end", "start", "end")

    # A window that opens as the first one does goes as far as the words are the same, any other unit as it is.
    its = stay.select("own", "at", "own_key").distinct().join(made.select(F.col("key").alias("own_key"), F.col("doc").alias("own"), F.col("start").alias("at"), F.col("before").alias("own_before"), F.col("after").alias("own_after")), ["own", "at", "own_key"])
    its = scratch.write(its, "contexts")
    scratch.sweep()
    near = made.select("key", "doc", "start", "end", "before", "after").join(stay, "key").where(repeats).join(its, ["own", "at", "own_key"], "left")
    near = near.withColumn("same", shared("after", "own_after"))
    aligned = F.col("same") >= OPENING
    start = F.when(aligned, F.col("start") - shared("before", "own_before")).otherwise(F.col("start"))
    end = F.when(aligned, F.col("start") + F.col("same")).otherwise(F.col("end"))
    spans = near.select("doc", "own", "own_end", start.alias("start"), end.alias("end")).union(whole)
    low = F.when(F.col("doc") == F.col("own"), F.greatest("start", "own_end")).otherwise(F.col("start"))  # a text's repeat of itself spares its first
    spans = spans.select("doc", F.struct(low.alias("start"), "end").alias("span")).where("span.start < span.end")
    spans = scratch.write(spans.groupBy("doc").agg(F.collect_set("span").alias("spans")), "spans")  # spans of one text
    for name in ("lines", "windows", "stay", "contexts"):
        scratch.drop(name)
    scratch.sweep()
    return spans


def deduplicated(docs: DataFrame, spark: SparkSession, least: int = LEAST, removed: str = "__n_removed", words: str = "__removed_words") -> DataFrame:
    """docs with repeated passages of ``least`` words or more removed from ``text``, and how many stretches and words went.

    ``removed`` and ``words`` name these two columns. ``n_chars``, where the schema has it,
    follows the text: it counts characters.
    """
    scratch = Scratch(spark, "substring")
    schema = docs.schema
    doc, own, spans_, copy, least_id = (fresh([*docs.columns, removed, words], x) for x in ("doc", "own", "spans", "copy", "least_id"))
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    keyed = docs.withColumn(doc, F.xxhash64(text))

    # Equal texts: the one of the smallest doc_id stands for all.
    order = F.struct(doc_id.isNull().alias("nameless"), doc_id.alias("id"))
    size = F.coalesce(F.octet_length(text), F.lit(0))
    copied = keyed.where(size > 0).groupBy(doc, F.xxhash64(F.lit("again"), text).alias("guard"), size.alias("size")).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    copied = scratch.write(copied.select(F.col(doc).alias(own), F.col("first.id").alias(least_id)), "copied")
    texts = keyed.select(F.col(doc).alias("doc"), doc_id.alias("doc_id"), text.alias("text"))
    some, rest = split_by_keys(texts, "doc", copied, own)
    known = some.join(copied, F.col("doc") == F.col(own), "left")
    chosen = known.where(F.col(own).isNotNull() & F.col("doc_id").eqNullSafe(F.col(least_id)))
    single = rest.union(known.where(F.col(own).isNull()).select("doc", "doc_id", "text")).union(chosen.select("doc", "doc_id", "text").dropDuplicates(["doc"]))
    spans = removals(single, scratch, least)

    spans = spans.select(F.col("doc").alias(own), F.col("spans").alias(spans_))
    some, rest = split_by_keys(keyed, doc, spans.select(own).union(copied.select(own)), own)
    joined = some.join(spans, some[doc] == spans[own], "left").drop(own).join(copied, F.col(doc) == F.col(own), "left")
    joined = joined.withColumn(copy, F.col(own).isNotNull() & ~doc_id.eqNullSafe(F.col(least_id))).drop(own, least_id, doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(schema.names)}
            spans, copies, n = batch.column(spans_), np.asarray(batch.column(copy)), batch.num_rows
            stretches, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
            some = np.flatnonzero(np.asarray(spans.is_valid()) | copies).tolist()
            if some:
                texts = columns["text"].to_pylist()
                sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else None
                ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)))
                low, high = (np.asarray(spans.flatten().field(x)) for x in ("start", "end"))
                for i in some:
                    if copies[i]:
                        a, b = np.array([0]), np.array([len(Words(*flat(pa.array([texts[i]])), NOT_SPACE, hashed=False).starts)])
                        if b[0] < least:
                            continue
                    else:
                        a, b = low[ends[i] : ends[i + 1]], high[ends[i] : ends[i + 1]]
                    texts[i], stretches[i], counts[i] = without(texts[i], a, b)
                    if sizes is not None and stretches[i]:
                        sizes[i] = len(texts[i])
                columns["text"] = pa.array(texts, batch.schema.field("text").type)
                if sizes is not None:
                    columns["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(stretches), pa.array(counts)], [*columns, removed, words])
        release()

    found = joined.mapInArrow(released(run), T.StructType([*schema.fields, T.StructField(removed, T.LongType()), T.StructField(words, T.LongType())]))
    none = F.lit(0).cast("long")
    return found.unionByName(rest.drop(doc).withColumn(removed, none).withColumn(words, none))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"), spark, removed="n_removed", words="removed_words")
    return found.select("doc_id", "text", "n_removed", "removed_words")

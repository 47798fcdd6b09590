"""Operator 2: near-duplicate documents by min-max hashing, exact links and components.

1. Each text becomes its set of word shingles (64-bit hashes); texts with equal sets
   are one class, known by a 128-bit fingerprint, so copies cost one row each.
2. A class's min-max signature (60 permutations, 120 values) is cut into 24 bands of
   5 values. Two sets of similarity 0.8 share a band but for a chance of 1e-4, of
   0.85 but for 2e-6. Sets of at most ``FEW`` shingles get exact keys besides: their own
   and those of their subsets of one or two fewer, so that links among them are never missed.
3. In each bucket all classes are compared with one of them, the most copied: a star,
   never all pairs. Links are confirmed on full sets, and linked classes merged. A
   pivot's set goes to a task once for thousands of members.
4. Classes in buckets of three or more that are still in several components are banded
   again, by 224 further permutations into 56 bands of 8 values (similarity 0.8: missed
   with a chance of 3e-5; 0.5: shared with 0.2), with stars of four other pivots; no pair is
   compared again, and buckets of five or fewer are mostly settled by these.
5. Finer buckets that are even then in several components are decided exactly, one of
   those with the same members: classes are dealt over blocks of bounded size, each
   pair of blocks is a task, and a task multiplies incidence matrices of the shingles
   that occur more than once, so that every pair is seen while only a spanning set of
   links comes out.

Defined results: null, empty and wordless texts have no shingles and no links; texts
of fewer words than a shingle are one shingle; very long texts are read whole; repeated
rows are copies; rows that share a doc_id but not a text are two nodes; a null doc_id is
never the smallest unless a group has no other; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, read, split_by_keys
from .graph import components
from .minmax import band_keys, signatures
from .words import FACTORS, NOT_SPACE, U, Words, binaries, chunks, mix, release, released, shingles

PERMUTATIONS, BANDS, WIDTH = 60, 24, 5
FINER_PERMUTATIONS, FINER_BANDS, FINER_WIDTH = 224, 56, 8
#: Sets of so many shingles at most get exact keys too.
FEW = 10
#: Members of a pivot that one task compares with it, about.
STAR = 5_000
#: Pivots of a finer bucket.
PIVOTS = 4
#: Shingles and classes in one block of a bucket, about; blocks are compared two at a time.
BLOCK, BLOCK_CLASSES = 100_000, 400


def sets_of(batches: Iterator[pa.RecordBatch], k: int):
    """For each chunk: the rows, the rows' sorted distinct shingles, and their offsets."""
    for rows, data, offsets in chunks(batches):
        words = Words(data, offsets, NOT_SPACE)
        hashes, at = shingles(words.hashes, words.rows, k)
        own = [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        sizes = np.array([len(x) for x in own], np.int64)
        ends = np.zeros(len(own) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        yield rows, np.concatenate(own) if own else np.empty(0, U), ends


def fingerprints(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; zero for an empty one."""
    out = []
    for salt in (FACTORS[40], FACTORS[41]):
        sums = np.zeros(len(hashes) + 1, U)
        np.cumsum(mix(hashes * salt), out=sums[1:])
        out.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def few_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set of at most FEW shingles: any two such sets of similarity 0.8 share one.

    Two sets that differ in d shingles share the key of what is left of both. Similarity
    0.8 allows one differing shingle in a union of five to nine, two in one of ten.
    """
    parts = mix(hashes * FACTORS[42])
    total = parts.sum(dtype=U)
    out = [total[None], total - parts]
    if len(parts) >= 9:
        i, j = np.triu_indices(len(parts), 1)
        out.append(total - parts[i] - parts[j])
    return mix(np.concatenate(out) + FACTORS[43]).view(np.int64)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))


def _classes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, ends in sets_of(batches, k):
            sizes = np.diff(ends)
            some = np.flatnonzero(sizes)
            first, second = fingerprints(hashes, ends)
            bands = [np.empty(0, np.int64)] * len(sizes)
            if len(some):
                for i, keys in zip(some.tolist(), band_keys(signatures(hashes, np.append(ends[:-1][some], len(hashes)), PERMUTATIONS), BANDS, WIDTH), strict=True):
                    bands[i] = keys if sizes[i] > FEW else np.concatenate([keys, few_keys(hashes[ends[i] : ends[i + 1]])])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("h"), pa.array(sizes), pa.array(first), pa.array(second), lists(bands)], ["doc_id", "h", "n_shingles", "f1", "f2", "bands"])

    return run


def _full(k: int):
    """(class, its whole set) of the rows whose class is the wanted one; a task gives a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, hashes, ends in sets_of(batches, k):
            first, _ = fingerprints(hashes, ends)
            some = []
            for i in np.flatnonzero(first == np.asarray(rows.column("f1"))).tolist():
                if int(first[i]) not in seen:
                    seen.add(int(first[i]))
                    some.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(first[some]), pa.array([hashes[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary())], ["f1", "items"])

    return run


def alike(pivot: np.ndarray, hashes: np.ndarray, ends: np.ndarray, num: int, den: int) -> np.ndarray:
    """Numbers of the sets (sorted hashes between ends) that are linked with the pivot."""
    at = np.searchsorted(pivot, hashes)
    at[at == len(pivot)] = 0
    shared = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(pivot[at] == hashes, out=shared[1:])
    both = shared[ends[1:]] - shared[ends[:-1]]
    return np.flatnonzero(den * both >= num * (len(pivot) + np.diff(ends) - both))


def _confirm(num: int, den: int):
    """Rows (b, salt, turn, a, items), each pivot's own row (turn 0) before its members', to the links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, np.empty(0, U)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = binaries(batch.column("items"))
            hashes, ends = data.view(U), offsets // 8
            b, salt, turn = (np.asarray(batch.column(c)) for c in ("b", "salt", "turn"))
            edges = np.unique(np.concatenate([[0], np.flatnonzero(turn == 0), [len(b)]])).tolist()
            keep = [np.empty(0, np.int64)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if not turn[low]:
                    key, pivot = (b[low], salt[low]), hashes[ends[low] : ends[low + 1]].copy()
                    low += 1
                if low < high and key == (b[low], salt[low]):
                    keep.append(low + alike(pivot, hashes[ends[low] : ends[high]], ends[low : high + 1] - ends[low], num, den))
            yield batch.select(["a", "b"]).take(pa.array(np.concatenate(keep)))

    return released(run)


def among(full: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Whole sets (name, items) that a join with these nodes can need: the others aren't shuffled."""
    return split_by_keys(full, "f1", nodes, name)[0].withColumnRenamed("f1", name)


def confirmed(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets (f1, items) are linked; pairs: a written table.

    Members of a pivot b are split over tasks of about STAR of them, and the pivot's set
    goes once to each of these.
    """
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    own = pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"))
    # Members and pivots ask for their sets together, so that a set is shuffled to them once.
    places = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    asked = own.select(F.col("a").alias("f1"), "b", "salt", F.lit(1).alias("turn")).union(salts.select(F.col("b").alias("f1"), "b", places, F.lit(0).alias("turn")))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    rows = asked.join(among(full, nodes, "node").withColumnRenamed("node", "f1"), "f1").select("b", "salt", "turn", F.col("f1").alias("a"), "items")
    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "turn").mapInArrow(_confirm(num, den), "a long, b long")


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, component, items) to (node, component, bands) by permutations that no earlier band used."""
    for batch in batches:
        data, offsets = binaries(batch.column("items"))
        hashes, ends, low = data.view(U), offsets // 8, 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + BLOCK, "right")) - 1)
            values = signatures(hashes[ends[low] : ends[high]], ends[low : high + 1] - ends[low], FINER_PERMUTATIONS, PERMUTATIONS)
            own = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([own.column("node"), own.column("component"), lists(list(band_keys(values, FINER_BANDS, FINER_WIDTH, BANDS)))], ["node", "component", "bands"])
            low = high
    release()


def spanning(sets: list[np.ndarray], group: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links den * intersection >= num * union that join sets of different groups, enough to connect them."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    row = np.repeat(np.arange(n), sizes)
    common = counts[inverse] > 1
    rows, cols, width = row[common], column[inverse[common]], int((counts > 1).sum())
    both = np.zeros((n, n), np.float32)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    edges = np.searchsorted(cols, np.arange(0, width + 2048, 2048))
    for a, b, low in zip(edges[:-1].tolist(), edges[1:].tolist(), range(0, width + 2048, 2048), strict=False):
        if b > a:
            m = np.zeros((n, min(2048, width - low)), np.float32)
            m[rows[a:b], cols[a:b] - low] = 1
            both += m @ m.T
    shared = both.astype(np.int64)
    linked = den * shared >= num * (sizes[:, None] + sizes[None, :] - shared)
    group, found = group.copy(), []
    left, right = np.nonzero(np.triu(linked, 1) & (group[:, None] != group[None, :]))
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        if group[x] != group[y]:
            found.append((x, y))
            group[group == group[y]] = group[x]
    return found


def _blocks(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        ids, first = np.unique(np.asarray(table.column("f1").combine_chunks()), return_index=True)
        found = []
        if len(ids) > 1:
            items, component = table.column("items").combine_chunks(), np.asarray(table.column("component").combine_chunks())
            found = spanning([np.frombuffer(items[i].as_buffer(), U) for i in first.tolist()], np.unique(component[first], return_inverse=True)[1], num, den)
        release()
        return pa.table({"a": pa.array(ids[[x for x, _ in found]], pa.int64()), "b": pa.array(ids[[y for _, y in found]], pa.int64())})

    return run


def gathered(rows: DataFrame, ranks: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """Members (key, node, component, pivots, n, print) of the band keys that several nodes have.

    rows: node, component, rank, bands, a written table. A key's pivots (node, component) are
    the nodes that each of the ranks puts first; n and print are the same for keys with the
    same nodes.
    """
    # Keys are counted first, so that only (key, count) is shuffled for those that one node has.
    banded = rows.select("node", "component", "rank", F.explode("bands").alias("key"))
    shared = scratch.write(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), f"{name}-shared")
    scratch.sweep()
    held = scratch.write(split_by_keys(banded, "key", shared, "key")[0].join(shared, "key"), f"{name}-held")
    scratch.sweep()
    tops = [F.max(F.struct(r.alias("rank"), "node", "component")).alias(f"top{i}") for i, r in enumerate(ranks)]
    buckets = held.groupBy("key").agg(*tops, F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("print"))
    pivots = F.array_distinct(F.array(*[F.struct(F.col(f"top{i}.node").alias("node"), F.col(f"top{i}.component").alias("component")) for i in range(len(ranks))]))
    members = scratch.write(held.drop("rank").join(buckets.select("key", pivots.alias("pivots"), "n", "print"), "key"), f"{name}-members")
    scratch.drop(f"{name}-shared")
    scratch.drop(f"{name}-held")
    return members


def stars(members: DataFrame) -> DataFrame:
    """Every node of a key against its pivots, once for each pair (a, b), where their components differ."""
    each = members.select("node", "component", F.explode("pivots").alias("b"))
    return each.where("component <> b.component").select(F.col("node").alias("a"), F.col("b.node").alias("b")).distinct()


def still_open(members: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(members with their components by now, keys of several components), of keys that stars don't settle.

    Where all nodes of a key but one have been pivots, all its pairs have been compared.
    """
    now = members.where("n > size(pivots) + 1").select("key", "node", "component", "n", "print").join(found.withColumnRenamed("component", "part"), "node", "left")
    now = scratch.write(now.select("key", "node", F.coalesce("part", "component").alias("component"), "n", "print"), name)
    keys = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("n").alias("n"), F.first("print").alias("print")).where("low <> high")
    return now, keys.select("key", "n", "print")


def linked(classes: DataFrame, fetch: Callable[[DataFrame], DataFrame], scratch: Scratch, num: int, den: int) -> DataFrame:
    """(node, component) of the classes that have a link.

    classes: node, copies, n_shingles, bands, one row each. fetch: from nodes (node) to
    their whole sets (f1, items), rows of other nodes or repeated ones being harmless.
    """
    members = gathered(classes.select("node", F.col("node").alias("component"), F.col("copies").alias("rank"), "bands"), [F.col("rank")], scratch, "first")
    pairs = scratch.write(stars(members), "pairs")
    full = scratch.write(fetch(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "full")
    scratch.sweep()
    links = scratch.write(confirmed(pairs, full, num, den), "links")
    found = scratch.write(components(links, scratch, "first"), "found")

    # Finer bands and other pivots for the nodes of buckets that are in several components.
    now, keys = still_open(members, found, scratch, "open")
    loose, some = scratch.counted(now.join(keys.select("key"), "key").select("node", "component").distinct(), "loose")
    scratch.drop("first-members")
    scratch.sweep()
    if some:
        sets = among(full, loose, "node").join(loose, "node")
        finer = scratch.write(sets.select("node", "component", "items").mapInArrow(_finer, "node long, component long, bands array<long>"), "finer")
        members = gathered(finer.withColumn("rank", F.lit(0)), [F.xxhash64(F.lit(i), F.col("node")) for i in range(PIVOTS)], scratch, "second")
        known = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = scratch.write(stars(members).join(known, ["a", "b"], "left_anti"), "finer-pairs")
        more, some = scratch.counted(confirmed(pairs, full, num, den), "finer-links")
        if some:
            edges = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = scratch.write(components(edges.union(more), scratch, "second"), "finer-found")

        # What is open even so is decided exactly; of keys with the same nodes, one.
        now, keys = still_open(members, found, scratch, "finer-open")
        weights = classes.select("node", "n_shingles")
        one = keys.groupBy("print", "n").agg(F.min("key").alias("key"))
        sizes = now.join(one.select("key"), "key").join(weights, "node").groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
        blocks = sizes.select("key", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("n") / BLOCK_CLASSES)).cast("int").alias("blocks"))
        blocks = scratch.write(blocks, "blocks")
        left = scratch.write(now.select("key", "node", "component").join(blocks, "key"), "dealt")
        dealt = left.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("node").alias("f1"), "component")
        last, some = scratch.counted(dealt.join(among(full, left.select(F.col("node").alias("f1")), "f1"), "f1").groupBy("key", "i", "j").applyInArrow(_blocks(num, den), "a long, b long"), "block-links")
        if some:
            edges = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = components(edges.union(last), scratch, "last")
    found = scratch.write(found, "groups")
    for name in ("open", "loose", "full", "pairs", "links", "found", "finer", "second-members", "finer-pairs", "finer-links", "finer-found", "finer-open", "blocks", "dealt", "block-links"):
        scratch.drop(name)
    scratch.sweep()
    return found


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and h, a hash of the text that tells apart texts under one doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def decided(docs: DataFrame, scratch: Scratch, k: int, num: int, den: int) -> DataFrame:
    """doc_id, h, n_shingles and component_id of the rows of docs (doc_id, text, h)."""
    rows = scratch.write(docs.mapInArrow(_classes(k), "doc_id long, h long, n_shingles long, f1 long, f2 long, bands array<long>"), "rows")

    # Classes: equal sets are one node. f1 names the node, f2 guards against a chance match.
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h")
    per = rows.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min(place).alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = scratch.write(per.select("f1", "f2", F.col("f1").alias("node"), "n_shingles", F.col("least.doc_id").alias("least"), F.col("least.h").alias("at"), "copies", "bands"), "classes")

    def fetch(wanted: DataFrame) -> DataFrame:
        at = scratch.write(wanted.join(classes, "node").select(F.col("least").alias("own"), "at", F.col("node").alias("f1")), "wanted")
        some, _ = split_by_keys(docs, "doc_id", at, "own")
        return some.join(at, some["doc_id"].eqNullSafe(at["own"]) & (some["h"] == at["at"])).select("text", "f1").mapInArrow(_full(k), "f1 long, items binary")

    found = linked(classes.select("node", "copies", "n_shingles", "bands"), fetch, scratch, num, den)

    # Each class's smallest reachable doc_id, then each row's.
    parts = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    named = parts.select("f1", "f2", "n_shingles", "component").join(least, "component").drop("component")
    columns = ("doc_id", "h", "n_shingles", "component_id")
    out = rows.where("n_shingles > 0").join(named, ["f1", "f2", "n_shingles"]).select(*columns)
    return out.union(rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(*columns))


def near_duplicates(docs: DataFrame, spark: SparkSession, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links are den * intersection >= num * union of k-word shingles."""
    found = decided(texts_of(docs), Scratch(spark, "near"), k, num, den)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, spark: SparkSession, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs of which one document of each near-duplicate group stays, that of the smallest doc_id.

    Null, empty and wordless texts are linked with nothing and stay; texts that share a
    doc_id all stay if one of them does; of rows that repeat doc_id and text, null or
    empty ones too, one stays; very long texts are compared whole; an empty table stays
    empty; further columns are kept, whatever their names.
    """
    scratch = Scratch(spark, "kept")
    texts = texts_of(docs)
    found = scratch.write(decided(texts, scratch, k, num, den).select("doc_id", "h", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "decided")
    per = scratch.write(found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "marked")
    own, key, h = (fresh(docs.columns, x) for x in ("own", "key", "h"))
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    gone = per.where("not kept").select(F.col("doc_id").alias(own))
    some, rest = split_by_keys(keyed, key, gone, own)
    rest = rest.union(some.join(gone, F.col(key).eqNullSafe(F.col(own)), "left_anti"))
    several = per.where("kept and n > 1").select(F.col("doc_id").alias(own))
    some, rest = split_by_keys(rest, key, several, own)
    once = some.withColumn(h, F.struct(F.xxhash64(F.col("text").cast("string")), F.sha2(F.col("text").cast("string"), 256))).dropDuplicates([key, h])
    return rest.union(once.drop(h)).drop(key)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), spark, k=4)

"""Operator 12: two tokenizations of a text aligned at the byte cuts that both share.

A text stands behind one space. The byte-level vocabulary A is applied to space and text;
the piece vocabulary B puts the space there itself. Both give tokens whose bytes, joined, are that
byte string (else the document counts as having no tokens), so for a chunk of texts:

* one bitset a tokenizer marks the byte at which each of its tokens ends;
* the AND of the two marks the cuts that both share, which end the groups;
* popcount ranks at the cuts say which tokens of A and of B a group has, and ranks in the
  other bitset say which tokens of B each token of A overlaps: these are its links.

A link's weight is the number of documents, of the whole corpus, that hold its pair of ids
linked. Documents give each of their pairs once, with how often they have it, and are counted
by pair after combining in the tasks. The counts go back in two ways: pairs that
have more than 1 / HEAVY of all entries are fewer than HEAVY, whatever the corpus is, and are
broadcast; all others are joined by pair, none of which is frequent. So a pair that
every document holds meets no single task.

Encoding: neither vocabulary has a token that goes on from a word over a space or line feed
(checked on loading), so ids of a text are those of its words in a row, each with the one
space or line feed before it. Words repeat and are looked up, as in encoding.py. Texts with
other or doubled white space, or control characters, are encoded whole. A's merges are
those of its file, run by tiktoken; tests compare both with the tokenizers themselves.

Defined results: null and empty texts, and those whose tokens don't spell them, have no
tokens, no groups, no links and an empty ``groups``; very long texts are aligned whole;
repeated rows are documents each and count each; of equally frequent partners each is the
best; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, read, ship
from .words import U, Words, chunks, held, mix

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of ids whose counts are broadcast: at most so many, 16 bytes each.
HEAVY = 500_000
#: Slots (a power of two) and ids kept by one worker: 80 MB. Full arrays are emptied.
SLOT_BITS, IDS = 21, 6_000_000
#: Ids of either vocabulary are below 2^ID_BITS.
ID_BITS = 20
UNIT = np.ones(256, bool)
UNIT[[0x20, 0x0A]] = False
#: First two bytes, and the third ones, of white space beyond ASCII in UTF-8; two bytes for U+0085 and U+00A0.
WHITE = {(0xC2, 0x85): None, (0xC2, 0xA0): None, (0xE1, 0x9A): (0x80,), (0xE2, 0x80): (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), (0xE2, 0x81): (0x9F,), (0xE3, 0x80): (0x80,)}
_loaded: dict[tuple[str, str], Encoder] = {}
held.append(_loaded)


def odd_places(data: np.ndarray) -> np.ndarray:
    """Places of control characters and of white space other than spaces and line feeds."""
    out = [np.flatnonzero(((data < 0x20) & (data != 0x0A)) | (data == 0x7F))]
    leads = np.flatnonzero(data[:-1] >= 0xC2)
    leads = leads[np.isin(data[leads], [x for x, _ in WHITE])]
    for (first, second), thirds in WHITE.items():
        at = leads[(data[leads] == first) & (data[leads + 1] == second)]
        out.append(at if thirds is None else at[np.isin(data[at + 2], thirds)])
    return np.concatenate(out)


class Encoder:
    """Ids and byte lengths of both tokenizers for words with the space or line feed before them."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            told = json.load(file)
        special = {t["content"] for t in told["added_tokens"] if t["special"]}
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        shown = {chr(b) if b in letters else chr(next(rest)): b for b in range(256)}
        ranks = {bytes(shown[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        inner = [p for p in pieces if "▁" in p.lstrip("▁") or "\n" in p]
        self.by_word = not inner  # A's split rule keeps its tokens from it
        self.a_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.a_bytes[i] = len(token)
        self.a_token = {i: t for t, i in ranks.items()}
        self.b_token = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_bytes = np.array([len(t) for t in self.b_token], np.int64)
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError("a vocabulary has more ids than a pair has room for")
        self._empty()

    def _empty(self) -> None:
        self.keys = np.full(1 << SLOT_BITS, 2**64 - 1, U)
        self.keys[-1] = 0  # no slot has a key that belongs to it
        self.at = np.zeros((4, 1 << SLOT_BITS), np.int32)  # start and size in the ids of A, then of B; a size of -1: not spelt
        self.ids = [np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)]
        self.n = [0, 0]

    def spelt(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of space and text by A, and of text by B; none where they don't spell it."""
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        want = (" " + text).encode()
        if b"".join(map(self.a_token.__getitem__, a)) != want or b"".join(map(self.b_token.__getitem__, b)) != want:
            return [], []
        return a, b

    def _units(self, units: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Of words with the separator before them: both lists of ids; None where they don't spell the word."""
        out: list[tuple[list[int], list[int]] | None] = []
        # B begins each text with a space: of a line feed that is one token before it
        whole = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for unit, b in zip(units, whole, strict=True):
            a = self.a.encode_ordinary(unit)
            b = b if unit[0] == " " else b[1:]
            fits = b"".join(map(self.a_token.__getitem__, a)) == b"".join(map(self.b_token.__getitem__, b)) == unit.encode()
            out.append((a, b) if fits else None)
        return out

    def _keep(self, made: list[tuple[list[int], list[int]] | None]) -> np.ndarray:
        """Starts and sizes of these lists, which are put behind the others."""
        out = np.empty((4, len(made)), np.int32)
        for side in (0, 1):
            sizes = np.array([len(x[side]) if x else 0 for x in made], np.int32)
            out[2 * side] = self.n[side] + np.cumsum(sizes) - sizes
            total = self.n[side] + int(sizes.sum())
            if total > len(self.ids[side]):
                self.ids[side] = np.concatenate([self.ids[side][: self.n[side]], np.empty(total, np.int32)])
            self.ids[side][self.n[side] : total] = np.fromiter(chain.from_iterable(x[side] for x in made if x), np.int32, total - self.n[side])
            self.n[side] = total
            out[2 * side + 1] = [len(x[side]) if x else -1 for x in made]
        return out

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For A and for B: the ids of all rows of a chunk of UTF-8 texts, and the offsets of the rows in them."""
        if max(self.n) > IDS:
            self._empty()
        n = len(offsets) - 1
        # each row behind a space
        spaced = np.empty(len(data) + n, np.uint8)
        starts = offsets[:-1] + np.arange(n)
        is_text = np.ones(len(spaced), bool)
        is_text[starts] = False
        spaced[is_text], spaced[starts] = data, 0x20
        edges = np.append(starts, len(spaced))
        words = Words(spaced, edges, UNIT, lower=False)
        counts = np.diff(words.rows)
        # a row is plain if one separator stands before each word, nothing behind the last, and all its bytes are plain
        odd = np.zeros(len(words.starts), bool)
        before = np.append(0, words.ends[:-1])
        first = words.rows[:-1][counts > 0]
        before[first] = starts[counts > 0]
        odd |= words.starts - before != 1
        plain = counts > 0
        plain &= words.ends[np.maximum(words.rows[1:] - 1, 0)] == edges[1:] if len(words.ends) else False
        row_of = np.repeat(np.arange(n), counts)
        plain[row_of[odd]] = False
        plain[np.searchsorted(edges, odd_places(spaced), "right") - 1] = False
        if not self.by_word:
            plain[:] = False
        taken = np.flatnonzero(plain[row_of]) if len(row_of) else np.empty(0, np.int64)
        keys = mix(words.hashes[taken] + spaced[words.starts[taken] - 1].astype(U))
        slot = (keys >> U(64 - SLOT_BITS)).astype(np.int64)
        at = self.at[:, slot]
        missing = np.flatnonzero(self.keys[slot] != keys)
        if len(missing):
            new, where, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
            units = [spaced[words.starts[w] - 1 : words.ends[w]].tobytes().decode() for w in taken[missing[where]].tolist()]
            made = self._keep(self._units(units))
            at[:, missing] = made[:, inverse]
            to = slot[missing[where]]
            self.keys[to], self.at[:, to] = new, made
        whole = np.flatnonzero(~plain & (np.diff(offsets) > 0))
        alone = self._keep([self.spelt(data[offsets[r] : offsets[r + 1]].tobytes().decode()) for r in whole.tolist()])
        # rows of one unit stand in the order of rows
        rows = np.append(row_of[taken], whole)
        order = np.argsort(rows, kind="stable")
        rows, at = rows[order], np.concatenate([at, alone], 1)[:, order].astype(np.int64)
        bad = np.zeros(n, bool)
        bad[rows[at[1] < 0]] = True
        at[1::2, bad[rows]] = 0
        ids, ends = [], []
        for side in (0, 1):
            sizes = at[2 * side + 1]
            upto = np.append(0, np.cumsum(sizes))
            ids.append(self.ids[side][np.arange(upto[-1]) + np.repeat(at[2 * side] - upto[:-1], sizes)])
            ends.append(upto[np.searchsorted(rows, np.arange(n + 1))])
        return ids, ends


def encoder(a_path: str, b_path: str) -> Encoder:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Encoder(a_path, b_path)
    return _loaded[a_path, b_path]


class Bits:
    """A packed bitset with the number of bits before any place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros((size + 63) // 64 * 64, np.uint8)
        marks[places] = 1
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many bits are set before the place."""
        word, bit = place >> 6, (place & 63).astype(U)
        inside = self.words[np.minimum(word, len(self.words) - 1)] & ((U(1) << bit) - U(1))
        return self.before[np.minimum(word, len(self.words))] + np.where(word < len(self.words), np.bitwise_count(inside), 0)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def spell(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in decimal, each followed by its mark, as bytes; and the n + 1 offsets of the ids in them."""
    digits = np.maximum(1, np.searchsorted(10 ** np.arange(1, 8), ids, "right") + 1)
    width = int(digits.max(initial=1))
    table = np.empty((len(ids), width + 1), np.uint8)
    rest = ids.astype(np.int64)
    for column in range(width - 1, -1, -1):
        table[:, column] = 48 + rest % 10
        rest //= 10
    table[:, width] = marks
    ends = np.append(0, np.cumsum(digits + 1))
    return table[np.arange(width + 1) >= width - digits[:, None]], ends


def groups_and_links(ids: list[np.ndarray], rows: list[np.ndarray], sizes: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Groups and links of a chunk; ids, rows and sizes (a token's bytes) for A and for B."""
    ends = [np.cumsum(sizes[side][ids[side]]) for side in (0, 1)]
    total = int(ends[0][-1]) if len(ends[0]) else 0
    a, b = (Bits.at(e - 1, total) for e in ends)
    cuts = (a & b).select() + 1
    to_a, to_b = a.rank(cuts), b.rank(cuts)
    starts = np.append(0, ends[0][:-1])[: len(ends[0])]
    first = b.rank(starts)
    last = b.rank(ends[0] - 1)
    partners = last - first + 1
    owner = np.repeat(np.arange(len(partners)), partners)
    partner = np.arange(len(owner)) - np.repeat(np.cumsum(partners) - partners, partners) + first[owner]
    row_cut = np.searchsorted(to_a, rows[0], "right")  # groups before each row
    row_link = np.append(0, np.cumsum(partners))[rows[0]]
    return {"to_a": to_a, "to_b": to_b, "a": owner, "b": partner, "groups": row_cut, "links": row_link}


def written(ids: list[np.ndarray], to_a: np.ndarray, to_b: np.ndarray, row_groups: np.ndarray) -> pa.Array:
    """Groups of each row as ``a1,a2|b1;a3|b2,b3``."""
    n = len(ids[0]) + len(ids[1])
    out, marks = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    group_of_a = np.repeat(np.arange(len(to_a)), np.diff(to_a, prepend=0))
    group_of_b = np.repeat(np.arange(len(to_b)), np.diff(to_b, prepend=0))
    from_b = np.append(0, to_b)
    out[np.arange(len(ids[0])) + from_b[group_of_a]] = ids[0]
    out[np.arange(len(ids[1])) + to_a[group_of_b]] = ids[1]
    marks[to_a - 1 + from_b[:-1]] = ord("|")
    marks[to_a + to_b - 1] = ord(";")
    data, ends = spell(out, marks)
    tokens = np.append(0, to_a + to_b)[row_groups]
    low, high = ends[tokens[:-1]], ends[tokens[1:]]
    keep = np.ones(len(data), bool)
    keep[high[high > low] - 1] = False
    offsets = np.append(0, np.cumsum(np.where(high > low, high - low - 1, 0)))
    return pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(offsets), pa.py_buffer(data[keep]))


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: its key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` and its different pairs.

    ``pairs`` has a pair of ids as A's times 2^ID_BITS plus B's, ascending, ``times`` how many links have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(a_path, b_path)
        for batch, data, offsets in chunks(batches, "text", keep=True):
            ids, rows = code.encode_rows(data, offsets)
            n = batch.num_rows
            found = groups_and_links(ids, rows, [code.a_bytes, code.b_bytes])
            row = np.repeat(np.arange(n), np.diff(found["links"]))
            pair = ids[0][found["a"]].astype(np.int64) << ID_BITS | ids[1][found["b"]]
            # rows are in order: sorting by row and pair together
            many = n.bit_length() + 2 * ID_BITS < 63
            order = None if many else np.lexsort((pair, row))
            both = np.sort(row << 2 * ID_BITS | pair) if many else None
            row, pair = (both >> 2 * ID_BITS, both & ((1 << 2 * ID_BITS) - 1)) if many else (row[order], pair[order])
            edges = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            times = np.diff(np.append(edges, len(pair)))
            at = np.searchsorted(row[edges], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array(np.diff(x)) for x in (rows[0], rows[1], found["groups"], found["links"])),
                    written(ids, found["to_a"], found["to_b"], found["groups"]).cast(pa.string() if len(data) < 1 << 27 else pa.large_string()),
                    pa.ListArray.from_arrays(at, pa.array(pair[edges])), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32))),
                ],
                ["key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
            )

    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<int>")
    return out.withColumnRenamed("key", fresh(out.columns[1:], key))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n_docs, best): in how many documents each pair is linked, and whether no other pair of its id of A is in more.

    The best count of each id of A is broadcast: there are no more of them than ids.
    """
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = Scratch(links.sparkSession, "alignment").write(counts, "pairs").withColumn("a", F.shiftright("pair", ID_BITS).cast("int"))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def weighted(links: DataFrame, row: str) -> DataFrame:
    """For each row of links that has any: ``n_best``, its links that are the best of their id of A, and ``count_sum``, all links' counts.

    links: a written table with ``pairs`` and ``times``; ``row`` names each of its rows.
    """
    scratch = Scratch(links.sparkSession, "alignment")
    counts, seen = scratch.measured(pair_counts(links), "counts", entries=F.sum("n_docs"), different=F.count(F.lit(1)))
    limit = seen.get("entries", 0) // HEAVY if seen.get("different", 0) > HEAVY else 0  # fewer than HEAVY pairs are above it
    heavy, light = counts.where(F.col("n_docs") > limit), counts.where(F.col("n_docs") <= limit)
    each = links.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(row, F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    found = each.join(F.broadcast(heavy), "pair", "left")
    known = found.where("n_docs IS NOT NULL").groupBy(row).agg(*sums)
    if not limit:
        return known
    rest = found.where("n_docs IS NULL").select(row, "pair", "times").join(light, "pair").groupBy(row).agg(*sums)
    return known.union(rest).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = read(spark, sf_dir, "documents")
    links = aligned(docs, vocabularies.path(A_FILE), vocabularies.path(B_FILE))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    links = links.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times")
    links = Scratch(spark, "alignment").write(links, "links")
    sums = weighted(links, "row")
    out = links.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")

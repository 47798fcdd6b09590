import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import packing
from weftline.llm.encoding import encoder
from weftline.llm.lengths import at_quantiles, encoded_lengths, length_report

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["don't", "WE'LL", "straße", "ß", "é́", "<|endoftext|>", "a<|startoftext|>b", "İ", "ΣΑΣ", "½²", "日本", "🎉", "\x85", "\xa0", "ª", "µ", "\x1c"])), max_size=8), st.sampled_from([" ", "\n", "\t ", ""]))
def test_cached_words_equal_the_tokenizer(parts, sep):
    text = sep.join(parts)
    assert np.frombuffer(encoder(PATH).encode(text.encode()), np.uint32).tolist() == encoder(PATH).ids(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=12))
def test_plans_place_every_piece_once(histogram):
    made = packing.plan(histogram, 64)
    used = Counter()
    for lengths, times in made:
        assert times > 0 and sum(lengths) <= 64
        for x in lengths:
            used[x] += times
    assert dict(used) == histogram
    keys, _, _ = packing.places(made)
    assert len(set(keys.tolist())) == len(keys)


@pytest.mark.parametrize(("histogram", "bins"), [({40: 2, 24: 2}, 2), ({30: 1, 20: 1, 14: 1}, 1), ({31: 1, 11: 3}, 1), ({64: 3}, 3), ({33: 4}, 4), ({1: 65}, 2), ({}, 0)])
def test_exact_complements(histogram, bins):
    assert sum(t for _, t in packing.plan(histogram, 64)) == bins


@pytest.mark.parametrize("seed", range(8))
def test_no_more_sequences_than_best_fit_alone(seed):
    rng = np.random.default_rng(seed)
    kind = seed % 4
    if kind == 0:
        histogram = {x: int(rng.integers(1, 50)) for x in range(1, 2049)}
    elif kind == 1:
        histogram = {int(x): int(rng.integers(1, 4)) for x in rng.choice(np.arange(600, 2049), 700, replace=False)}
    else:
        lengths = np.clip(rng.lognormal(6, 1, 20_000), 1, 2048).astype(int) if kind == 2 else rng.integers(300, 1100, 20_000)
        histogram = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    taken = sum(t for _, t in packing.plan(histogram, 2048))
    assert taken <= sum(t for _, t in packing.best_fit(histogram, 2048))
    assert taken <= sum(t for _, t in packing.exact(histogram, 2048, 3))
    assert taken >= -(-sum(x * n for x, n in histogram.items()) // 2048)


def brute(rows, limit):
    out = {}
    for doc_id, text in rows:
        ids = [*encoder(PATH).ids(text or ""), 0]
        for n, at in enumerate(range(0, len(ids), limit)):
            own = ids[at : at + limit]
            out.setdefault((doc_id, n), []).append((at, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, ""), (3, "  "), (None, "null id")],
        [(i, "word " * (i % 37)) for i in range(120)] + [(7, "word " * 7)] * 40,
        [(1, "long text, " * 3000), (1, "long text, " * 3000), (2, "x")],
    ],
)
def test_packing_is_gapless_and_whole(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", sequence_id string")
    got = packing.pack(df, spark, PATH, 64).collect()
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in pieces.items()} == brute(rows, 64)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    if rows:
        assert len(sequences) <= 1.02 * -(-sum(r["length"] for r in got) // 64) + 1


def test_numbers_are_gapless_within_lengths(spark):
    df = spark.createDataFrame([(i, 0, 0, 5 if i % 3 else 6, i) for i in range(500)], "doc_id long, piece int, start long, length long, row long")
    got = packing.numbered(df, 7).collect()
    for length in (5, 6):
        own = sorted(r["number"] for r in got if r["length"] == length)
        assert own == list(range(len(own)))


def test_length_report_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "length long")
    assert length_report(empty).count() == 0
    assert {tuple(r)[:4] + (r["quantile"],) for r in length_report(empty, [5, 9]).collect()} == {(5, 0, 0, 0, None), (9, 0, 0, 0, None)}


def test_length_report_against_brute_force(spark):
    lengths = [0, 0, 3, 5, 5, 5, 1500, 2600, 2600]
    got = {r["length"]: r for r in length_report(spark.createDataFrame([(x,) for x in lengths], "length long")).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r["docs_longer"] == sum(x > limit for x in lengths)
        assert r["tokens_longer"] == sum(x for x in lengths if x > limit)
        assert r["docs_fitting"] == sum(x <= limit for x in lengths)
        assert r["tokens_fitting"] == sum(x for x in lengths if x <= limit)
        assert r["tokens_if_cut"] == sum(min(x, limit) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= limit for x in lengths) / len(lengths))
    assert length_report(spark.createDataFrame([], "length long")).count() == 0


def test_encoded_lengths(spark):
    rows = [(1, None, 0), (2, "two words", 1), (2, "two words", 1)]
    got = encoded_lengths(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH).collect()
    assert sorted(r["length"] for r in got) == sorted(len(encoder(PATH).ids(t or "")) for _, t, _ in rows)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 4), max_size=8), st.lists(st.integers(1, 24), max_size=6))
def test_sums_of_one_two_and_three_lengths_are_indexed(counts, taken):
    from itertools import combinations_with_replacement as combos

    table = np.zeros(41, np.int64)
    for x, n in counts.items():
        table[x] = n
    index = packing.Complements(table)
    for x in taken:
        if index.left[x]:
            index.take((x,), 1)
    left = [x for x in range(41) if index.left[x]]
    for size, sums in ((2, index.pairs), (3, index.triples)):
        want = Counter(sum(c) for c in combos(left, size) if sum(c) <= 40 and all(n <= index.left[x] for x, n in Counter(c).items()))
        assert {s: int(n) for s, n in enumerate(sums) if n} == dict(want)
    for total in range(1, 41):
        found = index.fill(total)
        assert bool(found) == bool(index.there[total] or index.pairs[total] or index.triples[total])
        assert not found or (sum(found) == total and all(n <= index.left[x] for x, n in Counter(found).items()))


def test_limits_that_no_document_has(spark):
    lengths = [0, 0, 3, 5, 5, 5, 1500, 2600, 2600]
    report = length_report(spark.createDataFrame([(x,) for x in lengths], "length long"), (4, 5, 2048, 9000)).cache()
    got = {r["length"]: r for r in report.collect()}
    assert set(got) == {*lengths, 4, 2048, 9000} and got[4]["n_docs"] == got[2048]["n_docs"] == 0 and got[5]["n_docs"] == 3
    for limit, r in got.items():
        assert (r["docs_longer"], r["tokens_if_cut"]) == (sum(x > limit for x in lengths), sum(min(x, limit) for x in lengths))
    found = {r["share"]: r["length"] for r in at_quantiles(report, (0.1, 0.5, 0.7, 1.0)).collect()}
    assert found == {q: sorted(lengths)[int(np.ceil(q * 9)) - 1] for q in found} and len(found) == 4
    nothing = length_report(spark.createDataFrame([], "length long"), (8,))
    assert [(r["length"], r["docs_longer"], r["quantile"]) for r in nothing.collect()] == [(8, 0, None)]


def test_slots_are_shared_and_emptied(monkeypatch):
    from weftline.llm import encoding

    monkeypatch.setattr(encoding, "SLOT_BITS", 3)
    monkeypatch.setattr(encoding, "IDS", 200)
    own = encoding.WordEncoder(PATH)
    for i in range(30):
        texts = [f"Wörd{j} and, word-{j * i} <|endoftext|> {'x' * j}" for j in range(i, i + 6)] + ["", " \t"]
        data = "".join(texts).encode()
        ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
        ids, at = own.encode_rows(np.frombuffer(data, np.uint8), ends)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [own.ids(t) for t in texts]


def test_one_repeated_row_is_dealt_over_buckets(spark):
    df = spark.range(3000).selectExpr("7 AS doc_id", "0 AS piece", "0L AS start", "5L AS length", "id AS row")
    got = packing.numbered(df, 10)
    assert sorted(r["number"] for r in got.collect()) == list(range(3000))

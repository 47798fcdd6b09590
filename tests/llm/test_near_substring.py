import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import graph, near, substring
from weftline.llm.common import Scratch
from weftline.llm.minmax import band_keys, signatures
from weftline.llm.words import NOT_SPACE, Words, shingles

DOCS = "doc_id long, text string"


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


def brute(rows, k):
    """doc_id -> (size, component, kept) by all pairs."""
    own = [(i, sets(t, k)) for i, t in rows]
    parent = list(range(len(own)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    out = []
    for a, (i, s) in enumerate(own):
        ids = [own[b][0] for b in range(len(own)) if root(b) == root(a) and own[b][0] is not None]
        least = min(ids, default=None)
        out.append((i, len(s), least, i == least))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    bases = [[word() for _ in range(rnd.randint(3, 120))] for _ in range(5)]
    rows = []
    for i in range(n):
        own = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(len(own))] = word()
        rows.append((i, " ".join(own).upper() if i % 7 == 0 else "\t".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    got = near.near_duplicates(spark.createDataFrame(rows, DOCS), spark, k=4).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4)


def test_blocks_decide_what_stars_leave(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_CLASSES", 7)
    rows = corpus(9, 90)
    got = near.near_duplicates(spark.createDataFrame(rows, DOCS), spark, k=3).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 3)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, ""), (3, " \n "), (4, "a"), (5, "A"), (None, "a")],
        [(3, "one two three four five")] * 3 + [(1, "one two three four five"), (2, "x " * 5000)],
        [(5, "same id a b c d"), (5, "other text e f g h"), (4, "same id a b c d")],
    ],
)
def test_edge_cases(spark, rows):
    df = spark.createDataFrame([(*r, True, 0) for r in rows], DOCS + ", kept boolean, component_id int")
    got = near.near_duplicates(df, spark, k=4).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4)


def test_one_of_each_group_stays(spark):
    rows = [(9, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (5, "other words that stay here now"), (7, None)]
    got = near.representatives(spark.createDataFrame([(*r, "src") for r in rows], DOCS + ", source string"), spark)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(2, "a b c d e f g"), (5, "other words that stay here now"), (7, None)]
    assert got.columns == ["doc_id", "text", "source"]


def test_spanning_links_connect_what_is_similar():
    rnd = np.random.default_rng(0)
    base = rnd.integers(0, 2**63, 100, dtype=np.uint64)
    own = [np.unique(np.concatenate([base[: 100 - 3 * i], rnd.integers(0, 2**63, 3 * i, dtype=np.uint64)])) for i in range(12)]
    links = near.spanning(own, np.arange(12), 80, 100)
    for a, b in links:
        both = len(np.intersect1d(own[a], own[b]))
        assert 100 * both >= 80 * (len(own[a]) + len(own[b]) - both)
    assert len(links) == len({x for link in links for x in link}) - 1


def test_min_max_values_estimate_similarity():
    rnd = np.random.default_rng(1)
    common, x, y = (rnd.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    data = np.concatenate([common, x, common, y])
    values = signatures(data, np.array([0, 900, 1800]), 200)
    assert abs((values[0] == values[1]).mean() - 0.8) < 0.06
    keys = band_keys(values, 10, 4)
    assert keys.shape == (2, 10) and len(np.unique(keys)) <= 20


def test_shingles_of_short_rows():
    text = b"a b|a b c d e|c"
    words = Words(np.frombuffer(text.replace(b"|", b" "), np.uint8), np.array([0, 3, 3, 14, 15]), NOT_SPACE)
    hashes, at = shingles(words.hashes, words.rows, 4)
    assert np.diff(at).tolist() == [1, 0, 2, 1] and len(np.unique(hashes)) == 4


def test_components_of_any_shape(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 1)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 130)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "d").count() == 0


def passage(seed, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    return " ".join(w + "." if i % 9 == 8 else w for i, w in enumerate(words))


def run_substring(spark, rows):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS + ", n_chars long")
    return {r["doc_id"]: r for r in substring.deduplicated(df, spark).collect()}


def test_repeated_lines_go_but_for_the_first(spark):
    shared = passage(1)
    rows = [(3, f"{passage(30)}\n{shared}"), (1, f"{passage(10)}\n{shared}\n{passage(11)}"), (2, shared), (4, passage(40))]
    got = run_substring(spark, rows)
    assert got[1]["text"] == rows[1][1] and got[4]["text"] == rows[3][1]
    assert got[3]["text"].strip() == passage(30) and got[2]["text"] == ""
    assert (got[3]["__n_removed"], got[3]["__removed_words"], got[3]["n_chars"]) == (1, 60, len(got[3]["text"]))


def test_near_lines_are_one_cluster(spark):
    words = passage(5, 100).split()
    words[50] = "changed"
    rows = [(1, passage(5, 100)), (2, passage(20) + "\n" + " ".join(words))]
    got = run_substring(spark, rows)
    assert got[1]["text"] == rows[0][1] and got[2]["text"].strip() == passage(20)


def test_passages_within_longer_lines(spark):
    shared = passage(1, 72)
    rows = [(1, f"{passage(10)} end. {shared} {passage(11)}"), (2, f"{passage(20)} end. {shared} {passage(21)}")]
    got = run_substring(spark, rows)
    assert got[1]["text"] == rows[0][1]
    assert passage(20)[:100] in got[2]["text"] and passage(21)[-100:] in got[2]["text"]
    assert not any(s in got[2]["text"] for s in shared.split(". ")[:7])


def plain(seed, n):
    """n words without sentence ends."""
    return passage(seed, n).replace(".", "")


def test_unaligned_and_unpunctuated_repeats(spark):
    layouts = [str, lambda x: x.replace(" ", "\n"), lambda x: ". ".join(x.split(" "))]
    rows, alone = [], {}
    for k, (n, layout) in enumerate((n, x) for n in (50, 80, 300) for x in layouts):
        shared = plain(k, n)
        for i, x in ((10 * k, layout(shared).replace("\n", " ")), (10 * k + 1, layout(shared.upper()))):
            alone[i] = f"{plain(1000 + i, 40)} {plain(2000 + i, 33)}", n
            rows.append((i, f"{plain(1000 + i, 40)} {x} {plain(2000 + i, 33)}"))
    got = run_substring(spark, rows + rows[1:2])
    for i, text in rows[::2]:
        assert got[i]["text"] == text
    for i, _ in rows[1::2]:
        assert got[i]["text"].split() == alone[i][0].split()
        assert (got[i]["__n_removed"], got[i]["__removed_words"]) == (1, alone[i][1])


def places(words, least, i, seen):
    """Numbers of the words in a run of ``least`` words that stands at an earlier place too."""
    return {j for a in range(len(words) - least + 1) if seen[tuple(words[a : a + least])] < (i, a) for j in range(a, a + least)}


def test_recall_and_precision_against_all_pairs(spark):
    """Of the words in exact repeats of 50 words nearly all go, of those in no repeat of 20 nearly none.

    What stays are ends of under 25 words that a later text has, but not the first one of the window
    beside them. What goes too much are ends of windows of which four fifths are a repeat.
    """
    rnd = random.Random(3)
    blocks = [plain(i, rnd.randint(50, 140)).split() for i in range(40, 60)]
    rows = []
    for i in range(60):
        words = []
        for j in range(rnd.randint(2, 6)):
            own = list(rnd.choice(blocks)) if rnd.random() < 0.4 else plain(1000 + 10 * i + j, rnd.randint(5, 60)).split()
            if rnd.random() < 0.3:
                own[rnd.randrange(len(own))] = "edited"
            words += own
        rows.append((i, "".join(w + rnd.choice("     \n") for w in words)))
    seen, must, may = {}, {}, {}
    for least, out in ((20, may), (50, must)):
        for i, text in rows:
            for a in range(len(text.split()) - least + 1):
                seen.setdefault(tuple(text.split()[a : a + least]), (i, a))
        for i, text in rows:
            out[i] = places(text.split(), least, i, seen)
    got = run_substring(spark, rows)
    caught = total = wrong = removed = 0
    for i, text in rows:
        words, kept, gone, at = text.split(), got[i]["text"].split(), set(), 0
        assert got[i]["__removed_words"] == len(words) - len(kept)
        for j, w in enumerate(words):  # words of a row are told apart by their place from the left
            if at < len(kept) and kept[at] == w:
                at += 1
            else:
                gone.add(j)
        assert at == len(kept)
        caught, total = caught + len(gone & must[i]), total + len(must[i])
        wrong, removed = wrong + len(gone - may[i]), removed + len(gone)
        assert not must[i] or gone & must[i]
    print(f"words in exact repeats of 50 words: {caught} of {total} removed; of {removed} removed words {wrong} in no repeat of 20")
    assert total > 1000 and caught >= 0.95 * total and wrong <= 0.005 * removed


def test_edited_passages_in_longer_paragraphs(spark):
    """A passage with edits further apart than 50 words goes but for what the edits leave apart."""
    rows, caught, total = [], 0, 0
    for k in range(12):
        own = plain(k, 180).split()
        changed = list(own)
        for at in (60 + k, 120 + k):
            changed[at] = "edited"
        rows += [(2 * k, f"{plain(100 + k, 70)} {' '.join(own)} {plain(200 + k, 40)}"), (2 * k + 1, f"{plain(300 + k, 50)} {' '.join(changed)} {plain(400 + k, 90)}")]
    got = run_substring(spark, rows)
    for i, text in rows:
        if i % 2:
            caught, total = caught + got[i]["__removed_words"], total + 180
            assert got[i]["text"].startswith(plain(300 + i // 2, 50)) and got[i]["text"].endswith(plain(400 + i // 2, 90))
        else:
            assert got[i]["text"] == text
    print(f"words of edited passages removed: {caught} of {total}")
    assert caught >= 0.95 * total


def test_least_is_one_limit_for_lines_and_windows(spark):
    short = [plain(i, 24) for i in (1, 2)]
    rows = [(1, f"{plain(10, 30)}\n{short[0]}"), (2, f"{plain(11, 30)}\n{short[0]}\n{plain(12, 30)}"), (3, short[1]), (4, short[1])]
    assert {i: r["text"] for i, r in run_substring(spark, rows).items()} == dict(rows)
    got = {r["doc_id"]: r["text"] for r in substring.deduplicated(spark.createDataFrame(rows, DOCS), spark, least=20).collect()}
    assert got[2].split() == f"{plain(11, 30)} {plain(12, 30)}".split() and got[4] == "" and got[1] == rows[0][1] and got[3] == short[1]


def test_texts_that_repeat_themselves(spark):
    rows = [(9, "x " * 200), (1, f"{plain(1, 60)} {plain(2, 30)} {plain(1, 60)}")]
    got = run_substring(spark, rows)
    assert 25 <= len(got[9]["text"].split()) <= 26
    assert got[1]["text"].split() == f"{plain(1, 60)} {plain(2, 30)}".split()


@pytest.mark.parametrize("n", [1, 2, 3, 8, 25, 26, 64])
def test_sliding_is_the_best_of_each_stretch(n):
    values = np.random.default_rng(n).integers(0, 50, 200).astype(np.uint64)
    each = np.lib.stride_tricks.sliding_window_view(values, n)
    assert np.array_equal(substring.sliding(np.minimum, values, n), each.min(1)) and np.array_equal(substring.sliding(np.maximum, values, n), each.max(1))


@pytest.mark.parametrize("least", [5, 25, 64, 65])
def test_openings_are_the_smallest_of_each_stretch(least):
    rng = random.Random(least)
    texts = [" ".join(rng.choice("abcdef") for _ in range(size)) for size in (0, 3, least, least + 1, 2 * least - 1, 2 * least, 3 * least, 400)] + ["a b " * 200]
    ends = np.cumsum([0, *map(len, texts)])
    words = Words(np.frombuffer("".join(texts).encode(), np.uint8), ends, NOT_SPACE)
    at, _ = substring.openings(words, least)
    whole = shingles(words.hashes, np.array([0, len(words.hashes)]), substring.OPENING)[0]
    want = set()
    for low, high in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
        places = list(range(low, high - least + 1))
        value = {p: ((int(whole[p]) >> 6 << 6) + (p - low) % least if least <= 64 else int(whole[p])) if p < len(whole) else 2**64 - 1 for p in places}
        for i in range(max(1, len(places) - least + 1) if places else 0):
            want.add(min(places[i : i + least], key=lambda p: (value[p], p)))
    assert set(at.tolist()) == want


def test_openings_depend_on_content_alone():
    shared = plain(1, 60)
    texts = [f"{plain(2, 33)} {shared} {plain(3, 40)}", f"{plain(4, 51)} {shared}", plain(5, 30), plain(6, 24), "y " * 300]
    words = Words(*substring.flat(pa.array(texts)), NOT_SPACE)
    at, keys = substring.openings(words, 25)
    own = [{(int(a - r), int(k)) for a, k in zip(at, keys, strict=True) if r <= a < e} for r, e in zip(words.rows[:-1], words.rows[1:], strict=True)]
    inside = [{(a - s, k) for a, k in o if s <= a <= s + 35} for o, s in ((own[0], 33), (own[1], 51))]
    assert inside[0] & inside[1] and len(own[2]) == 1 and not own[3] and len(own[4]) <= 12
    for i, w in enumerate(np.diff(words.rows).tolist()):
        assert all(a + 25 <= w for a, _ in own[i])


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "\n\n"), (4, "short line here"), (6, "short line here"), (7, passage(4)), (7, passage(4)), (None, passage(3)), (5, passage(3))]])
def test_substring_edge_cases(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(((r["doc_id"], r["text"]) for r in substring.deduplicated(df, spark).collect()), key=repr)
    want = sorted([(i, "" if i is None else t) for i, t in rows], key=repr)
    assert got == want

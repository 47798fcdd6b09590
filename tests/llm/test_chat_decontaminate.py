import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import chat, decontaminate
from weftline.llm.words import ALNUM, Words

ROLE = st.sampled_from(["system", "user", "assistant", "tool", None])


def legal(states):
    last = chat.START
    for s in states:
        if s not in chat.LEGAL[last]:
            return False
        last = s
    return last == 2


def brute_cost(roles):
    """Least cost over all sequences of moves, by trying them all."""
    best = chat.FAR
    for moves in itertools.product(range(8), repeat=len(roles)):
        state, cost = chat.START, 0
        for role, m in zip(chat.numbers(roles).tolist(), moves, strict=True):
            own = chat.MOVES[role][state]
            if m >= len(own):
                break
            cost, state = cost + own[m][0], own[m][3]
        else:
            best = min(best, cost + int(chat.END[state]))
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(ROLE, min_size=1, max_size=4))
def test_repair_is_cheapest_and_legal(roles):
    cost, moves, closing = chat.repaired(roles)
    assert cost == brute_cost(roles)
    turns = []
    for _, action, inserted, role in moves:
        turns += ([inserted] if inserted >= 0 else []) + ([role] if action != 1 else [])
    assert legal([*turns, *closing])
    assert cost == sum(m[0] for m in moves) + chat.INSERT * len(closing)


def test_legal_conversations_stay():
    for roles in (["user", "assistant"], ["system", "user", "assistant", "user", "assistant"]):
        cost, moves, closing = chat.repaired(roles)
        assert cost == 0 and not closing and all(m[1] == 0 for m in moves)
    assert chat.repaired([]) == (0, [], ())


@settings(max_examples=50, deadline=None)
@given(st.lists(ROLE, min_size=1, max_size=30))
def test_matrices_compose(roles):
    codes = chat.numbers(roles)
    m = chat.STEP[codes[0]]
    for c in codes[1:]:
        m = chat.product(m, chat.STEP[c])
    assert (chat.matrix(codes) == m).all()
    assert np.minimum((m + chat.END).min(axis=1), chat.FAR).tolist() == chat.to_go(codes, chat.END)[0].tolist()


def expected(rows):
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t, r, x))
    none_first = lambda k: tuple((v is not None, v) for v in k)
    out = {}
    for c, turns in groups.items():
        turns.sort(key=none_first)
        _, moves, closing = chat.repaired([r for _, r, _ in turns])
        state, text = chat.START, ""
        for (_, _, x), move in zip(turns, moves, strict=True):
            text += chat.rendered(move, state, x or "")
            state = move[3]
        out[c] = text + "".join(chat.opened(r, False, "") for r in closing) + "<|im_end|>\n", [chat.ACTIONS[m[1]] for m in moves]
    return out


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_conversations_over_many_partitions(spark, parts):
    rng = np.random.default_rng(parts)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", None]
    rows = [(c, t, roles[rng.integers(len(roles))], f"t{t}" if t % 3 else None) for c, n in ((1, 90), (2, 1), (3, 2), (None, 4), (5, 40)) for t in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
        got = chat.format_chats(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = expected(rows)
    assert len(got) == len(rows)
    for c, (text, actions) in want.items():
        own = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["turn"])
        assert "".join(r["rendered"] for r in own) == text
        assert [r["action"] for r in own] == actions


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, 0, "user", "a")] * 3 + [(1, 0, "assistant", "b")], [(2, 5, "assistant", "x" * 1_000_000), (2, 5, "user", "")]])
def test_chat_edge_cases(spark, rows):
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = expected(rows)
    assert len(got) == len(rows)
    for c, (text, _) in want.items():
        assert sum(len(r["rendered"]) for r in got if r["conv_id"] == c) == len(text)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for name, item in items:
            v = words_of(item)
            k = min(window, len(v))
            for a in range(len(v) - k + 1) if v else ():
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == v[a : a + k]:
                        hit |= set(range(b, b + k))
                        ids.add(name or "")
        out.append((i, len(w), sorted(hit), sorted(ids)))
    return sorted(out, key=repr)


def run(spark, docs, items, window=10):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.marked(d.drop("n_words"), b, window).collect()
    return sorted([(r["doc_id"], r["n_words"], np.frombuffer(r["hit_words"], np.uint32).tolist(), r["hit_items"]) for r in got], key=repr)


CASES = [
    ([], [("1", "a b")]),
    ([(1, "a b c"), (2, None), (3, "")], []),
    ([(1, "x one two y One-two z one"), (2, "two one")], [("s", "one two"), ("t", "one"), (None, "z"), ("e", ""), ("n", None)]),
    ([(1, "a b a b a b a b a b a b a b c"), (1, "b a " * 30)], [("p", "a b a b a b a b a b a"), ("q", "b a b a b a b a b a b a c")]),
    ([(1, "é" + " w" * 5000 + " k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11")], [("l", "zz k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11 zz")]),
]


@pytest.mark.parametrize(("docs", "items"), CASES)
@pytest.mark.parametrize("block", [100_000, 3])
def test_hits_equal_brute_force(spark, docs, items, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    assert run(spark, docs, items) == brute(docs, items)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 6))
def test_matcher_on_random_words(items, doc, window):
    hashes = {c: Words(np.frombuffer(c.encode(), np.uint8), np.array([0, 1]), ALNUM).hashes[0] for c in "abcd"}
    own = [(str(i), np.array([hashes[c] for c in x], np.uint64)) for i, x in enumerate(items) if x]
    h = np.array([hashes[c] for c in doc], np.uint64)
    got = decontaminate.Matcher([(i, min(window, len(x)), x) for i, x in own]).hits(h, np.array([0, len(h)]))
    want = brute([(0, " ".join(doc))], [(str(i), " ".join(x)) for i, x in enumerate(items)], window)[0]
    words, ids = got.get(0, (set(), set()))
    assert (sorted(words), sorted(ids)) == (want[2], want[3])


def test_coverage_limit_counts_parts_of_short_items(spark):
    docs = spark.createDataFrame([(1, "a b c d x"), (2, "a b c x")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b c d e")], "item_id string, text string")
    got = {r["doc_id"]: len(r["hit_words"]) // 4 for r in decontaminate.marked(docs, items, coverage=0.8).collect()}
    assert got == {1: 4, 2: 0}


def test_cut_removes_stretches(spark):
    text = "Keep this, Ünï one two; THREE four! and that. one"
    docs = spark.createDataFrame([(1, text, 99, "s"), (2, "clean", 5, "s"), (3, None, None, "s")], "doc_id long, text string, n_chars long, source string")
    items = spark.createDataFrame([("i", "one two three four")], "item_id string, text string")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminate.cleaned(docs, items).collect()}
    cut = "Keep this, Ünï ! and that. one"
    assert got == {1: (cut, len(cut)), 2: ("clean", 5), 3: (None, None)}


def test_thirty_blocks_and_long_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    monkeypatch.setattr(decontaminate, "PIECE", 15)
    monkeypatch.setattr(decontaminate, "SHARE", 100)
    word = lambda i: f"w{i * 7919 % 1009}"
    items = [(str(k), " ".join(word(40 * k + j) for j in range(12 + 3 * k))) for k in range(30)]
    docs = [(i, " ".join(word(30 * i + j) for j in range(10 + 9 * i))) for i in range(25)] + [(99, " ".join(t for _, t in items[::3]))]
    assert run(spark, docs, items) == brute(docs, items)


def test_clashing_columns_are_kept(spark):
    names = ["n_words", "hit_words", "hit_items", "doc", "own", "at", "ids", "block", "need", "first"]
    docs = spark.createDataFrame([(1, "one two three four five", *names), (2, None, *names)], DOCS_SCHEMA + ", " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([("i", "two three", 1, "x")], "item_id string, text string, need int, words string")
    got = {r["doc_id"]: r for r in decontaminate.cleaned(docs, items).collect()}
    assert got[1]["text"] == "one  four five" and got[2]["text"] is None
    assert all([r[n] for n in names] == names for r in got.values())
    assert decontaminate.marked(docs, items).where("doc_id = 1").first()["hit_items"] == ["i"]


DOCS_SCHEMA = "doc_id long, text string"

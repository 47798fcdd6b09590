import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import alignment, registry

A, B = public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE)


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    shown = {chr(x) if x in letters else chr(next(rest)): x for x in range(256)}

    def both(text):
        """Tokens of A and B as (id, bytes), by the tokenizers alone."""
        left = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        return left, right

    return both


def brute(text, both):
    """(groups, links as pairs of ids) of a text, token by token."""
    left, right = both(text) if text else ([], [])
    want = b" " + (text or "").encode()
    if b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
        return 0, 0, [], []
    spans = []
    for side in (left, right):
        at, out = 0, []
        for i, x in side:
            out.append((at, at + len(x), i))
            at += len(x)
        spans.append(out)
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = [[",".join(str(i) for s, e, i in side if low < e <= high) for side in spans] for low, high in zip([0, *cuts], cuts, strict=False)]
    links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if t < e and s < f]
    return len(left), len(right), ["|".join(g) for g in groups], links


def expected(texts, both):
    found = [brute(t, both) for t in texts]
    counts = Counter(p for _, _, _, links in found for p in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(na, nb, len(g), len(ls), sum(counts[p] == most[p[0]] for p in ls), sum(counts[p] for p in ls), sha(g)) for na, nb, g, ls in found]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def fixture_texts():
    rng = random.Random(4)
    texts = [None, "", " ", "\n", "a", "a b", " a", "a ", "a\nb", "a\n\nb", "a  b", "it's 's\n's don't", "<|endoftext|> <s> </s><unk>", "a▁b", "x y z", "p　q", "a\u0085b"]
    texts += ["“quoted” — dash…", "日本語 テスト", "a\tb\r\nc", "\x00a\x1fb", "é è\nüß", "\U0001f600 ok", "123abc 45,6", "<0x0A> \\n"]
    bits = ["a", "b", "The", "ing", " ", " ", "\n", "'s", "1", ".", "é", "—", "　", "日", "Ham", "stead"]
    return texts + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + ["one two " * 400, "same text", "same text"]


def write(spark, folder, texts):
    rows = spark.createDataFrame([(i // 2 if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, pairs string, row int")
    rows.repartition(5).write.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 20])
def test_query_equals_brute_force(spark, tmp_path, tokenizers, monkeypatch, heavy):
    monkeypatch.setattr(alignment, "HEAVY", heavy)  # 20: most pairs are joined, not broadcast
    texts = fixture_texts()
    write(spark, tmp_path, texts)
    got = registry.queries()["op12_token_alignment"](spark, str(tmp_path)).collect()
    want = [(i // 2 if i % 7 else None, *x) for i, x in enumerate(expected(texts, tokenizers))]
    assert sorted(map(str, [(r.doc_id, *(r[c] for c in NAMES)) for r in got])) == sorted(map(str, want))


def test_driver_rows(spark, sf_dir, tokenizers):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 1500).select("doc_id", "text").collect()
    links = alignment.aligned(spark.createDataFrame(docs, "doc_id long, text string"), A, B).collect()
    for doc, got in zip(sorted(docs, key=lambda r: r.doc_id), sorted(links, key=lambda r: r.doc_id), strict=True):
        na, nb, groups, pairs = brute(doc.text, tokenizers)
        assert (got.n_a, got.n_b, got.n_groups, got.n_links, got.groups) == (na, nb, len(groups), len(pairs), ";".join(groups))
        counted = Counter(a << alignment.ID_BITS | b for a, b in pairs)
        assert dict(zip(got.pairs, got.times, strict=True)) == dict(counted)


def test_ranks():
    places = [0, 3, 63, 64, 130]
    bits = alignment.Bits.at(places, 131)
    import numpy as np

    assert bits.rank(np.arange(132)).tolist() == [sum(p < x for p in places) for x in range(132)]
    assert bits.select().tolist() == places


def test_empty_tables_and_keys(spark):
    rows = spark.createDataFrame([("k", "a b")], "groups string, text string")
    assert alignment.aligned(rows.limit(0), A, B, key="groups").count() == 0
    assert "groups_" in alignment.aligned(rows, A, B, key="groups").columns


def test_a_long_text(spark):
    text = "The quick brown fox jumps over it. " * 60_000 + "end"
    (row,) = alignment.aligned(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).collect()
    assert row.n_groups > 400_000 and row.groups.count(";") == row.n_groups - 1 and sum(row.times) == row.n_links

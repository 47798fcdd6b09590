import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from weftline.llm import quality

SCHEMA = "doc_id long, text string, lang string, caught string, kept string"
LABELS = "doc_id long, quality int, text string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a b c", "a b c a b c", "é😀 ü x y", "x\n\n \nx\nx \nx", "a b " * 40, "#|<> $a &", "\x0b\x0ca\rb"]
    texts += ["".join(rng.choice("ab #\n\t|") for _ in range(rng.randrange(1, 120))) for _ in range(120)]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(3000)), "w " * 200_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.measured(rows, F.col("doc_id")).collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        assert tuple(got[i][c] for c in quality.BASE) == want, repr(text)[:80]
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


@pytest.mark.parametrize(("n", "p"), [(1, 0.5), (40, 0.1), (700, 0.01), (3000, 0.05)])
def test_binomial_tail_is_exact(spark, n, p):
    ks = [k for k in (0, 1, 2, 5, 20, 100, 149) if k < n * p] + [n]
    got = [r.p for r in spark.createDataFrame([(k, n) for k in ks], "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), p).alias("p")).collect()]
    q = Fraction(p)
    for k, x in zip(ks, got, strict=True):
        want = float(sum(comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k + 1))) if k < n * p else 1.0
        assert x == pytest.approx(want, rel=1e-9)


def corpus(rng, n, lang, bad_share, noise):
    """Texts of different words; bad ones have many signs, and a share of good ones has a few."""
    out = []
    for i in range(n):
        bad = rng.random() < bad_share
        signs = rng.randrange(40, 80) if bad else rng.randrange(1, 25) if rng.random() < noise else 0
        words = [f"{rng.randrange(10**6):x}" for _ in range(80)]
        words = [w + "#" if j < signs else w for j, w in enumerate(words)]
        out.append((" ".join(words), lang, int(not bad)))
    return out


def test_cutoffs_keep_good_documents_in_every_stratum(spark):
    rng = random.Random(11)
    rows = corpus(rng, 2400, "a", 0.3, 0.05) + corpus(rng, 2400, "b", 0.2, 0.4) + corpus(rng, 60, "few", 0.5, 0.0) + corpus(rng, 3000, None, 0.3, 0.0)
    docs = spark.createDataFrame([(i, t, g, None, "x") for i, (t, g, _) in enumerate(rows)], SCHEMA)
    labels = spark.createDataFrame([(i, q, "") for i, (_, _, q) in enumerate(rows) if i % 4] + [(None, 0, ""), (-1, 0, ""), (1, None, "")], LABELS)
    got = {r.doc_id: r.kept for r in quality.judged(docs, labels).collect()}
    assert len(got) == len(rows)
    for name in ("a", "b", None):
        good = [got[i] for i, (_, g, q) in enumerate(rows) if g == name and q]
        bad = [got[i] for i, (_, g, q) in enumerate(rows) if g == name and not q]
        assert good.count(False) <= quality.LIMIT * len(good)
        assert bad.count(True) <= 0.01 * len(bad), name
    assert all(got[i] for i, (_, g, _) in enumerate(rows) if g == "few")  # too few labels: nothing is certified


def test_a_rule_without_certified_cutoff_rejects_nothing(spark):
    rng = random.Random(3)
    rows = corpus(rng, 1000, "a", 0.3, 1.0)  # every good document has signs
    labelled = [(i, q, "") for i, (_, _, q) in enumerate(rows)]
    docs = spark.createDataFrame([(i, t, g, None, None) for i, (t, g, _) in enumerate(rows)], SCHEMA)
    flipped = spark.createDataFrame([(i, 1 - q, "") for i, q, _ in labelled], LABELS)
    assert all(r.kept for r in quality.judged(docs, flipped).collect())


def test_odd_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", "c", "k"), (1, text, "a", "c", "k"), (None, text, None, None, None), (2, None, "a", "", ""), (3, "", "a", "", "")]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, 0, "x"), (1, 1, "x")], LABELS)
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality.judged(docs, labels).collect())
    assert got == [(0, 60, False, True), (1, 60, False, True), (1, 60, False, True), (2, 0, True, False), (3, 0, True, False)]
    assert quality.judged(docs.limit(0), labels).count() == 0
    assert quality.judged(docs, labels.limit(0)).where("kept").count() == 3
    named = docs.withColumnRenamed("doc_id", "good")
    assert "good" in quality.judged(named, labels.withColumnRenamed("doc_id", "good"), key="good").columns

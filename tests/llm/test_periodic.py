import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import periodic, registry


def brute(words, least, exponent):
    """(start, length, period) of all runs, by comparing words at each distance."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                part = words[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    for trial in range(250):
        words = [rng.randrange(rng.choice([1, 2, 2, 3, 4])) for _ in range(rng.randrange(1, 70))]
        if trial % 3 == 0:
            base = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(20)
            words[at : at + 30] = (base * 30)[:30]
        found = periodic.runs_of(np.array([1000, *words, 1001]), 2, 2)
        got = sorted(((int(s) - 1, int(n), int(q)) for s, n, q in zip(*found, strict=True)), key=lambda r: (r[0], r[2]))
        assert got == brute(words, 2, 2), words


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words, 24, 3)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def fixture_texts():
    rng = random.Random(9)
    texts = [None, "", " \n\t", "x", "a " * 24, "a " * 23, "a b " * 12, "a b c\r\nd\x0be\x0cf " * 9, "é😀 ü " * 20 + "tail"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            base = [rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 30))]
            parts += base * rng.randrange(1, 6)
        texts.append((" " * rng.randrange(1, 3)).join(parts) + "\n" * rng.randrange(2))
    line = " ".join(f"w{i}" for i in range(60))
    return [*texts, line + "\n" + line + " other " + line, (line + " ") * 3, (line + "\n") * 4 + "end"]


def test_query_equals_brute_force(spark, tmp_path):
    texts = fixture_texts()
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "b " * 30), (5, "c d " * 30), (5, "c d " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op13_periodic_runs"](spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(((r.doc_id, *(r[c] for c in names)) for r in got), key=lambda r: str(key(r))) == sorted(((i, *expected(i, t)) for i, t in rows), key=lambda r: str(key(r)))


def test_driver_rows(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    short = [i for i, t in docs.items() if len(t or "") < 6000]
    got = {r.doc_id: r for r in registry.queries()["op13_periodic_runs"](spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for i in short:
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected(i, docs[i])


def test_spans_text_and_further_columns(spark):
    rows = spark.createDataFrame([(1, "a b c " * 10 + "end", "k"), (2, None, None)], "n int, text string, runs_of string")
    got = {r.n: r for r in periodic.collapsed(rows).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 30, 3)] and got[1].collapsed == "a b c end" and got[1].runs_of == "k"
    assert got[2].runs == [] and got[2].collapsed == ""
    assert periodic.collapsed(rows.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    text = " ".join(words[:30_000] + words[:25_000] * 3 + ["x"] * 50_000)
    (row,) = periodic.collapsed(spark.createDataFrame([(text,)], "text string")).collect()
    assert [tuple(x) for x in row.runs] == [(30_000, 75_000, 25_000), (105_000, 50_000, 1)] or len(row.runs) >= 2
    assert row.collapsed.split()[-1] == "x"

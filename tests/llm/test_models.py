import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import language, sampling, toxicity
from weftline.llm.words import ALNUM, U, Words, flat


def test_remainders_are_of_the_decimal_text(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, 123456)] + [(None,)], "doc_id long")
    got = [r["m"] for r in df.select(sampling.remainder(F.col("doc_id"), 3).alias("m")).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 for i in (0, 7, 123456)] + [None]


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    one = {r["doc_id"] for r in sampling.bounded(df, "doc_id", 300).collect()}
    assert len(one) == 300 and one == {r["doc_id"] for r in sampling.bounded(df.repartition(7), "doc_id", 300).collect()}
    assert sampling.bounded(df, "doc_id", 9000).count() == 5000


def test_toxicity_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = toxicity.op5_toxicity_ftrl(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    pos, neg = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.85
    assert (got.score.between(0, 1)).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (neg >= 0.7).mean() < 0.02


def test_toxicity_features_span_gaps_and_rows():
    data, offsets = flat(pa.array(["a b c d", "", "a b"]))
    words = Words(data, offsets, ALNUM)
    at, rows = toxicity.features(words.hashes, toxicity.row_of(words))
    counts = np.bincount(rows, minlength=3).tolist()
    assert counts == [4 + 3 + 2 + 1, 0, 2 + 1]
    assert len(set(at[rows == 2]) - set(at[rows == 0])) == 0


def test_ftrl_learns_one_feature():
    model = toxicity.Ftrl(64, 0.0)
    for i in range(400):
        model.learn(np.array([1, 2 + i % 40]), 1)
        model.learn(np.array([2 + i % 40]), 0)
    w = model.weights(slice(None))
    assert w[1] > 2 and np.abs(w[2:42]).max() < w[1] / 2


@pytest.mark.parametrize("labels", [[], [(1, None), (2, 5)], [(1, 1), (1, 1), (2, 0)]])
def test_toxicity_edge_cases(spark, labels):
    docs = spark.createDataFrame([(1, "bad words"), (2, None), (2, None), (None, ""), (3, "x " * 30000)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, y, "z") for i, y in labels], "doc_id long, label int, text string")
    got = toxicity.score(docs, toxicity.fit(labelled.select("doc_id", "label"), docs)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), (np.empty(0, np.int64), np.empty(0))).count() == 0


def test_language_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = language.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_filter_returns_all_languages_of_an_ngram():
    a, b, c = (np.arange(lo, lo + 3000, dtype=np.int64) for lo in (10**6, 10**6 + 1500, 10**7))
    table = language.Filter(["a", "b", "c"], [a, b, c])
    masks = table.masks(np.concatenate([a, b, c]).astype(U))
    masks = masks[:, 0]
    assert (masks[:3000] & U(1)).all() and (masks[1500:3000] & U(2)).all() and (masks[6000:] & U(4)).all()
    other = np.arange(5 * 10**8, 5 * 10**8 + 20_000, dtype=np.int64).astype(U)
    hits, total = table.counts(other, np.zeros(len(other), np.int64), 1)
    assert total[0] == 20_000 and table.corrected(hits, total).max() < 30  # false positives are corrected away
    again = language.Filter.unpacked(table.packed())
    assert (again.slots == table.slots).all() and again.bits == table.bits >= np.log2(24 * 3000)


def test_grams_don_t_span_words_or_rows():
    data, offsets = flat(pa.array(["ab", "", "c d"]))
    values, rows = language.grams(data, offsets)
    shown = {(int(r), (int(v) & (2**40 - 1)).to_bytes(5, "big").lstrip(b"\0").decode()) for v, r in zip(values, rows, strict=True)}
    assert {(0, " ab"), (0, "ab "), (0, " ab "), (2, " c "), (2, " d")} <= shown
    assert not any("c d" in g or "b c" in g for _, g in shown)


def test_language_edge_cases(spark):
    rows = [(1, None, "x"), (2, "12 !?", "y"), (3, "É", "fr"), (4, "", None), (None, "le la", "fr"), (5, "der die das " * 5000, "de"), (6, "der die", "de"), (7, "le la les", "fr"), (7, "le la les", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language.predict(docs, language.fit(docs)).collect()}
    assert got[(1, "und")] == got[(2, "und")] == got[(4, "und")] == 0
    assert (5, "de") in got and (7, "fr") in got and (3, "und") not in got
    nothing = language.predict(docs, language.fit(docs.where("lang is null")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language.predict(docs.limit(0), language.fit(docs)).count() == 0


def test_seventy_languages_and_a_rare_one(spark):
    """Each language has words of its own letters; one has a text in a hundred thousand, and one text is there 100,000 times."""
    word = lambda lang, k: "".join(chr(0x4E00 + 40 * lang + (k * 7 + j * 11) % 40) for j in range(3))
    rows = [(100 * lang + i, " ".join(word(lang, k + i) for k in range(40)), f"l{lang:02d}") for lang in range(70) for i in range(6)]
    docs = spark.createDataFrame(rows + [(99_999, "rare " * 30 + "words", "zz")], "doc_id long, text string, lang string")
    docs = docs.union(spark.range(100_000).selectExpr("7 AS doc_id", "'often the same' AS text", "'often' AS lang"))
    model = language.fit(docs, most=300)
    assert len(model.langs) == 72 and model.slots.shape[1] == 2
    got = language.predict(docs.where("lang <> 'often'"), model).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] == 99_999} == {"zz"}
    assert all(r["lang_pred"] == f"l{r['doc_id'] // 100:02d}" for r in got if r["doc_id"] < 7000)


def test_long_texts_are_predicted_in_slices(monkeypatch):
    data, offsets = flat(pa.array(["le la les " * 300]))
    table = language.Filter(["x"], [np.unique(language.grams(data, offsets)[0]).astype(np.int64)])
    whole = table.counts(*language.grams(data, offsets), 1)
    monkeypatch.setattr(language, "CHUNK_BYTES", 101)
    parts = [table.counts(*language.grams(part, ends), 1) for part, ends, _ in language.slices(data, offsets)]
    assert len(parts) > 20 and sum(p[0] for p in parts) == whole[0] and sum(p[1] for p in parts) == whole[1]


def test_one_doc_id_a_hundred_thousand_times_is_learned_from_once(spark):
    same = spark.range(100_000).selectExpr("1 AS doc_id", "'vile words here' AS text")
    docs = same.union(spark.createDataFrame([(i, f"good words {i}") for i in range(2, 300)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 300)], "doc_id long, label int")
    model = toxicity.fit(labels, docs, most=100)
    assert len(model[0]) >= 1
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs.dropDuplicates(["doc_id"]), model).collect()}
    assert len(score) == 299 and all(0 <= x <= 1 for x in score.values())
    found = same.selectExpr("doc_id", "length(text) AS size")
    assert len(sampling.capped(found, [found["doc_id"]], "size", 50)) == 50 and len(sampling.capped(found, [found["doc_id"]], "size", 50, 100)) == 6


def test_scores_of_long_texts_don_t_depend_on_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 97} v{i % 89}" for i in range(2000)))], "doc_id long, text string")
    model = (np.array([*range(0, 1 << 20, 50), -1]), np.array([*[0.001] * len(range(0, 1 << 20, 50)), -2.0]))
    whole = toxicity.score(docs, model).first()["score"]
    monkeypatch.setattr(toxicity, "STEP", 70)
    assert toxicity.score(docs, model).first()["score"] == pytest.approx(whole)

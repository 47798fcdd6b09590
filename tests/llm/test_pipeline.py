"""run() against its stages applied one by one in plain Python."""

import public_tokenizers
import pytest

import corpus_pipeline
from weftline.llm import near, packing, toxicity
from weftline.llm.encoding import encoder

from .test_chat_decontaminate import brute as brute_hits
from .test_near_substring import passage


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    toxic = [f"{passage(100 + i, 40)} worthless scum" for i in range(60)]
    clean = [passage(200 + i, 60) for i in range(60)]
    shared, item = passage(1, 70), passage(2, 30)
    near_copy = clean[3].split()
    near_copy[30] = "changed"
    docs = [(i, t) for i, t in enumerate([*toxic, *clean])]
    docs += [(500, " ".join(near_copy)), (501, f"{clean[5]}"), (502, f"{passage(300)}\n{shared}"), (503, f"{passage(301)}\n{shared}"), (504, f"{passage(302)} {item} {passage(303)}"), (505, None), (506, "long words " * 6000), (507, f"{passage(305)} worthless scum")]
    labels = [(i, 1, 1 if i < 60 else 0) for i in range(120)]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), dict(docs), item, shared


def test_every_stage_takes_effect(spark, tables):
    root, texts, item, shared = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept, columns = dict(texts), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == columns
        path = f"{root}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            assert not {*range(60), 507} & set(now) and {*range(60, 120), 500, 501, 502, 503, 504, 505, 506} <= set(now)
        elif name == "near_duplicates":
            assert set(kept) - set(now) == {500, 501}
        elif name == "repeated_passages":
            assert shared in now[502] and shared not in now[503] and now[503].strip() == passage(301)
            assert {k: v for k, v in now.items() if k not in (503, 506)} == {k: v for k, v in kept.items() if k not in (503, 506)}
        else:
            hits = brute_hits([(504, kept[504])], [("b1", item)])[0]
            assert len(hits[2]) == 30 and item not in now[504] and now[504].split() == (passage(302) + " " + passage(303)).split()
        kept = now
    tokens = encoder(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, root).collect()
    assert sum(r["length"] for r in packed) == sum(len(tokens.ids(t or "")) + 1 for t in kept.values())
    run = corpus_pipeline.run(spark, root)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in run.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "benchmark_passages", "packing"]
    assert toxicity.THRESHOLD == 0.7 and packing.LIMIT == 2048 and near.BANDS * near.WIDTH == 2 * near.PERMUTATIONS


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHES = ["score", "removed", "removed_words", "doc", "own", "at", "ids", "key", "h", "spans", "copy", "least_id", "n_words", "hit_words", "hit_items", "f1", "items", "wanted", "kept", "component_id", "n_shingles", "label", "length", "bucket", "number", "__toxic", "__gone", "__doc", "__spans", "__n_removed", "__removed_words"]


def test_clashing_columns_and_very_long_texts(spark, tables, tmp_path):
    """Columns named like what stages use inside come through unharmed, beside nulls, repeated rows and a text of 2 MB."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    long = " ".join(f"w{i}" for i in range(300_000))
    more = spark.createDataFrame([(900, long, "en", "s", len(long)), (900, long, "en", "s", len(long)), (901, "", "en", "s", 0), (None, passage(900), "en", "s", 1)], docs.schema)
    named = [f"'{c}' AS `{c}`" for c in CLASHES]
    docs.union(more.where("doc_id is null or doc_id <> 900")).selectExpr("*", *named).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").selectExpr("*", *[f"1 AS `{c}`" for c in CLASHES if c != "label"]).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        if name == "toxicity":  # a model of 120 short texts can't tell what 300,000 words are
            out = out.union(more.where("doc_id = 900").selectExpr("*", *named))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.where(" AND ".join(f"`{c}` = '{c}'" for c in CLASHES)).count() == docs.count() > 60
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert rows[900] == long and rows[901] == "" and rows[505] is None and rows[None] == passage(900)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("doc_id = 900").agg({"length": "sum"}).first()[0] > 300_000

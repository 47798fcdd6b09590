import pytest
from pyspark.sql import functions as F

from weftline.operators import search, segments, versions

DOC = "id long, title string, body string"


def scores(rows):
    return {r.id: (round(r.score, 9), r.terms) for r in rows.collect()}


@pytest.fixture
def docs(spark):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "alphabet", "gamme", "betta"]
    return spark.createDataFrame([(i, words[i % 8], " ".join(words[(i * j) % 8] for j in range(1, i % 9 + 1)) if i % 11 else None) for i in range(400)], DOC)


def test_an_index_grows_by_what_changes(spark, tmp_path, docs):
    root, fields, query = f"{tmp_path}/index", ["title", "body"], ["alpha", "gamma", "beta"]
    empty = segments.open_index(spark, root)
    assert empty.search(query).count() == 0
    first = empty.update(docs.where("id < 396"), fields)
    whole = first._all("postings").count()
    changed = docs.withColumn("body", F.when(F.col("id") == 5, "omega alpha").otherwise(F.col("body"))).where("id <> 17")
    second = segments.open_index(spark, root).update(changed, fields)
    added = spark.read.schema(segments.SCHEMAS["postings"]).parquet(f"{root}/{second.segments[-1]}/postings")
    assert {r.id for r in added.select("id").distinct().collect()} == {5, 396, 397, 398, 399}
    assert added.count() < 0.04 * whole
    want = scores(search.ranked(search.index_of(changed, fields), query))
    assert scores(second.search(query)) == want and scores(segments.open_index(spark, root).search(query)) == want
    merged = second.merged()
    assert len(merged.segments) == 1 and not merged.stones and scores(merged.search(query)) == want
    assert scores(first.search(query)) == scores(search.ranked(search.index_of(docs.where("id < 396"), fields), query))  # an old state stays readable
    same = merged.update(changed, fields)
    assert same._all("postings").where(F.col("segment") == same.segments[-1]).count() == 0
    assert same.update(changed.limit(0), fields).search(query).count() == 0


def shuffled(plan):
    """Rows that the shuffles of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(map(shuffled, below))


def test_a_search_shuffles_only_postings_that_it_reaches(spark, tmp_path, docs):
    index = segments.open_index(spark, f"{tmp_path}/index").update(docs.where("id < 396"), ["body"])
    index = index.update(docs.withColumn("body", F.when(F.col("id") == 5, "omega alpha").otherwise(F.col("body"))), ["body"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # to this, the postings are a large table
    try:
        found = index.search(["omega"])
        assert set(scores(found)) == {5}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shuffled(found._jdf.queryExecution().executedPlan()) < 0.25 * index._all("postings").count()


def test_postings_are_shuffled_once(spark):
    rows = [(1, "b a b", "b"), (2, None, ""), (3, "é A a-a", None), (4, " ".join(f"w{i % 70}" for i in range(3000)), "w1 w1"), (5, "", "x"), (6, "a a", None), (6, "b a", None), (None, "z", None)]
    some = spark.createDataFrame(rows, DOC.replace("title", "one").replace("body", "two"))
    got = search.clustered(some, ["one", "two"])
    made = got.collect()
    assert sorted(map(repr, made)) == sorted(map(repr, search.index_of(some, ["one", "two"]).postings.collect()))
    assert ("w69", "one", 4, 42, 3000) in made and ("a", "one", 6, 3, 2) in made
    assert shuffled(got._jdf.queryExecution().executedPlan()) == len(made) + 1  # a's of the two rows of 6 add up where they land
    keys = [(r.term, r.field) for r in made]
    assert keys == sorted(keys)


def test_only_changed_texts_are_shuffled(spark, tmp_path, docs):
    index = segments.open_index(spark, f"{tmp_path}/i").update(docs, ["title", "body"])
    now = docs.withColumn("fingerprint", F.lit("f"))
    picked = index._picked(now, spark.createDataFrame([(7, "f"), (8, "other"), (None, "f")], segments.SCHEMAS["fresh"]))
    assert [r.id for r in picked.collect()] == [7]
    assert shuffled(picked._jdf.queryExecution().executedPlan()) <= 3 + 3 + 2
    nameless = now.limit(1).withColumn("id", F.lit(None).cast("long"))
    assert index._picked(nameless, spark.createDataFrame([(None, "f")], segments.SCHEMAS["fresh"])).count() == 1


def test_segments_are_merged_when_there_are_many(spark, tmp_path, docs, monkeypatch):
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 3)
    index = segments.open_index(spark, f"{tmp_path}/i")
    for n in (100, 200, 300):  # the third is merged
        index = index.update(docs.where(f"id < {n}"), ["body"])
    assert len(index.segments) == 1 and scores(index.search(["delta"])) == scores(search.full_text(docs.where("id < 300"), ["delta"]))


def test_typos_are_found_by_pieces(spark):
    import random

    rng = random.Random(2)
    letters = "abcé"
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 15))) for _ in range(1500)} | {"x" * 70, "x" * 64, "y"})
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in range(1, 16)] + ["x" * 66, "x" * 60, "abc"]
    rows = spark.createDataFrame([(t,) for t in terms], "term string")
    by_piece = search.pieces(rows)
    got = {(r.query_term, r.term, r.weight_milli) for r in search.expanded(rows, words, by_piece).collect()}
    assert got == {(r.query_term, r.term, r.weight_milli) for r in search.expanded(rows, words).collect()}
    assert by_piece.groupBy("term").count().agg(F.max("count")).first()[0] <= 100
    assert search.expanded(rows, [], by_piece).count() == 0


def files_below(folder):
    return {str(p) for p in folder.rglob("*.parquet")}


def test_unchanged_parts_are_not_written_again(spark, tmp_path):
    schema = "id long, year long, body string"
    rows = spark.createDataFrame([(i, 2000 + i % 5 if i % 50 else None, "a/b" if i % 2 else None) for i in range(500)], schema)
    table = versions.Versions(spark, f"{tmp_path}/t", F.col("year"))
    assert table.manifest() is None and table.read(schema).count() == 0
    table.commit(rows, "v1")
    before = files_below(tmp_path / "t/data")
    edited = rows.withColumn("body", F.when((F.col("id") == 7), "new").otherwise(F.col("body"))).where("coalesce(year, 0) <> 2004").repartition(7)
    manifest = {r.part: r for r in table.commit(edited, "v2").collect()}
    new = files_below(tmp_path / "t/data") - before
    assert len({p.rsplit("/", 2)[1] for p in new}) == 1 and all("__part=2002" in p for p in new)  # id 7 is of 2002
    assert {p: r.version for p, r in manifest.items()} == {"null": "v1", "2000": "v1", "2001": "v1", "2002": "v2", "2003": "v1"}
    assert sorted(map(str, table.read(schema).collect())) == sorted(map(str, edited.collect()))
    assert table.read(schema, "v1").count() == 500
    table.commit(edited, "v3")
    assert files_below(tmp_path / "t/data") == before | new
    table.commit(edited.limit(0), "v4")
    assert table.read(schema).count() == 0 and table.read(schema, "v2").count() == edited.count()


def test_parts_with_odd_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a/b"), (2, "c=d:e"), (3, "f g%h"), (4, "[x]{y}?*\"'\\"), (5, "é")], "id long, name string")
    table = versions.Versions(spark, f"{tmp_path}/t", F.col("name"))
    table.commit(rows, "v1")
    assert sorted(r.id for r in table.read("id long, name string").collect()) == [1, 2, 3, 4, 5]


def test_a_failed_commit_leaves_the_version(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1)], "id long, year long")
    table = versions.Versions(spark, f"{tmp_path}/t", F.col("year"))
    table.commit(rows, "v1")
    with pytest.raises(Exception, match="(?i)divi"):
        table.commit(rows.withColumn("id", F.expr("assert_true(id > 1, 'division')").cast("long")), "v2")
    assert [tuple(r) for r in table.read("id long, year long").collect()] == [(1, 1)]


def test_reuse(spark):
    planned = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id long")
    before = spark.createDataFrame([(1, 1990, "old"), (2, 2020, "old"), (9, 1990, "gone")], "id long, year long, body string")
    made = spark.createDataFrame([(1, 1990, "new"), (2, 2020, "new"), (3, 2020, "new"), (4, 2020, "unplanned")], "id long, year long, body string")
    got = versions.next_version(planned, made, before, "id", F.col("year") < 2000)
    assert sorted((r.id, r.body) for r in got.collect()) == [(1, "old"), (2, "new"), (3, "new")]

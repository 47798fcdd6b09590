import pytest
from pyspark.sql import functions as F

from weftline.operators import checks, coverage, graph, quality, routes, search, snapshot, tokens


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(
    ("expected", "saved", "failed", "skipped", "given", "want"),
    [
        (["a"], ["a"], [], [], None, "covered"),
        (["a", "b"], ["a"], ["b"], [], None, "partial"),
        (["a"], [], ["a"], [], None, "failed"),
        (["a"], [], [], ["a"], None, "skipped"),
        ([], [], [], [], None, "unresolved"),
        (["a", "b"], [], ["a"], [], None, "unresolved"),
        (["a"], ["a"], [], [], "policySkipped", "policySkipped"),
    ],
)
def test_status(spark, expected, saved, failed, skipped, given, want):
    arrays = [F.array(*map(F.lit, x)).cast("array<string>") for x in (expected, saved, failed, skipped)]
    assert spark.range(1).select(coverage.status(*arrays, given=F.lit(given).cast("string")).alias("s")).first()["s"] == want


def test_shared_coverage_keeps_what_was_before(spark):
    schema = "source string, grp long, status string, reasons array<string>, expected array<string>, saved array<string>, failed array<string>, skipped array<string>"
    entries = spark.createDataFrame([("a", 1, "partial", ["alias-only-source-route"], ["x", "y"], ["x"], [], []), ("b", 1, "partial", ["r"], ["x", "y"], ["y"], [], []), ("c", 2, "policySkipped", [], [], [], [], [])], schema)
    got = {r["source"]: r for r in coverage.shared(entries, "grp").collect()}
    assert (got["a"]["status"], got["a"]["own_status"], got["a"]["reasons"], got["a"]["members"]) == ("covered", "partial", [], 2)
    assert got["c"]["status"] == "policySkipped"


def test_health_order(spark):
    def of(*warnings, failed=0, verified=False):
        w = F.array(*map(F.lit, warnings)).cast("array<string>")
        z = F.lit(0)
        return spark.range(1).select(coverage.health(w, F.lit(failed), z, z, F.lit(verified)).alias("h")).first()["h"]

    assert of("coverage-regression:1", "direct-json-failure:1") == "failed"
    assert of("direct-json-failure:1", failed=1) == "broken"
    assert of("coverage-gap:1") == "failed"
    assert of("coverage-gap:1", "coverage-partial:max-pages-limited:2") == "partial"
    assert of(verified=True) == "verified"
    assert of() == "unverified"


def test_gap_and_regression_rounding(spark):
    got = spark.range(1).select(coverage.significant_gap(F.lit(26), F.lit(20)), coverage.significant_gap(F.lit(26), F.lit(21)), coverage.regression(F.lit(7), F.lit(9)), coverage.regression(F.lit(6), F.lit(9))).first()
    assert list(got) == [True, False, False, True]


def test_reconcile_cascade(spark):
    schema = "route string, document string, collection string, carbon string"
    candidates = spark.createDataFrame([("/components/a", None, None, None), ("/alt/b", None, None, None), ("/n/c", "D1", "k", None), ("/n/d", None, None, "cc"), ("/components/tabs", None, None, None), ("/gone", None, None, None), ("/n/two", "D2", "K", None)], schema)
    entry = "slug string, alternates array<string>, document string, collection string, carbon string"
    entries = spark.createDataFrame([("components/a", [], None, None, None), ("b", ["alt/b"], None, None, None), ("c", [], "d1", "K", None), ("d", [], None, None, "CC"), ("components/tab", [], None, None, None), ("e", [], "d2", "k", None), ("f", [], "d2", "k", None)], entry)
    got = {r["route"]: (r["status"], r["slug"]) for r in routes.reconcile(candidates, entries).collect()}
    assert got == {
        "/components/a": ("exact", "components/a"),
        "/alt/b": ("alternateSlug", "b"),
        "/n/c": ("contentIdentityMatch", "c"),
        "/n/d": ("contentIdentityMatch", "d"),
        "/components/tabs": ("normalizedSlugMatch", "components/tab"),
        "/gone": ("rejectedStale", None),
        "/n/two": ("rejectedAmbiguous", None),
    }


def test_budget_keeps_required(spark):
    df = spark.createDataFrame([(1, False), (2, False), (3, True), (4, True)], "id int, required boolean")
    assert rows(routes.within_budget(df, 3, "required", ["id"]), "id") == [(1,), (3,), (4,)]
    assert rows(routes.within_budget(df, 1, "required", ["id"]), "id") == [(3,), (4,)]


def test_merge_candidates_first_and_last(spark):
    df = spark.createDataFrame([("r", 1, "", True, "a"), ("r", 2, "t", None, "b"), ("r", 3, "u", False, "a")], "route string, seq int, title string, public boolean, source string")
    got = routes.merge_candidates(df, "route", "seq", ["title"], ["public"], ["source"]).first()
    assert (got["title"], got["public"], got["source_set"]) == ("t", False, ["a", "b"])


def test_entry_conflicts_are_told(spark):
    df = spark.createDataFrame([("s", "a", None), ("s", "b", "x")], "slug string, title string, document string")
    assert routes.merge_entries(df, "slug", ["title", "document"]).first()["conflicts"] == ["title"]


def test_upserts_differ_in_place(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "id string, seq int, v string")
    assert rows(snapshot.upsert_in_place(df, "id", "seq"), "id", "v", "position") == [("a", "z", 1), ("b", "y", 2)]
    assert rows(snapshot.upsert_append(df, "id", "seq"), "id", "v", "position") == [("a", "z", 3), ("b", "y", 2)]


def test_artifacts_in_key_order(spark):
    r = spark.createDataFrame([("/a", ["/a", "/c", "/old"])], "route string, keys array<string>")
    a = spark.createDataFrame([("2", "/c"), ("1", "/old"), ("2", "/a"), ("3", "/z")], "id string, source_route string")
    assert graph.with_artifacts(r, a).first()["artifacts"] == ["2", "1"]


def test_fallback_keys_first_key_wins(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, "z", "y"), (3, None, "w")], "id int, k1 string, k2 string")
    e = spark.createDataFrame([("y", 1, "Y"), ("x", 2, "X"), ("x", 3, "XX")], "key string, seq int, v string")
    assert rows(graph.by_fallback_keys(df, ["k1", "k2"], e, "key", "seq"), "id", "v") == [(1, "X"), (2, "Y"), (3, None)]


def test_chain_end_by_doubling(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1 if i < n else None) for i in range(1, n + 1)], "a long, b long")
    got = {r["node"]: (r["end"], r["steps"]) for r in graph.follow_chain(links, "a", "b").collect()}
    assert got == {i: (n, n - i) for i in range(1, n + 1)}


def test_long_chains_and_rings(spark):
    n = 150
    links = spark.createDataFrame([(i, i + 1 if i < n else None) for i in range(1, n + 1)] + [(201, 202), (202, 203), (203, 202)], "a long, b long")
    got = {r["node"]: (r["end"], r["steps"]) for r in graph.follow_chain(links, "a", "b").collect()}
    assert got == {i: (n, n - i) for i in range(1, n + 1)} | {i: (None, None) for i in (201, 202, 203)}


def test_prefix_join_has_no_delimiter(spark):
    s = spark.createDataFrame([("a/ts1",), ("a/",), ("b",)], "s string")
    t = spark.createDataFrame([("a/ts10/x",), ("a/ts1/y",), ("bb/c",), ("c",)], "t string")
    assert rows(tokens.prefix_join(s, t, "s", "t"), "s", "t") == [("a/", "a/ts1/y"), ("a/", "a/ts10/x"), ("a/ts1", "a/ts1/y"), ("a/ts1", "a/ts10/x"), ("b", "bb/c")]


def test_two_value_dialects(spark):
    n = F.lit(None).cast("double")
    got = spark.range(1).select(tokens.colour(F.lit(1.0), n, n, n), tokens.strict_colour(F.lit(1.0), n, n, n), tokens.dimension(n, F.lit("DIPS")), tokens.strict_dimension(n, F.lit("DIPS")), tokens.colour(n, n, F.lit(0.5), F.lit(0.125)), tokens.dimension(F.lit(1.5), F.lit("PERCENT"))).first()
    assert list(got) == ["#ff0000", None, "0dp", "", "rgba(0, 0, 128, 0.13)", "1.5percent"]


def test_best_entry_rejects_and_ranks(spark):
    df = spark.createDataFrame([("t", 1, ["dark"], False), ("t", 2, None, False), ("t", 3, ["3p"], False), ("t", 4, ["light"], False), ("t", 5, ["light"], True), ("t", 6, ["light", "high.contrast"], False), ("u", 1, None, False)], "token string, seq int, tags array<string>, undefined boolean")
    assert rows(tokens.best_entries(df, ["token"], "seq"), "token", "seq", "score") == [("t", 4, 8), ("u", 1, -1)]
    assert rows(tokens.best_entries(df, ["token"], "seq", contrast="high.contrast"), "token", "seq") == [("t", 6)]


def test_score_and_reason(spark):
    facts = dict(has_title=True, has_sections=True, headings=2, text_length=90, markdown_length=90, media=1, token_tables=0, token_tables_rendered=0, status_tables=1, unknown_chunks=0, unknown_resources=0, unresolved=0, missing_sets=0, mismatch=False, placeholders=0)
    low = facts | dict(unresolved=9)
    short = facts | dict(markdown_length=79)
    got = [(r["score"], r["reason"]) for r in quality.scored(spark.createDataFrame([facts, low, short])).orderBy(F.desc("score")).collect()]
    assert got == [(11, None), (10, "json-short-markdown"), (2, "json-low-quality")]


def test_gate_reports_in_order():
    good = snapshot.Facts(page_count=20, listed_pages=20, planned=20, saved=20, discovered=20)
    assert all(p for _, _, p in snapshot.gate(good))
    bad = snapshot.Facts(page_count=20, listed_pages=19, warnings=["direct-json-failure:x"], previous_pages=100)
    failed = [n for _, n, p in snapshot.gate(bad) if not p]
    assert failed == ["page-count-matches", "no-direct-json-failure", "pages-kept"]
    assert [n for _, n, p in snapshot.gate(bad, force=True) if not p] == ["page-count-matches"]
    assert not snapshot.may_replace(True, True, limited=True, allow_partial=False)
    assert not snapshot.may_replace(False, False, limited=True, allow_partial=False)
    assert snapshot.may_replace(False, True, limited=True, allow_partial=False)


def test_expectations_and_fail_fast(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,)], "k int")
    bad = checks.expectation(1, "x", checks.orphans(a, "k", b, "k"), "orphan")
    good = checks.expectation(0, "y", checks.missing(b, a, "k"), "missing")
    assert bad.first()["reasons"] == ["orphan: 2"]
    assert [r["passed"] for r in checks.fail_fast([good, bad, good])] == [True, False]
    assert [r["place"] for r in checks.run_all([bad, good]).collect()] == [0, 1]


def test_captures_against_snapshot(spark):
    captured = spark.createDataFrame([("1", ["u1", "p1"]), ("2", ["u2"])], "id string, keys array<string>")
    have = spark.createDataFrame([(["p1", "q"],)], "keys array<string>")
    assert rows(checks.not_captured(captured, have), "id") == [("2",)]
    got = spark.range(1).select(checks.missing_headings(F.array(F.lit("A & B"), F.lit("C")), F.array(F.lit("a and b"))).alias("m")).first()["m"]
    assert got == ["c"]


def test_search_is_substring_and_unranked(spark):
    df = spark.createDataFrame([(0, 2, "page", "Split-Button!"), (0, 1, "page", "Tone"), (1, 1, "x", "none")], "ord int, id int, kind string, label string")
    assert [r["id"] for r in search.structured(df, "TON", 10).collect()] == [1, 2]
    assert search.structured(df, "  ", 10).count() == 0
    with pytest.raises(ValueError, match="limit"):
        search.structured(df, "a", 101)


def test_covered_by_slug(spark):
    r = spark.createDataFrame([("/a/b",), ("/a/b/c",), ("/a",)], "route string")
    s = spark.createDataFrame([("a/b",)], "slug string")
    assert rows(coverage.covered_by_slug(r, s), "route") == [("/a/b",), ("/a/b/c",)]


def test_versions_are_published_whole(spark, tmp_path):
    root = str(tmp_path)
    assert snapshot.current(spark, root) is None
    snapshot.publish(spark, {"t": spark.range(2)}, root, "v1")
    assert snapshot.current(spark, root).endswith("/v1")
    with pytest.raises(Exception):  # noqa: B017
        snapshot.publish(spark, {"t": spark.range(3), "u": spark.range(1).select(F.raise_error(F.lit("no")))}, root, "v2")
    assert spark.read.parquet(f"{snapshot.current(spark, root)}/t").count() == 2

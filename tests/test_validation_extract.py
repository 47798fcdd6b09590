import pytest
from pyspark.sql import functions as F

from weftline.operators import extract, validation


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def reasons(df):
    got = df.first()
    assert got["passed"] == (not got["reasons"]) and got["findings"] == len(got["reasons"])
    return got["reasons"]


MANIFEST = "carbon_version string, bundle_hash string, site_meta_hash string, sitemap_hash string"


@pytest.mark.parametrize(
    ("manifest", "kinds", "want"),
    [
        (("1", "h", "m", None), ["site-shell", "site-meta", "angular-bundle"], []),
        (("1", "h", None, "s"), ["site-shell", "sitemap", "angular-bundle"], []),
        (("1", "h", "m", None), ["site-shell", "angular-bundle"], ["no complete source of routes", "site-meta hash without artifact"]),
        ((None, "", None, None), ["sitemap"], ["no angular-bundle artifact", "no carbon version", "no complete source of routes", "no script hash", "no site-shell artifact", "sitemap artifact without hash"]),
    ],
)
def test_raw_snapshot(spark, manifest, kinds, want):
    artifacts = spark.createDataFrame([(k, k, "0" * 64) for k in kinds], "id string, kind string, sha256 string")
    assert reasons(validation.raw_snapshot(spark.createDataFrame([manifest], MANIFEST), artifacts)) == want


def test_route_graph(spark):
    schema = "route string, canonical string, aliases array<string>, tab_routes array<string>, status string, original_status string, artifacts array<string>"
    nodes = spark.createDataFrame(
        [
            ("/a", None, [], ["/a/specs"], "covered", "covered", ["1"]),
            ("/a2", "/a", [], ["/a/specs"], "covered", "covered", []),
            ("/a/specs", None, [], [], "stale", "stale", []),
            ("/b", None, ["/bb"], [], "covered", "unresolved", ["1"]),
            ("/c", None, [], [], "covered", None, []),
            ("/d", None, ["/x"], [], "covered", None, ["1"]),
            ("/e", None, ["/x"], [], "covered", None, ["1"]),
        ],
        schema,
    )
    want = spark.createDataFrame([(r,) for r in ("a/specs/", "/bb", "/c", "/x", "/none")], "route string")
    assert reasons(validation.route_graph(nodes, want)) == ["ambiguous: /x", "failed status: /bb", "no artifacts: /c", "no node: /none"]


def test_structured_graph(spark):
    pages = spark.createDataFrame([("p", "/a", ["r", "gone"], ["s"], ["c"])], "page_id string, route string, resource_ids array<string>, sections array<string>, chunks array<string>")
    resources = spark.createDataFrame([("r", ["/b"])], "resource_id string, routes array<string>")
    tables = spark.createDataFrame([("r", ["ok", "[unresolved]"])], "resource_id string, values array<string>")
    want = spark.createDataFrame([("/a",), ("/z",)], "route string")
    assert reasons(validation.structured_graph(pages, resources, tables, want)) == ["blocking value: r", "incomplete page: /z", "route missing in resource: r", "unknown resource: gone"]


def test_rendered_output(spark):
    files = spark.createDataFrame([("a.md", "text"), ("b.md", "x [Unresolved y]")], "path string, text string")
    again = spark.createDataFrame([("a.md", "text"), ("b.md", "x"), ("c.md", "new")], "path string, text string")
    want = spark.createDataFrame([("a.md",), ("d.md",)], "path string")
    assert reasons(validation.rendered_output(files, want, again)) == ["differs: b.md", "differs: c.md", "missing: d.md", "placeholder: b.md"]
    assert reasons(validation.rendered_output(files.limit(1), want.limit(1))) == []


def test_smaller_stages(spark):
    empty, one = spark.range(0), spark.range(1)
    assert reasons(validation.search_index(lambda q: empty if q == "list" else one, lambda q: empty)) == ["no result: list", "no structured result: button"]
    summary = spark.createDataFrame([("partial", 0, 1, 0)], "health string, failed int, unresolved int, partial int")
    assert reasons(validation.coverage_summary(summary)) == ["health", "unresolved routes"]
    assert reasons(validation.coverage_summary(summary, smoke=True)) == []
    counts = lambda *x: spark.createDataFrame(list(x), "name string, n int")
    assert reasons(validation.manifest_consistency(counts(("a", 1), ("b", 2)), counts(("a", 1), ("c", 0)))) == ["count of b", "count of c"]
    health = spark.createDataFrame([("verified", "partial", "verified", None)], "raw_health string, structured_health string, rendered_health string, coverage_health string")
    assert reasons(validation.manifest_health(health)) == ["coverage is not verified", "structured is not verified"]
    tables = {"routes": one, "pages": empty, "resources": one, "token_tables": one, "sections": empty}
    assert reasons(validation.graph_files(tables)) == ["empty: pages", "missing: provenance"]
    assert reasons(validation.artifact_index(empty)) == ["no artifacts"]
    names = spark.createDataFrame([("a",)], "name string")
    assert reasons(validation.cache_files(names.limit(0), names, one)) == ["missing: a"]
    routes = spark.createDataFrame([("/a",)], "route string")
    assert reasons(validation.required_pages(routes.limit(0), routes)) == ["no page: /a"]
    assert validation.browser_oracle(empty.select(F.lit("").alias("reason")), empty, strict=False) is None
    assert reasons(validation.browser_oracle(empty.select(F.lit("").alias("reason")), empty, strict=True)) == ["no captures"]


def test_orchestrators(spark):
    good = ("good", lambda: validation.artifact_index(spark.range(1)))
    bad = ("bad", lambda: validation.artifact_index(spark.range(0)))
    skip = ("skip", lambda: None)
    assert [r["passed"] for r in validation.fail_fast([skip, good, bad, good])] == [True, False]
    assert [(r["place"], r["passed"]) for r in validation.run_all([skip, good, bad, good])] == [(1, True), (2, False), (3, True)]


def test_first_success_wins_and_reasons_stay(spark):
    a = spark.createDataFrame([("p", "direct-json", False, "x", None), ("p", "network-json", True, None, "N"), ("p", "dom-fallback", True, None, "D"), ("q", "direct-json", False, "a", None), ("q", "dom-fallback", False, "b", None)], "page string, method string, ok boolean, reason string, payload string")
    assert rows(extract.accepted_attempts(a), "page", "method", "payload", "reasons") == [("p", "network-json", "N", ["x"]), ("q", "failed", None, ["a", "b"])]


def test_identity_and_mismatch(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit, null = F.lit, F.lit(None).cast("string")
    assert one(extract.identity_accepted(lit("a/b/"), F.array(lit("/a/b")), null, null))
    assert one(extract.identity_accepted(null, F.array(lit("/a")), lit("ID"), lit("id")))
    assert not one(extract.identity_accepted(lit("/c"), F.array(lit("/a")), null, lit("id")))
    no = F.array().cast("array<string>")
    assert one(extract.content_mismatch(lit("/components/top-app-bar"), lit("Top app bars"), no, lit(""))) is None
    assert one(extract.content_mismatch(lit("/components/floating-action-button"), lit("FABs"), no, lit(""))) is None
    assert one(extract.content_mismatch(lit("/components/lists"), lit("Cards"), no, lit(""))) == "slug not mentioned"
    assert one(extract.content_mismatch(lit("/components/lists"), lit("x"), F.array(lit("Components")), lit("lists"))) == "parent index"
    assert one(extract.content_mismatch(lit("/styles/x"), lit("y"), no, lit(""))) is None
    assert one(extract.non_content_index(lit("components.md"), lit("json-no-sections"))) and not one(extract.non_content_index(lit("a/b.md"), lit("json-no-sections")))
    assert one(extract.module_kind(null, lit("TYPOGRAPHY"), null)) == "token-table" and one(extract.module_kind(null, null, null)) == "placeholder"


def test_planned_outputs_and_virtual_tabs(spark):
    r = spark.createDataFrame([("a/", [("Color & Type", None), ("x", "/specs/")]), ("/", [])], "route string, tabs array<struct<label: string, slug: string>>")
    assert rows(extract.planned_outputs(r), "route", "files") == [("/", ["index.md"]), ("a/", ["a/color-type.md", "a/specs.md"])]
    p = spark.createDataFrame([("/a", ["/a/specs", "/a"], ["a/specs.md", "a/b.md"], ["a/specs.md"], ["a/b.md"], [])], "route string, tab_routes array<string>, expected array<string>, saved array<string>, failed array<string>, skipped array<string>")
    assert rows(extract.virtual_tabs(p), "route", "parent", "expected", "saved", "failed") == [("/a/specs", "/a", ["a/specs.md"], ["a/specs.md"], [])]


def test_tab_rules_in_order(spark):
    tabs = spark.createDataFrame([(1, 0, "Zero", "two", None), (1, 1, "One!", None, None), (1, 2, "None", None, None), (2, 0, "None", None, None)], "page int, pos int, label string, slug string, alternates array<string>")
    sections = spark.createDataFrame([(1, 0, "Zero"), (1, 1, "one"), (1, 2, "Two"), (2, 0, "a"), (2, 1, "b")], "page int, pos int, name string")
    assert rows(extract.match_tabs(tabs, sections), "page", "pos", "section", "matched_by") == [(1, 0, 2, "slug"), (1, 1, 1, "label"), (1, 2, 2, "position"), (2, 0, None, "tab-section-mismatch")]


def test_captured_resources(spark):
    w = spark.createDataFrame([(1, "x/y/abc", "TOKEN_TABLE"), (1, "s", "STATUS_TABLE"), (1, "q", "OTHER")], "page int, resource string, type string")
    r = spark.createDataFrame([(1, 0, "abc", "u0", "token-table"), (1, 1, "x/y/abc", "u1", "token-table"), (1, 2, None, "a/s/b", "status-table"), (2, 3, "q", "u", "dsdb-resource")], "page int, seq int, name string, url string, type string")
    assert rows(extract.captured_resource(w, r), "resource", "rule", "seq") == [("s", 3, 2), ("x/y/abc", 1, 1)]


def test_links_sets_warnings_and_reports(spark):
    nav = spark.createDataFrame([(1, '{"a": [{"href": "/components/x/", "b": {"href": "https://o.example/"}}, {"href": "/static/y"}]}')], "id int, json string")
    assert rows(extract.nav_links(nav, "id", "json", "https://s.example/"), "path") == [("/components/x",)]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(extract.display_sets(F.lit("""<token-viewer display-token-sets='["a","b"]'>"""))) == ["a", "b"]
    assert one(extract.display_sets(F.lit("<p>"))) == []
    assert one(extract.metadata_warnings(F.lit("c"), F.lit(""), F.lit(None).cast("string"))) == ["missing-document-id", "missing-exported-carbon-file-id"]
    pages = spark.createDataFrame([("/a", ["K", "K"], [], [], ["One", "Two"], ["one"]), ("/b", ["K"], [], [], [], []), ("/c", [], [], [], [], [])], "route string, unknown_chunks array<string>, unknown_resources array<string>, placeholders array<string>, source_titles array<string>, rendered_titles array<string>")
    got = {r["route"]: r for r in extract.renderer_report(pages, ["/a", "/c"]).collect()}
    assert [(got[k]["severity"], got[k]["rendered_sections"]) for k in ("/a", "/b", "/c")] == [("error", 1), ("warning", 0), ("warning", 0)]
    assert [(c["chunk"], c["count"]) for c in got["/a"]["chunks"]] == [("K", 2)]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate("abcd")], "id int, pos int, line string")
    assert rows(extract.paired_lines(lines, "id"), "name", "value") == [("a", "b"), ("c", "d")]

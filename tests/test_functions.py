import pytest
from pyspark.sql import functions as F

from weftline.functions import classify, paths, text

BASE = "https://site.example/components/buttons"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("/styles/color/", "https://site.example/styles/color"),
        ("styles/color", "https://site.example/styles/color"),
        ("https://other.example/a", None),
        ("/a/../b/./c", "https://site.example/b/c"),
        ("/logo.PNG", None),
        ("#top", BASE),
        ("mailto:a@b.c", None),
        ("//site.example/x", "https://site.example/x"),
        ("/", "https://site.example"),
        (None, None),
    ],
)
def test_normalize_url(spark, raw, want):
    assert one(spark, paths.normalize_url(F.lit(raw).cast("string"), F.lit(BASE))) == want


@pytest.mark.parametrize(("raw", "want"), [("/static/a", None), ("/a//b/", "/a/b"), ("/", "/"), ("/sitemap", None)])
def test_doc_path(spark, raw, want):
    assert one(spark, paths.doc_path(F.lit(raw), F.lit(BASE))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("pages/components/x.md", "/components/x"), ("", "/"), ("index.md", "/"), ("https://a.b/c/d/", "/c/d"), ("a\\b", "/a/b"), ("//x//", "/x")],
)
def test_graph_route(spark, raw, want):
    assert one(spark, paths.graph_route(F.lit(raw))) == want


def test_route_markdown_round_trip(spark):
    for route in ("/", "/components/buttons/specs"):
        assert one(spark, paths.graph_route(paths.markdown_path(F.lit(route)))) == route


@pytest.mark.parametrize(("token", "want"), [("galleries", ["galleries", "gallery", "galleri", "gallerie"]), ("boxes", ["boxes", "box", "boxe"]), ("as", ["as"]), ("tab", ["tab"])])
def test_singular_forms(spark, token, want):
    assert one(spark, paths.singular_forms(F.lit(token))) == want


def test_slugs_differ_on_purpose(spark):
    assert one(spark, paths.component_lookup(F.lit(" Buttons (FAB) overview "))) == "buttons-fab"
    assert one(spark, paths.component_slug(F.lit("Buttons (FAB)"))) == "buttons-fab"
    assert one(spark, paths.component_slug(F.lit("a.b c"))) == "ab-c"
    assert one(spark, paths.component_lookup(F.lit("a.b c"))) == "a-b-c"


def test_resource_basename(spark):
    assert one(spark, paths.resource_basename(F.lit("designSystems/a1/components/b2"))) == "designSystems_a1_components_b2"
    assert one(spark, paths.resource_basename(F.lit("x/TOKEN_TABLE.y"))) == "TOKEN_TABLE.y"


@pytest.mark.parametrize(("path", "tier"), [("/", 1), ("/componentsX", 1), ("develop/a", 2), ("/resources", 3), ("/blogger", 4), ("/2024/x", 4), ("/20244", 5), ("/x?components", 5)])
def test_priority(spark, path, tier):
    assert one(spark, classify.priority(F.lit(path))) == tier


@pytest.mark.parametrize(
    ("route", "sources", "redirect", "ids", "want"),
    [
        ("/components/x", ["site_meta"], None, None, "public-docs"),
        ("/components/x", ["site_meta"], "http://a", None, "redirect"),
        ("/go/x", ["site_meta"], None, None, "go-link"),
        ("/components/x.svg", ["site_meta"], None, None, "asset"),
        ("/components", ["bundle"], None, None, "non-content-index"),
        ("/develop/web/x", ["site_meta"], None, None, "unsupported-platform-or-policy"),
        ("/other", ["site_meta"], None, None, "outside-public-docs"),
        ("/components/x", ["bundle"], None, None, "missing-extraction-metadata"),
        ("/components/x", ["bundle"], None, "1", "public-docs"),
    ],
)
def test_public_docs(spark, route, sources, redirect, ids, want):
    null = lambda v: F.lit(v).cast("string")
    got = one(spark, classify.public_docs(F.lit(route), F.array(*map(F.lit, sources)), null(redirect), null(ids), null(ids), null(None)))
    assert got == want


@pytest.mark.parametrize(
    ("path", "payload", "want"),
    [
        ("/x", '{"system": {"tokenSets": []}}', "token-table"),
        ("/x", '{"rows": []}', "status-table"),
        ("/x", '{"content": {"sections": []}}', "content-page"),
        ("/x", '{"result": {"pageContext": {"title": "T"}}}', "page-metadata"),
        ("/x", '{"resourceName": "r"}', "dsdb-resource"),
        ("/a/TOKEN_TABLE.z.json", "[]", "token-table"),
        ("/_dsm/data/dsdb-m3/a.json", "not json", "dsdb-resource"),
        ("/a", "{}", "unknown-json-resource"),
    ],
)
def test_response_type(spark, path, payload, want):
    assert one(spark, classify.response_type(F.lit(path), F.try_parse_json(F.lit(payload)))) == want


def test_heading_levels_need_matching_ends(spark):
    got = one(spark, text.html_heading_levels(F.lit("<h2>A <b>b</b></h2><h3>C</h2></h3>")))
    assert [(h["level"], h["text"]) for h in got] == [(2, "A b"), (3, "C")]


@pytest.mark.parametrize(("url", "want"), [("a=w200", "a=w1600"), ("a=w800", "a=w800"), ("a=s0", "a=w1600"), ("a=w2", "a=w1600"), ("a=w99999999999", "a=w99999999999"), ("b", "b")])
def test_upscaled_image(spark, url, want):
    assert one(spark, text.upscaled_image(F.lit(url))) == want


def test_excerpt_starts_at_zero_without_the_word(spark):
    assert one(spark, text.excerpt(F.lit("alpha  beta\n gamma"), "zz nothing")) == "alpha beta gamma"
    assert one(spark, text.excerpt(F.lit("x" * 300 + " needle"), "is needle")).endswith("needle")


@pytest.mark.parametrize(("ms", "want"), [(999, "1s"), (59_499, "59s"), (60_000, "1m"), (61_000, "1m1s"), (3_600_000, "1h"), (3_900_000, "1h5m")])
def test_duration(spark, ms, want):
    assert one(spark, text.duration(F.lit(ms))) == want


def test_title_mismatch(spark):
    assert one(spark, classify.title_mismatch(F.lit("/components/icon-buttons"), F.lit("Icon things")))
    assert not one(spark, classify.title_mismatch(F.lit("/components/icon-buttons"), F.lit("Icon Buttons!")))
    assert not one(spark, classify.title_mismatch(F.lit("/styles/x"), F.lit("")))

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import decode, diagnostics, discover, tokens
from weftline.plans import diagnostic_plans

NOTE = "path string, seq long, token_tables array<struct<name:string>>, placeholders array<string>, status_tables array<struct<name:string,rendered:boolean,unsupported:boolean>>, images long, videos long, unknown_chunks array<string>, unknown_resources array<string>"
ROUTE = "path string, seq long, source_route string, normalized_route string, virtual_route string, canonical_route string, tab string, tab_section long"
PAGE = "page_id string, path string, title string, section string, headings array<string>"
FILE = "id string, kind string, seq long, source_route string, local_path string"


@pytest.fixture(scope="module")
def notes(spark):
    rows = [
        ("a/b.md", 1, [("old",)], [], [], 5, 5, [], []),
        ("a/b.md", 2, [("designSystems/d/components/c",), (None,)], ["broken"], [("s", True, None), ("", False, True)], 2, 1, ["GRID"], ["X"]),
        ("c.md", 3, [("designSystems/d/components/c",)], None, [("s", False, False)], 0, None, None, ["Y"]),
    ]
    return spark.createDataFrame(rows, NOTE)


@pytest.fixture(scope="module")
def routes(spark):
    return spark.createDataFrame([("a/b.md", 1, "/x", None, None, None, None, None), ("a/b.md", 2, "https://h/a/b/", "/n", "/a/b/specs/", "", "Specs", 4), ("c.md", 3, None, None, None, "", "", None)], ROUTE)


def test_chunks_of_a_page_are_in_order_and_have_stable_ids(spark, notes, routes):
    pages = spark.createDataFrame([("p", "a/b.md", "T", "s", ["One", "Two"]), ("q", "none.md", None, None, None), ("r", "c.md", "C", "s", [])], PAGE)
    nodes = diagnostics.page_graph(pages, notes, routes)
    got = {r.page_id: r for r in nodes.collect()}
    p = got["p"]
    assert [c.chunk_id for c in p.chunks] == [
        "chunk-0-text", "chunk-1-text", "chunk-token-table-0", "chunk-token-table-1", "chunk-token-table-placeholder-0", "chunk-status-table-0", "chunk-status-table-1",
        "chunk-image-0", "chunk-image-1", "chunk-video-0", "chunk-unsupported-0",
    ]
    assert p.resource_ids[:5] == ["token-table:designSystems/d/components/c", "token-table:a/b.md:1", "token-table:a/b.md:placeholder:0", "status-table:s", "status-table:a/b.md:1"]
    assert p.token_table_ids == p.resource_ids[:3] and p.unsupported == ["GRID"]
    assert (p.route, p.source_route, p.canonical_route, p.virtual_route) == ("/a/b/specs", "/a/b", None, "/a/b/specs")
    assert tuple(p.tab) == ("Specs", "/a/b/specs/", 4) and [c.excerpt for c in p.chunks[2:5]] == ["designSystems/d/components/c", "token table", "token table (broken)"]
    assert (got["q"].route, got["q"].chunks, got["q"].sections, got["q"].tab) == ("/none", [], [], None)
    assert [c.resource_id for c in got["r"].chunks] == ["token-table:designSystems/d/components/c", "status-table:s"] and got["r"].tab is None
    rows = diagnostics.chunk_rows(nodes).where("page_id = 'p'").orderBy("place").collect()
    assert [r.chunk_id for r in rows] == [c.chunk_id for c in p.chunks] and [r.place for r in rows] == list(range(11))
    sections = diagnostics.section_graph(nodes).orderBy("section_id").collect()
    assert [(r.section_id, r.title, r.heading_level, r.chunk_ids) for r in sections] == [("p:section-0", "One", 1, ["chunk-0-text"]), ("p:section-1", "Two", 2, ["chunk-1-text"])]
    files = spark.createDataFrame([("f", "page-data", 1, "/a/b/", "x"), ("g", "other", 2, "/a/b", "x"), ("h", "dsdb-resource", 3, "pages/a/b.md", "x"), ("i", "page-data", 4, None, "x")], FILE)
    assert {(r.page_id, r.artifact_id) for r in diagnostics.page_artifacts(nodes, files).collect()} == {("p", "f"), ("p", "h")}


def rows_made(plan):
    """The most rows that a step of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if plan.metrics().contains("numOutputRows") else 0
    return max([own, *map(rows_made, below)])


def test_artifacts_are_counted_before_pages_meet_them(spark, tmp_path):
    n = 3000  # rows of each table: 25 routes of 72 pages with artifacts, and of 120 artifacts, would be 100,000 pairs and more
    of = spark.range(1, n + 1)
    of.select(F.col("id").alias("o_orderkey"), (F.col("id") % 500).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    of.select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    of.where("id = 1").select(F.lit(900).cast("long").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    of.select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    out = diagnostic_plans.diagnostic_page_artifacts(spark, str(tmp_path))
    got = {(r.page_id, r.kind): (r.artifacts, r.first) for r in out.collect()}
    assert rows_made(out._jdf.queryExecution().executedPlan()) <= 4 * n
    pages = diagnostics.routed_pages(diagnostic_plans._pages(spark, str(tmp_path)), diagnostic_plans._route_notes(spark, str(tmp_path)))
    each = diagnostics.page_artifacts(pages, diagnostic_plans._artifacts(spark, str(tmp_path))).groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.min_by("artifact_id", "seq").alias("first"))
    assert got == {(r.page_id, r.kind): (r.n, r.first) for r in each.collect()} and sum(c for c, _ in got.values()) > 40 * n


def test_artifacts_of_a_repeated_page_add_up(spark):
    nodes = spark.createDataFrame([("p", "/x"), ("p", "/y"), ("q", "/y"), ("r", "/z"), (None, "/y"), ("s", None)], "page_id string, artifact_route string")
    files = spark.createDataFrame([("f", "page-data", 5, "/x", ""), ("g", "page-data", 2, "/y/", ""), ("h", "dsdb-resource", 1, "/y", ""), ("i", "page-data", 3, "/y", ""), ("j", "other", 0, "/y", ""), ("k", "page-data", 0, None, "")], FILE)
    got = {(r.page_id, r.kind, r.artifacts, r.first) for r in diagnostics.page_artifact_counts(nodes, files).collect()}
    own = {(p, k, n, f) for p in ("q", None) for k, n, f in (("page-data", 2, "g"), ("dsdb-resource", 1, "h"))}
    assert got == own | {("p", "page-data", 3, "g"), ("p", "dsdb-resource", 1, "h")}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_resources_are_the_same_from_any_partitioning(spark, notes, routes, parts):
    files = spark.createDataFrame([("late", "dsdb-resource", 9, None, "raw/designSystems_d_components_c.json"), ("first", "dsdb-resource", 2, None, "raw//designSystems_d_components_c.JSON/"), ("no", "page-data", 1, None, "raw/s.json")], FILE)
    uses = diagnostics.resource_uses(notes.repartition(parts), routes)
    got = {r.resource_id: r for r in diagnostics.resource_graph(uses.repartition(parts), files).collect()}
    c = got["token-table:designSystems/d/components/c"]
    assert (c.kind, c.status, c.routes, c.chunks, c.first.seq) == ("token-table", "resolved", 1, 1, 2) and c.artifact_id == "late"
    assert (got["status-table:s"].status, got["status-table:s"].routes) == ("resolved", 1)  # its first use says so
    assert (got["status-table:a/b.md:1"].status, got["status-table:a/b.md:1"].reason) == ("unresolved", "unsupported-status-table-schema")
    assert got["token-table:a/b.md:placeholder:0"].reason == "broken" and got["unknown-resource:c.md:0"].reason == "unknown-resource-type:Y"
    assert got["image:a/b.md:4"].first.seq == 1 and "video:c.md:0" not in got
    members = {(r.resource_id, r.member, r.value) for r in diagnostics.resource_members(uses).collect()}
    assert ("status-table:s", "route", "/a/b/specs") in members and ("status-table:s", "chunk", "chunk-status-table-0") in members
    assert not any(v is None for _, _, v in members)


def test_graphs_of_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    nodes = diagnostics.page_graph(none(PAGE), none(NOTE), none(ROUTE))
    assert nodes.count() == diagnostics.chunk_rows(nodes).count() == 0
    assert diagnostics.resource_graph(diagnostics.resource_uses(none(NOTE), none(ROUTE)), none(FILE)).count() == 0


def walk(value):
    """Sections by a plain walk of the tree, objects before their members, in order."""
    if isinstance(value, list):
        return next((x for x in map(walk, value) if x), [])
    if not isinstance(value, dict):
        return []
    like = lambda s: isinstance(s, dict) and any(isinstance(s.get(k), list) for k in discover.LISTS)
    own = next((v for v in value.values() if isinstance(v, list) and any(map(like, v))), [])
    shown = [(i, s.get("name") or "Section") for i, s in enumerate(own) if isinstance(s, dict) and s.get("isVisible") is not False and s.get("visible") is not False]
    return shown or next((x for x in map(walk, value.values()) if x), [])


def random_tree(rng, depth):
    kind = rng.randrange(8) if depth else rng.randrange(4)
    if kind < 2:
        return rng.choice([None, 1, True, "x", '{"blocks":[]}', "chunks"])
    if kind == 2:
        return {"name": rng.choice("abc"), rng.choice([*discover.LISTS, "other"]): rng.choice([[], [1], "no"]), "isVisible": rng.random() < 0.6}
    if kind == 3:
        return [random_tree(rng, 0) for _ in range(rng.randrange(3))]
    if kind < 6:
        names = rng.sample(["z", "y", "a", "b", "blocks", "m"], rng.randrange(1, 4))
        return {k: random_tree(rng, depth - 1) for k in names}
    return [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))]


def test_discovery_equals_a_plain_walk(spark):
    import random

    rng = random.Random(8)
    trees = [random_tree(rng, 5) for _ in range(1500)]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(1000, None), (1001, "{broken"), (1002, "")]
    found = discover.discovered(spark.createDataFrame(rows, "k long, j string"), "k", "j")
    got = {}
    for r in decode.section_rows(found, "k").select("k", "section_pos", "title").collect():
        got.setdefault(r.k, []).append((r.section_pos, r.title))
    want = {i: walk(t) for i, t in enumerate(trees) if walk(t)}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 60


def test_known_places_come_first(spark):
    rows = [(1, json.dumps({"sections": [], "x": [{"name": "found", "blocks": []}]})), (2, json.dumps({"page": {"sections": [{"name": "placed"}]}, "x": [{"blocks": []}]})), (3, "[]")]
    got = [(r.k, r.title) for r in discover.all_sections(spark.createDataFrame(rows, "k long, j string"), "k", "j").orderBy("k").collect()]
    assert got == [(1, "found"), (2, "placed")]
    page = spark.createDataFrame([('{"name": "N", "body": "<p>"}',)], "j string").select(discover.content_page(F.col("j")).alias("p")).first().p
    assert (page.title, page.fallback_html) == ("N", "<p>")


VALUES = [
    ('{"c":{"red":1,"blue":0.5}}', None, "#ff0080"), ('{"c":{"green":0.2,"alpha":0.255}}', None, "rgba(0, 51, 0, 0.26)"), ('{"c":{"red":"1"}}', None, None), ('{"c":{"red":null,"alpha":null}}', None, "#000000"), ('{"c":{}}', None, None),
    ('{"d":{"unit":"DIPS","value":4}}', None, "4dp"), ('{"d":{"unit":"SP"}}', None, "0sp"), ('{"d":{"unit":"PERCENT","value":1.5}}', None, "1.5percent"), ('{"d":{"unit":"DIPS","value":"4"}}', None, None), ('{"d":{"unit":"DIPS","x":1}}', None, None),
    ('{"l":[1,"a",null,true,[2,3]]}', None, "1, a, true, 2, 3"), ('{"b":1,"a":"x"}', None, "1 x"), ('{"undefined":true,"x":1}', None, None), ('{"undefined":false,"x":0}', None, "0"),
    ('{"t":{"values":[{"unit":"SP","value":2},3]}}', None, "2sp, 3"), ('{"s":{"family":"ROUND","defaultSize":{"unit":"POINTS","value":1},"corners":[{"unit":"DIPS","value":1},{"unit":"DIPS"}]}}', None, "ROUND 1sp 1dp, 0dp"), ('{"s":{"family":3,"corners":4}}', None, None),
    ('{"t":{"fontNames":["A","B"],"fontWeight":500,"fontSize":{"values":[{"unit":"SP","value":9}]},"lineHeight":0}}', None, "A, B 500 9sp"), ('{"t":{"fontWeight":"bold"}}', None, None),
    ('{"a":{"tag":"wght","value":400}}', "AXIS_VALUE", '{"tag":"wght","value":400}'), ('{"a":{"tag":"é\\""}}', "AXIS_VALUE", '{"tag":"é\\""}'), ('{"a":{"tag":"w","value":"4"}}', "AXIS_VALUE", None), ('{"a":{"tag":"w","x":1}}', "AXIS_VALUE", None), ('{"a":5}', "AXIS_VALUE", None),
    ("{}", None, None), ("[1]", None, None), ("{broken", None, None), (None, None, None),
]


def test_token_values(spark):
    df = spark.createDataFrame([(i, v, k) for i, (v, k, _) in enumerate(VALUES)], "i int, v string, k string")
    got = {r.i: r.x for r in df.select("i", tokens.resolved_value(F.col("v"), F.col("k")).alias("x")).collect()}
    assert [got[i] for i in range(len(VALUES))] == [shown for _, _, shown in VALUES]


def test_reasons_are_decided_by_all_entries_of_a_token(spark):
    entries = [
        ("t", "undefined", 1, ["light"], True, '{"undefined":true}'), ("t", "elevated", 1, ["elevated"], False, '{"x":1}'), ("t", "elevated", 2, None, True, '{"undefined":true}'),
        ("t", "dark", 1, ["dark"], False, '{"x":1}'), ("t", "empty", 1, None, False, '{"undefined":false}'), ("t", "odd", 1, None, False, '{"x":{"y":1}}'), ("t", "tracking", 1, None, False, '{"fontTracking":{}}'),
        ("t", "high", 1, ["high.contrast"], False, '{"x":{"y":1}}'), ("t", "high", 2, None, False, '{"x":"v"}'), ("t", "best", 1, ["light"], False, '{"x":"one"}'), ("t", "best", 2, ["light", "3p"], False, '{"x":"two"}'), ("t", "best", 3, ["light", "3p"], False, '{"x":"three"}'),
    ]
    own = [("t", "s", name, "FONT_TRACKING" if name == "tracking" else "COLOR") for name in ("none", "undefined", "elevated", "dark", "empty", "odd", "tracking", "high", "best")]
    cells = tokens.token_cells(spark.createDataFrame(own, "table string, set string, token string, kind string"), spark.createDataFrame(entries, "table string, token string, seq long, tags array<string>, undefined boolean, value string"))
    got = {(r.token, r.role): r.value or r.reason for r in cells.collect()}
    light = {t: v for (t, role), v in got.items() if role == "light"}
    assert light == {
        "none": "upstream-empty", "undefined": "upstream-empty", "elevated": "missing-context-entry", "dark": "missing-context-entry", "empty": "upstream-empty", "odd": "unsupported-value-type", "tracking": "upstream-empty", "high": "v", "best": "two",
    }
    assert got["dark", "dark"] == "1" and got["best", "dark"] == "missing-context-entry"
    assert {k: v for k, v in got.items() if "high-contrast" in k[1]} == {("high", "light-high-contrast"): "unsupported-value-type", ("high", "dark-high-contrast"): "unsupported-value-type"}
    reasons = {r.reason: (r.cells, r.rows) for r in tokens.resolution(cells).collect()}
    assert len(reasons) == 6 and reasons["missing-alias-target"] == (0, 0) and sum(c for c, _ in reasons.values()) == sum(r.reason is not None for r in cells.collect())

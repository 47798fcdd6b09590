import json
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from weftline.operators import snapshot
from weftline.plans import api
from weftline.streaming import progress

ROUTES = [
    dict(seq=0, route="/components/buttons", canonical="/components/buttons", aliases=["/components/button-old"], section="components", status="partial", reasons=["r"], expected=["a", "b"], saved=["a"], failed=[], skipped=[], artifacts=["k:2", "k:1"], tabs=["specs"], shared_with=["/components/buttons", "/gone"]),
    dict(seq=1, route="/components/buttons/specs", canonical=None, aliases=[], section="components/buttons", status="covered", reasons=[], expected=[], saved=[], failed=[], skipped=[], artifacts=[], tabs=[], shared_with=[]),
    dict(seq=2, route="/styles/color", canonical=None, aliases=["/components/buttons"], section="styles", status="covered", reasons=[], expected=[], saved=[], failed=[], skipped=[], artifacts=[], tabs=[], shared_with=[]),
]
PAGES = [dict(seq=0, page_id="p1", route="/components/buttons", title="Buttons", url="https://s/components/buttons", section="components", path="components/buttons/overview.md", headings=["Usage"], markdown="---\nt\n---\nA filled button is loud.", resource_ids=["token-table:b"], section_ids=["s1"])]
SECTIONS = [dict(seq=0, section_id="s1", page_id="p1", title="Usage", chunks=[dict(chunk_id="c", kind="TEXT", text="Press it")])]
RESOURCES = [dict(seq=0, resource_id="token-table:b", kind="token-table", name="B", status="resolved", routes=["/components/buttons/specs"], page_ids=["p1"], artifact_id="k:1", reason=None)]
TOKENS = [dict(seq=0, resource_id="token-table:b", name="B", routes=["/components/buttons/specs"], sets=[dict(name="Set", tokens=[dict(name="btn.color", value="#fff", resolved=True, reason=None)])])]
PROVENANCE = [dict(subject="page:p1", artifact_ids=["k:1"], source_method="direct")]
ARTIFACTS = [dict(seq=i, id=f"k:{i}", kind="k", local_path=str(i), source_route="/components/buttons", sha256="0", bytes=5000, text="y" * 5000) for i in (1, 2)]
DIAGNOSTICS = [dict(seq=0, route="/a", path="a.md", status="failed", reason="x"), dict(seq=1, route="/b", path="b.md", status="skipped", reason="y")]


@pytest.fixture(scope="module")
def snap(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("snap"))
    data = {"routes": ROUTES, "pages": PAGES, "sections": SECTIONS, "resources": RESOURCES, "token_tables": TOKENS, "provenance": PROVENANCE, "artifacts": ARTIFACTS, "diagnostics": DIAGNOSTICS}
    for name, rows in data.items():
        spark.createDataFrame(rows, api.SCHEMAS[name]).write.parquet(f"{root}/{name}")
    return api.Snapshot(spark, root)


def test_nineteen_named_queries():
    assert len(api.TOOLS) == 19


def test_lookups(snap):
    assert api.get_route(snap, "components/buttons/").first()["seq"] == 0  # exact before alias
    assert api.get_route(snap, "/components/button-old").first()["seq"] == 0
    assert api.get_route(snap, "/nope").count() == 0
    assert api.get_docs_page(snap, "https://s/components/buttons").first()["page_id"] == "p1"
    assert api.get_page(snap, "/components/buttons", "markdown", 5).first()["markdown"] == "---\nt"
    assert api.get_page(snap, "/components/buttons").first()["sections"][0]["title"] == "Usage"
    assert [r["id"] for r in api.get_page(snap, "/components/buttons", "provenance").collect()] == ["k:1"]
    assert [r["id"] for r in api.get_route_artifacts(snap, "/components/buttons").collect()] == ["k:2", "k:1"]
    assert len(api.get_raw_artifact(snap, "k:1").first()["text"]) == 2000
    assert len(api.get_raw_artifact(snap, "k:1", full=True).first()["text"]) == 5000
    with pytest.raises(ValueError, match="view"):
        api.get_page(snap, "/", "x")


def test_structured_search_order(snap):
    got = [(r["kind"], r["route"]) for r in api.search_structured_docs(snap, "b").collect()]
    assert [k for k, _ in got] == ["route", "route", "route", "page", "section", "token", "resource"]
    assert [r["kind"] for r in api.search_structured_docs(snap, "buttons usage").collect()] == ["page", "section"]


def test_component_queries(snap):
    got = api.get_component_overview(snap, "Button").first()
    assert (got["resources"], got["token_table"], got["image"], got["tokens"]) == (1, 1, 0, 1)
    assert got["recommended"] == ["/components/buttons/specs", "/components/buttons"]
    assert api.get_component_tokens(snap, "buttons").count() == api.get_component_resources(snap, "buttons").count() == 1
    assert api.get_component_tabs(snap, "buttons").first()["tabs"] == ["specs"]
    assert [r["component"] for r in api.list_components(snap).collect()] == ["buttons"]
    assert api.get_component_docs(snap, "buttons", include_markdown=True, max_chars=3).first()["markdown"] == "---"
    assert api.get_component_docs(snap, "color").count() == 0


def test_lists_and_explanations(snap):
    got = api.list_routes(snap, status="covered", limit=1).collect()
    assert [(r["route"], r["has_page"], r["total_matched"], r["truncated"]) for r in got] == [("/components/buttons/specs", False, 2, True)]
    told = api.explain_route_coverage(snap, "/components/buttons").first()
    assert told["missing"] == ["b"] and [(m["member"], m["status"]) for m in told["members"]] == [("/components/buttons", "partial"), ("/gone", "partial")]
    assert api.explain_resource_resolution(snap, "token-table:b").first()["told"] == "decoded"
    assert [r["route"] for r in api.docs_cache_diagnostics(snap, failed=True).collect()] == ["/a"]
    assert api.search_docs(snap, "loud buton").first()["path"] == "components/buttons/overview.md"
    assert api.search_docs(snap, "usage").first()["path"] == "components/buttons/overview.md"  # a heading
    unwritten = api.search_docs(snap, "loud buton").first()["score"]
    api.build_search_index(snap)
    assert snap.available("search/terms") and api.search_docs(snap, "loud buton").first()["score"] == pytest.approx(unwritten)
    assert api.docs_cache_status(snap).count() == 0  # no manifest: data, not an error


def test_refresh_publishes_only_what_passes(spark, tmp_path):
    s = api.Snapshot(spark, str(tmp_path))
    good = snapshot.Facts(page_count=10, listed_pages=10)
    pages = lambda *ids: {"pages": spark.createDataFrame([dict(PAGES[0], page_id=i) for i in ids], api.SCHEMAS["pages"])}
    bad = api.refresh_docs(s, pages("a"), "v1", snapshot.Facts())
    assert not all(r["passed"] for r in bad.collect()) and snapshot.current(spark, s.root) is None
    assert len(snapshot.gate(good)) == snapshot.CHECKS == bad.count() - 1
    other = api.Snapshot(spark, s.root)
    api.refresh_docs(s, pages("b"), "v2", good)
    assert snapshot.current(spark, s.root).endswith("v2") and [r["page_id"] for r in s.table("pages").collect()] == ["b"]
    assert other.table("pages").count() == 0  # opened before; sees it when refreshed
    other.refresh()
    assert [r["page_id"] for r in other.table("pages").collect()] == ["b"]
    api.refresh_docs(s, pages("c"), "v3", good, limited=True, verified_full=True)
    assert [r["page_id"] for r in api.Snapshot(spark, s.root).table("pages").collect()] == ["b"]
    api.refresh_docs(s, pages("c"), "v3", good, limited=True, verified_full=True, allow_partial=True)
    assert [r["page_id"] for r in api.Snapshot(spark, s.root).table("pages").collect()] == ["c"]


def test_a_publish_that_fails_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path)
    snapshot.publish(spark, {"t": spark.range(3)}, root, "v1")
    with pytest.raises(Exception, match="no luck"):
        snapshot.publish(spark, {"t": spark.range(1), "u": spark.range(1).selectExpr("raise_error('no luck') as x")}, root, "v2")
    assert snapshot.current(spark, root) == f"{root}/v1" and spark.read.parquet(f"{root}/v1/t").count() == 3
    snapshot.publish(spark, {"t": spark.range(2)}, root, "v3")
    assert snapshot.current(spark, root) == f"{root}/v3"
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_file() and not p.name.endswith(".crc")) == ["CURRENT"]


EVENTS = "event_id long, ts timestamp, kind string"


def write_events(path, name, rows):
    (path / name).write_text("\n".join(json.dumps({"event_id": i, "ts": t, "kind": k}) for i, t, k in rows))


def test_stream_equals_batch(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write_events(logs, "1.json", [(1, "2024-01-01T00:00:01Z", "a"), (2, "2024-01-01T00:00:04Z", "b"), (3, "2024-01-01T00:00:06Z", "c")])
    write_events(logs, "2.json", [(4, "2024-01-01T01:00:00Z", "d")])
    schema = spark.createDataFrame([], EVENTS).schema
    stream = progress.throttled_stream(progress.event_stream(spark, str(logs), schema), "ts", "5 seconds", "1 second", "event_id", ["kind"])
    query = stream.writeStream.format("memory").queryName("throttled_out").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = progress.throttled(spark.read.schema(schema).json(str(logs)), "ts", "5 seconds", "event_id", ["kind"])
    assert sorted(map(tuple, spark.table("throttled_out").collect())) == sorted(map(tuple, batch.collect()))
    assert [r["kind"] for r in batch.orderBy("window_start").collect()] == ["b", "c", "d"]


def test_refresh_sees_only_what_is_new(spark, tmp_path):
    logs, seen = tmp_path / "logs", []
    logs.mkdir()
    schema = spark.createDataFrame([], EVENTS).schema
    for n in (1, 2):
        write_events(logs, f"{n}.json", [(n, "2024-01-01T00:00:01Z", "a")])
        stream = progress.event_stream(spark, str(logs), schema)
        progress.refresh(stream, str(tmp_path / "check"), lambda df, _: seen.append([r["event_id"] for r in df.collect()])).awaitTermination(120)
    assert seen == [[1], [2]]
    progress.append_log(progress.event_stream(spark, str(logs), schema), str(tmp_path / "out"), str(tmp_path / "check2")).awaitTermination(120)
    assert spark.read.schema(schema).json(str(tmp_path / "out")).count() == 2


def test_single_flight():
    class Query:
        isActive = True

        def stop(self):
            self.isActive = False

    flight = progress.SingleFlight(Query)
    first, started = flight.request()
    assert started and flight.request() == (first, False)
    flight.cancel()
    assert flight.request()[0] is not first


def test_single_flight_of_many_threads():
    class Slow:
        isActive = True

        def __init__(self):
            time.sleep(0.05)

    flight = progress.SingleFlight(Slow)
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: flight.request(), range(8)))
    assert len({id(q) for q, _ in got}) == 1 and sum(started for _, started in got) == 1

import json

import pytest

from weftline.operators import pages, routes, tokens


def test_page_nodes_of_odd_snapshots(spark):
    whole = {"pageCanonId": "c", "sections": [None, {"name": "A", "contentBlocks": [None, {"title": "T", "contentChunks": [None, {"htmlValue": "<h2>One <b>two</b></h2><h2>A</h2>"}, {"contentChunkType": "video", "videoUrl": "v"}]}]}, {"isVisible": True, "contentBlocks": None}]}
    rows = [("/a/b", json.dumps(whole)), ("/none", "{broken"), ("/empty", "{}"), ("/null", None), ("/bare", json.dumps({"sections": [{"name": "Only"}]}))]
    got = {r["route"]: r for r in pages.page_nodes(pages.carbon_chunks(spark.createDataFrame(rows, "route string, json string"), "route", "json")).collect()}
    assert set(got) == {"/a/b", "/bare"}
    assert got["/a/b"]["page_id"] == "c" and got["/a/b"]["headings"] == ["b", "A", "T", "One two", "Section"]
    assert (got["/a/b"]["chunks"], got["/a/b"]["texts"], got["/a/b"]["resources"]) == (2, 1, ["video:v"])
    assert got["/a/b"]["sections"] == ["/a/b:section-0", "/a/b:section-1"] and got["/bare"]["chunks"] == 0


@pytest.mark.parametrize(("value", "found"), [(None, None), ("", None), ("[1", None), ("5", None), ('{"a": {"id": true}, "b": [{"id": 7}]}', "7"), ('{"a": {"id": "deep"}, "id": "top"}', "top"), ('[[{"x": {"id": " y "}}], {"id": "z"}]', "y")])
def test_deep_search(spark, value, found):
    df = spark.createDataFrame([(value,)], "j string")
    assert df.select(pages.deep_first(df["j"], ["id"]).alias("f")).first()["f"] == found


def test_reports_and_empty_tables(spark, tmp_path):
    pages.write_report(spark.range(3), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 3
    entries = spark.createDataFrame([], "route string, public boolean, redirect string, aliases array<string>")
    assert tuple(routes.site_meta_counts(entries).first()) == (0, 0, 0, 0)
    uses = spark.createDataFrame([(1, "t", "token-table", None, None, None, "/r"), (2, "t", "token-table", "N", "", ["b", "a"], "/q"), (3, "u", "image", None, None, None, "/r")], "seq long, resource_id string, kind string, name string, artifact_id string, sets array<string>, route string")
    assert [tuple(r) for r in tokens.request_groups(uses).collect()] == [("t", "N", None, ["a", "b"], ["/q", "/r"])]

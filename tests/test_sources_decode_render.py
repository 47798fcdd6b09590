import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import decode, render
from weftline.sources import site


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, json string")


PAGE = {
    "title": "Buttons",
    "content": {
        "sections": [
            {"title": "A", "visible": True, "blocks": [{"hidden": False, "chunks": [{"type": "IMAGE", "imageUrl": "u"}, 3, {"htmlValue": "<p>x</p>"}]}, "bad", {"hidden": True, "chunks": [{}]}]},
            {"name": "B", "isVisible": False, "contentBlocks": []},
            None,
            {"contentBlocks": [{"contentChunks": [{"contentChunkType": "RESOURCE", "moduleConfigurationOverrides": {"tokenSets": ["s1", " ", 4]}, "deep": {"k": "x/TOKEN_TABLE.y"}}, {"cards": []}]}]},
        ]
    },
}


def test_content_page_keeps_valid_siblings(spark):
    found = decode.sections(frame(spark, json.dumps(PAGE)), "id", "json")
    assert [(r["section_pos"], r["title"]) for r in found.orderBy("section_pos").collect()] == [(0, "A"), (3, "Section")]
    got = decode.chunks(decode.blocks(found, "id"), "id").orderBy("section_pos", "block_pos", "chunk_pos").collect()
    assert [r["kind"] for r in got] == ["IMAGE", "TEXT", "RESOURCE", "UNKNOWN_CHUNK"]
    assert (got[2]["resource"], got[2]["token_sets"]) == ("x/TOKEN_TABLE.y", ["s1", "4"])


@pytest.mark.parametrize("bad", [None, "", "not json", "[]", "3", '"x"', "null", "{}", '{"sections": 3}', '{"sections": [1, null, "x"]}', '{"content": {"sections": {}}}'])
def test_bad_content_decodes_to_nothing(spark, bad):
    found = decode.sections(frame(spark, bad), "id", "json")
    assert decode.chunks(decode.blocks(found, "id"), "id").count() == 0


def test_token_system_drops_nameless_items(spark):
    system = {"system": {"tokens": [{"name": "t", "state": 3}, {"name": " "}, 5], "tokenSets": [{"name": "s", "displayName": "S"}], "tags": [{}], "contextualReferenceTrees": {"t": {"contextualReferenceTree": [{"contextTags": ["a"], "resolvedValue": {"undefined": True}, "referenceTree": {"tokenName": "p", "childNodes": [{"tokenName": "q", "childNodes": []}]}}]}}}}
    got = decode.token_system(frame(spark, json.dumps(system), "{}", "x", '{"system": {"tokens": [], "tokenSets": []}}'), "id", "json")
    row = got.first()
    assert got.count() == 1
    assert [t["name"] for t in row["tokens"]] == ["t"]
    assert [s["displayName"] for s in row["sets"]] == ["S"]
    entry = decode.context_entries(got, "id").first()
    assert (entry["token"], entry["tags"], entry["undefined"], entry["alias"]) == ("t", ["a"], True, "q")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ({"headers": ["a", ""], "rows": [["1", 2], ["", ""]]}, (["a"], [["1", "2"]])),
        ({"columns": [{"label": "x"}], "statuses": [["y"]]}, (["x"], [["y"]])),
        ({"payload": {"headers": ["p"], "rows": [["q"]]}}, (["p"], [["q"]])),
        ({"connections": [{"displayName": "B", "status": "NOT_READY"}, {"displayName": "A", "status": "DONE", "resourceUrl": "u", "orderInComponent": 1}, {"displayName": "C"}]}, (["Platform", "Status"], [["[A](u)", "Done"], ["B", "Not ready"]])),
        ({"headers": [], "rows": []}, None),
        ([], None),
    ],
)
def test_status_table(spark, raw, want):
    got = frame(spark, json.dumps(raw)).select(decode.status_table(F.col("json")).alias("t")).first()["t"]
    assert (None if got is None else (got["headers"], got["rows"])) == want


def test_page_metadata_paths(spark):
    got = frame(spark, '{"result": {"pageContext": {"title": " ", "slug": "s"}}, "title": "T"}').select(decode.page_metadata(F.col("json")).alias("m")).first()["m"]
    assert (got["title"], got["pathname"], got["canon_id"]) == ("T", "s", None)


def test_markdown_of_html():
    html = "<head><title>t</title></head><h1>Head</h1><p>One <b>two</b> <a href='/x'>three</a></p><ul><li>a<li>b</ul><p>close</p><pre><code>close\n  keep</code></pre><img src='i=w200' alt='pic'><table><tr><th>A|B</th><th></th></tr><tr><td>1</td></tr></table><script>var x = '</p>';</script>"
    got = render.html_to_markdown(html)
    assert "# Head" in got and "One **two** [three](/x)" in got and "\n- a\n- b" in got
    assert "![pic](i=w1600)" in got and "| A\\|B | Column 2 |\n| --- | --- |\n| 1 |  |" in got
    assert "close\n  keep" in got and "\nclose\n\n```" not in got and "var x" not in got
    assert render.html_to_markdown(None) is None and render.html_to_markdown("") == ""


def test_table_markdown_pads(spark):
    got = spark.range(1).select(render.table_markdown(F.array(F.lit("a"), F.lit("")), F.array(F.array(F.lit("1")), F.array(F.lit("2"), F.lit("3"), F.lit("4")))).alias("m")).first()["m"]
    assert got == "| a | Column 2 | Column 3 |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 | 3 | 4 |"


def test_site_meta_is_string_aware(spark):
    script = 'site_meta = []; window.site_meta = {"routes": {"/a": {"public": false, "other_routes": ["}"], "reference": {"document_id": 7}}, "/b": 3, "/c": {}}};'
    files = spark.createDataFrame([(script,), ("nothing",), (None,)], "text string")
    got = {r["route"]: (r["public"], r["document_id"], r["aliases"]) for r in site.site_routes(files).collect()}
    assert got == {"/a": (False, "7", ["}"]), "/c": (True, None, [])}


def test_route_table_in_script(spark):
    script = 'x=[{"slug":"a/b","documentId":"d","alternateSlugs":["c"],"tabs":[{"label":"Specs"}]},{"slug":""},{q:{"slug":"e"}}],v={carbonVersion:"9"}'
    rows = site.route_table(spark.createDataFrame([("p", script)], "path string, text string")).orderBy("seq").collect()
    assert [(r["slug"], r["documentId"], r["alternateSlugs"]) for r in rows] == [("a/b", "d", ["c"]), ("e", None, None)]
    assert rows[0]["tabs"][0]["label"] == "Specs"
    assert spark.createDataFrame([(script,)], "t string").select(site.carbon_version(F.col("t")).alias("v")).first()["v"] == "9"


def test_sitemap_falls_back_to_any_url(spark):
    df = spark.createDataFrame([("<loc> https://a/b </loc>",), ("see https://c/d now",), ("none",)], "x string")
    assert [r["u"] for r in df.select(site.sitemap_urls(F.col("x")).alias("u")).collect()] == [["https://a/b"], ["https://c/d"], []]


def test_transient_statuses(spark):
    df = spark.createDataFrame([(s,) for s in (None, 408, 425, 429, 500, 503, 404, 200)], "s int")
    assert [r["t"] for r in df.select(site.is_transient(F.col("s")).alias("t")).collect()] == [True] * 6 + [False] * 2


def test_first_candidate_that_parses(spark):
    c = spark.createDataFrame([(1, ["u0", "u1", "u2"])], "id int, urls array<string>")
    f = spark.createDataFrame([("u1", "broken{"), ("u2", "{}")], "url string, text string")
    assert site.first_readable(c, f).first()["url"] == "u2"


def test_files_previews_and_missing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "specs.md").write_text("x" * 3000)
    (tmp_path / "index.json").write_text("{}")
    found = site.artifacts(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (len(r["text"]), r["truncated"]) for r in site.preview(found).collect()}
    assert got == {"specs.md": (2000, True), "index.json": (2, False)}
    assert not any(r["truncated"] for r in site.preview(found, full=True).collect())
    assert site.artifacts(spark, str(tmp_path), "specs.md").count() == 1
    assert [r["name"] for r in site.missing_files(found, ("index.json", "x.json")).collect()] == ["x.json"]
    assert site.whole_files(spark, str(tmp_path / "index.json")).first()["text"] == "{}"

"""Queries for decoders, the renderer and scanners: authored JSON and the pages' HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_title
from ..operators import decode, discover, render
from ..sources import site
from ..sources.tables import table


def variant_decode_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as content-page JSON of one section, decoded back to chunks, with a hidden block and a broken sibling."""
    chunk = F.struct(F.lit("TEXT").alias("contentChunkType"), F.col("html").alias("htmlValue"))
    blocks = F.array(F.struct(F.lit("shown").alias("title"), F.lit(False).alias("isHidden"), F.array(chunk).alias("contentChunks")), F.struct(F.lit("hidden").alias("title"), F.lit(True).alias("isHidden"), F.array(chunk).alias("contentChunks")))
    page = F.struct(html_title(F.col("html")).alias("title"), F.array(F.struct(F.lit("Main").alias("name"), F.lit(True).alias("isVisible"), blocks.alias("contentBlocks"))).alias("sections"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.to_json(page).alias("json"))
    found = decode.chunks(decode.blocks(decode.sections(rows, "page_id", "json"), "page_id"), "page_id")
    return found.select("page_id", F.col("section_pos").cast("long").alias("section_pos"), F.col("block_pos").cast("long").alias("block_pos"), "kind", F.sha2("html", 256).alias("html_sha"))


def page_metadata_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as page-data JSON whose id is a number in every third row, decoded by coalesced paths."""
    context = F.struct(html_title(F.col("html")).alias("title"), F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("pageCanonId"), F.col("url").alias("slug"), F.lit("ComponentsM3").alias("collectionName"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct(F.struct(context.alias("pageContext")).alias("result"))).alias("json"))
    return rows.select("page_id", decode.page_metadata(F.col("json")).alias("m")).select("page_id", "m.canon_id", "m.pathname", "m.collection")


def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", render.markdown("html").alias("markdown"))
    return rows.select("page_id", "markdown", F.length("markdown").cast("long").alias("n"))


def site_meta_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site maps as scripts, one for a page, scanned back to routes."""
    body = F.concat(F.lit('window.site_meta = {"routes": {"/p'), F.col("page_id").cast("string"), F.lit('": {"public": '), F.when(F.col("page_id") % 5 == 0, "false").otherwise("true"), F.lit(', "other_routes": ["/q'), F.col("page_id").cast("string"), F.lit('", "}"], "reference": {"document_id": '), F.col("page_id").cast("string"), F.lit("}}}}; var x = {};"))
    files = table(spark, sf_dir, "pages").select("url", body.alias("text"))
    return site.site_routes(files).select("route", "public", "document_id", F.array_join("aliases", ",").alias("aliases"))


def discovered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as content JSON whose sections stand at no known place, at depths of their own, behind lists that are hidden or hold other things."""
    n = F.col("page_id")
    quoted = F.to_json(F.struct(F.substring("url", 1, 20).alias("t")))  # {"t":"..."}, as safe JSON
    section = lambda name, extra, blocks='{"title":"T","chunks":[]}': F.concat(F.lit('{"z":1,"name":"'), name, F.lit('","a":'), quoted, F.lit(f'{extra},"blocks":[{blocks}]}}'))
    good = F.concat(F.lit("["), section(F.concat(F.lit("S"), n.cast("string")), ""), F.lit(',7,{"visible":false,"chunks":[]},'), section(F.lit("more"), ""), F.lit("]"))
    gone = F.concat(F.lit("["), section(F.lit("gone"), ',"isVisible":false', ""), F.lit("]"))
    late = F.concat(F.lit("["), section(F.lit("late"), ""), F.lit("]"))
    text = F.lit('"{\\"parts\\":[{\\"blocks\\":[]}]}"')  # a text that looks like sections
    inner = F.concat(F.lit('{"note":'), text, F.lit(',"old":'), gone, F.lit(',"zz":{"deep":{"parts":'), good, F.lit(',"b":'), late, F.lit('}},"aa":{"parts":'), late, F.lit("}}"))
    deep = (n % 6).cast("int")
    inner = F.concat(F.repeat(F.lit('{"k":[[1],{"blocks":3},'), deep), inner, F.repeat(F.lit("]}"), deep))
    json = F.when(n % 10 == 9, F.concat(F.lit('{"sections":['), section(F.lit("known"), ""), F.lit('],"q":'), inner, F.lit("}"))).when(n % 10 == 8, "{broken").when(n % 10 == 7, text).otherwise(inner)
    found = discover.all_sections(table(spark, sf_dir, "pages").select("page_id", json.alias("json")), "page_id", "json")
    blocks = decode.blocks(found, "page_id").groupBy("page_id", "section_pos").agg(F.count("*").alias("n_blocks"))
    return found.join(blocks, ["page_id", "section_pos"], "left").select("page_id", F.col("section_pos").cast("long").alias("section_pos"), "title", F.sha2(F.try_variant_get("body", "$.a.t", "string"), 256).alias("own"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))


def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as token systems: two tokens, one set, a tag, and for every token a tree with as many entries as the part's number says."""
    p, name, size = F.col("p_partkey"), F.col("p_brand"), F.col("p_size").cast("string")
    node = lambda own, child: F.struct(own.alias("tokenName"), child.alias("childNodes"))
    leaf = F.struct(F.concat(F.lit("end."), size).alias("tokenName"))
    chain = node(F.lit("first"), F.array(node(F.when(p % 3 == 0, "middle"), F.when(p % 4 != 0, F.array(leaf)))))
    entry = lambda i: F.struct(F.when(i % 3 != 0, F.array(F.lit("t1"), F.concat(F.lit("k"), i.cast("string")))).alias("contextTags"), F.struct(F.when(i == 2, F.lit(True)).alias("undefined"), size.alias("x")).alias("resolvedValue"), chain.alias("referenceTree"))
    tree = F.struct(F.when(p % 5 > 0, F.transform(F.sequence(F.lit(1), (p % 5).cast("int")), entry)).alias("contextualReferenceTree"))
    token = lambda own, state: F.struct(own.alias("name"), F.lit("n").alias("tokenName"), F.when(p % 2 == 0, "label").alias("displayName"), F.lit("COLOR").alias("tokenValueType"), F.lit(state).alias("state"))
    system = F.struct(
        F.array(token(name, "ACTIVE"), token(F.when(p % 6 != 0, F.concat(name, F.lit(".x"))), "DEPRECATED"), token(F.lit(" "), "ACTIVE")).alias("tokens"),
        F.when(p % 7 != 0, F.array(F.struct(F.lit("Brand").alias("name"), F.lit("set").alias("displayName")))).alias("tokenSets"), F.array(F.struct(F.lit("t1").alias("name"), F.lit("light").alias("tagName"))).alias("tags"),
        F.create_map(name, tree).alias("contextualReferenceTrees"),
    )
    json = F.when(p % 11 == 0, "{}").when(p % 2 == 0, F.to_json(F.struct(system.alias("system")))).otherwise(F.to_json(system))
    return decode.token_system(table(spark, sf_dir, "part").select("p_partkey", json.alias("json")), "p_partkey", "json")


def token_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, sets and tags of decoded systems; nameless items are dropped, their siblings stay."""
    names = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["name"], x["displayName"])), ",").alias(c)
    return _systems(spark, sf_dir).select("p_partkey", names("tokens"), names("sets"), F.array_join(F.transform("tags", lambda t: t["tagName"]), ",").alias("tags"), F.size("trees").cast("long").alias("trees"))


def token_context_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode.context_entries(_systems(spark, sf_dir), "p_partkey")
    return rows.select("p_partkey", "token", F.col("pos").cast("long").alias("pos"), F.array_join("tags", ",").alias("tags"), "undefined", "value", "alias")


def chunk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of lines: the resource that each names at one of its places, and the token sets that it asks for."""
    k, text_ = F.col("l_partkey"), lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("r/"), text_("l_suppkey"))
    sets = F.array(F.lit(" "), F.col("l_returnflag"), F.col("l_linestatus"))
    at = lambda n, v: F.when(k % 6 == n, v)
    chunk = F.struct(
        at(0, name).alias("resourceName"), at(1, name).alias("resourcePath"), at(2, F.struct(F.concat(F.lit("a TOKEN_TABLE "), name).alias("deep"))).alias("data"), F.lit(" ").alias("resourceUrl"),
        F.struct(at(3, name).alias("resourceName"), F.when(k % 4 == 1, sets).alias("tokenSets")).alias("moduleConfigurationOverrides"), F.struct(F.when(k % 4 == 2, sets).when(k % 4 == 1, F.array(F.lit("no"))).alias("tokenSets")).alias("moduleConfiguration"),
    )
    v = decode.variant(F.col("json"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(chunk).alias("json"))
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), decode.resource_name(v).alias("resource"), F.array_join(decode.requested_sets(v), ",").alias("sets"))


_OWN = "sha256(left(url, 20))"

QUERIES = {
    "discovered_sections": (discovered_sections, """SELECT page_id, 0 AS section_pos, CASE WHEN page_id % 10 = 9 THEN 'known' ELSE 'S' || page_id END AS title, OWN AS own, 1 AS n_blocks FROM pages WHERE page_id % 10 NOT IN (7, 8)
UNION ALL SELECT page_id, 3, 'more', OWN, 1 FROM pages WHERE page_id % 10 < 7""".replace("OWN", _OWN)),
    "variant_decode_fixture": (variant_decode_fixture, "SELECT page_id, 0::BIGINT AS section_pos, 0::BIGINT AS block_pos, 'TEXT' AS kind, sha256(html) AS html_sha FROM pages"),
    "token_systems": (token_systems, """SELECT p_partkey, array_to_string([p_brand || CASE WHEN p_partkey % 2 = 0 THEN '=label' ELSE '=' END, CASE WHEN p_partkey % 6 <> 0 THEN p_brand || '.x' || CASE WHEN p_partkey % 2 = 0 THEN '=label' ELSE '=' END END], ',') AS tokens,
  CASE WHEN p_partkey % 7 <> 0 THEN 'Brand=set' ELSE '' END AS sets, 'light' AS tags, 1 AS trees FROM part WHERE p_partkey % 11 <> 0"""),
    "token_context_entries": (token_context_entries, """SELECT p_partkey, p_brand AS token, i - 1 AS pos, CASE WHEN i % 3 <> 0 THEN 't1,k' || i END AS tags, i = 2 AS undefined,
  CASE WHEN i = 2 THEN '{"undefined":true,"x":"' || p_size || '"}' ELSE '{"x":"' || p_size || '"}' END AS value, CASE WHEN p_partkey % 4 <> 0 THEN 'end.' || p_size WHEN p_partkey % 3 = 0 THEN 'middle' ELSE 'first' END AS alias
  FROM part, unnest(range(1, p_partkey % 5 + 1)) AS t(i) WHERE p_partkey % 11 <> 0"""),
    "chunk_requests": (chunk_requests, """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_partkey % 6 = 2 THEN 'a TOKEN_TABLE r/' || l_suppkey WHEN l_partkey % 6 < 4 THEN 'r/' || l_suppkey END AS resource,
  CASE WHEN l_partkey % 4 IN (1, 2) THEN l_returnflag || ',' || l_linestatus ELSE '' END AS sets FROM lineitem"""),
    "page_metadata_decode": (page_metadata_decode, "SELECT page_id, 'c' || page_id AS canon_id, url AS pathname, 'components' AS collection FROM pages"),
    "render_markdown": (render_markdown, None),
    "site_meta_routes": (site_meta_routes, "SELECT '/p' || page_id AS route, page_id % 5 <> 0 AS public, page_id::VARCHAR AS document_id, '/q' || page_id || ',}' AS aliases FROM pages"),
}

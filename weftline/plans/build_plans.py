"""Queries for page and token-table building, summaries, scores and text helpers, over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, paths, text
from ..operators import decode, pages, quality, routes, snapshot, tokens
from ..sources.tables import table


def response_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.response_type_counts(table(spark, sf_dir, "events"), "event_type")


def response_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captured responses, of which each property holds for some."""
    c = F.col
    holds = {"payload_title": c("o_orderstatus") == "F", "meta_path": c("o_totalprice") > 100000, "has_sections": c("o_custkey") % 10 == 1, "url_has_route": c("o_orderpriority") == "1-URGENT", "path_is_route": c("o_custkey") % 3 == 0, "title_is_token": F.when(c("o_custkey") % 2 == 0, c("o_custkey") % 5 == 0), "url_fits_kind": c("o_orderkey") % 7 < 3}
    return table(spark, sf_dir, "orders").select("o_orderkey", quality.response_score(holds).alias("score"))


def site_meta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    route = F.concat(F.lit("/c"), n.cast("string"))
    rows = table(spark, sf_dir, "customer").select(route.alias("route"), F.when(n % 5 == 0, False).when(n % 7 != 0, True).alias("public"), F.when(n % 11 == 0, "https://x/").when(n % 2 == 0, "").alias("redirect"), F.when(n % 3 != 0, F.array(route, F.concat(F.lit("/n"), F.col("c_nationkey").cast("string")))).alias("aliases"))
    return routes.site_meta_counts(rows)


def rejected_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a route plan, suppliers as the route graph; once with all sources, once without the graph."""
    n = F.col("c_custkey")
    plan = table(spark, sf_dir, "customer").select(n.alias("route"), (n % 2 == 0).alias("stale"), F.when(n % 3 == 0, "public-docs").when(n % 3 == 1, "non-content-index").alias("class"))
    graph = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route"), F.when(F.col("s_acctbal") < 1000, "nonContent").otherwise("covered").alias("status"))
    return routes.rejected_summary(plan, None, graph, 4).union(routes.rejected_summary(None, plan, None))


def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates of their nation, named by some of the sources: their place in the order."""
    n = F.col("s_suppkey")
    sources = F.array_compact(F.array(F.when(n % 7 == 0, "site_meta"), F.when(n % 3 == 0, "sitemap"), F.when(n % 5 == 0, "nav_drawer"), F.when(n % 2 == 0, "rendered_nav"), F.lit("bundle")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", sources.alias("sources"), F.concat(F.lit("/"), n.cast("string")).alias("route"))
    order = Window.partitionBy("s_nationkey").orderBy(*routes.candidate_order(F.col("sources"), F.col("route")))
    return rows.select("s_suppkey", routes.candidate_priority(F.col("sources")).cast("long").alias("priority"), F.row_number().over(order).cast("long").alias("place"))


def token_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    uses = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 8 + c("l_linenumber")).alias("seq"), c("l_partkey").alias("resource_id"), F.when(c("l_linenumber") % 2 == 1, "token-table").otherwise("image").alias("kind"), F.when(c("l_quantity") > 20, c("l_linestatus")).otherwise("").alias("name"), F.when(c("l_quantity") > 30, c("l_orderkey").cast("string")).alias("artifact_id"), F.when(c("l_discount") > 0.02, F.array(F.element_at(F.array(*map(F.lit, ("AIR", "RAIL", "SHIP", "MAIL"))), (c("l_suppkey") % 4 + 1).cast("int")))).alias("sets"), c("l_returnflag").alias("route"))
    found = tokens.request_groups(uses)
    return found.select("resource_id", "name", "artifact_id", F.array_join("sets", ",").alias("sets"), F.array_join("routes", ",").alias("routes"))


def token_table_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as tokens of five tables, their first words as sets; one table asks for all, others for one set or label."""
    c = F.col
    own = table(spark, sf_dir, "part").withColumn("resource_id", c("p_partkey") % 5)
    found = own.select("resource_id", F.concat("p_type", F.lit("/"), c("p_partkey").cast("string")).alias("token"), F.when(c("p_partkey") % 3 == 0, "DEPRECATED").otherwise("ACTIVE").alias("state"), (c("p_size") > 10).alias("resolved"))
    word = F.split("p_type", " ")[0]
    requested = F.when(c("resource_id") == 1, F.array().cast("array<string>")).when(c("resource_id") > 1, F.array(F.lit("STANDARD"), F.lit("promo")))
    sets = own.select("resource_id", word.alias("set"), F.lower(word).alias("label"), requested.alias("requested")).distinct()
    nodes = tokens.table_nodes(found, sets)
    return nodes.select("resource_id", "set", F.size("tokens").cast("long").alias("n"), F.array_min("tokens").alias("first"), F.array_max("tokens").alias("last"), "unresolved")


def token_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    entries = table(spark, sf_dir, "lineitem").select(F.element_at(F.array(*map(F.lit, ("AIR", "RAIL", "SHIP", "MAIL"))), (c("l_suppkey") % 4 + 1).cast("int")).alias("set"), (c("l_partkey") % 40).alias("token"), F.when(c("l_quantity") > 2, F.array("l_returnflag", "l_linestatus")).otherwise(F.array().cast("array<string>")).alias("tags"), ((c("l_quantity") > 48) & (c("l_returnflag") != "R")).alias("selected"), (c("l_discount") > 0.05).alias("fallback"))
    found = tokens.context_diagnostics(entries)
    return found.select("set", *(F.array_join(x, ",").alias(x) for x in ("available", "selected", "skipped")), "unresolved", "used_fallback", "several")


def public_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(F.when(n % 4 != 0, F.concat(F.lit("p"), n.cast("string"))).alias("path"), F.when(n % 3 != 0, F.concat(F.lit("T"), n.cast("string"))).alias("title"), F.when(n % 2 == 0, "url").alias("source_url"), F.when(n % 5 != 0, F.col("url")).alias("url"), F.when(n % 6 == 0, "s").alias("section"), F.when(n % 7 == 0, F.array(F.lit("h1"), F.lit("h2"))).alias("headings"), F.when(n % 8 == 0, "2024").alias("captured_at"))
    return pages.public_index(rows, "now").withColumn("headings", F.array_join("headings", ","))


def carbon_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as content snapshots of three sections, one of them hidden, built into page nodes."""
    n = F.col("page_id")
    texts = F.array(F.struct(F.lit("TEXT").alias("contentChunkType"), F.col("html").alias("htmlValue"), F.lit(None).cast("string").alias("imageUrl")), F.struct(F.lit("Image").alias("contentChunkType"), F.lit(None).cast("string").alias("htmlValue"), F.col("url").alias("imageUrl")), F.struct(F.lit("EMBED").alias("contentChunkType"), F.lit(None).cast("string").alias("htmlValue"), F.lit(None).cast("string").alias("imageUrl")))
    block = lambda title, hidden: F.struct(F.lit(title).alias("title"), F.lit(hidden).alias("isHidden"), texts.alias("contentChunks"))
    section = lambda name, own, shown, blocks: F.struct(F.lit(name).alias("name"), own.alias("pageSectionId"), F.lit(shown).alias("isVisible"), blocks.alias("contentBlocks"))
    none = F.lit(None).cast("string")
    parts = F.array(section("Main", none, True, F.array(block("Block", False), block("Hidden", True))), section("Gone", none, False, F.array(block("Lost", False), block("Lost", False))), section("More", F.lit("s9"), True, F.array(block("Block", False), block("Last", True))))
    page = F.struct(F.when(n % 2 == 0, F.concat(F.lit("id"), n.cast("string"))).alias("pageId"), F.when(n % 3 == 0, F.concat(F.lit("Title "), n.cast("string"))).alias("title"), parts.alias("sections"))
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("/p/"), n.cast("string")).alias("route"), F.to_json(page).alias("json"))
    found = pages.page_nodes(pages.carbon_chunks(rows, "route", "json"))
    return found.select("route", "page_id", F.array_join("headings", "\n").alias("headings"), F.array_join("sections", ",").alias("sections"), "chunks", "texts", "unsupported", F.array_join("resources", ",").alias("resources"))


def stable_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    own = F.concat(F.lit('{ "b": "'), F.col("event_type"), F.lit('", "a": [ {"d": '), e, F.lit(', "c": null}, [] ], "B": {"z": true, "y": false} }'))
    return table(spark, sf_dir, "events").select("event_id", pages.stable_json(F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(own)).alias("json"))


def deep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand at the top of some payloads, deep below in others, and as numbers in some."""
    n = F.col("event_id")
    top = F.when(n % 2 == 0, F.lit("top")).otherwise(F.lit(" "))
    own = F.concat(F.lit('{"list": [{"n": 1}, {"deep": {"name": "'), F.col("event_type"), F.lit('"}}, {"name": "later"}], "name": "'), top, F.lit('"}'))
    own = F.when(n % 5 == 0, F.concat(F.lit('[[{"x": {"title": '), n.cast("string"), F.lit("}}]]"))).when(n % 7 == 0, "{}").otherwise(own)
    return table(spark, sf_dir, "events").select("event_id", pages.deep_first(own, ("name", "title")).alias("found"))


def public_docs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    heads = ("/components", "/components/x", "/styles/y.png", "/go/z", "/develop/web/a", "/develop/b", "/news/c", "/about")
    route = F.element_at(F.array(*map(F.lit, heads)), (n % 8 + 1).cast("int"))
    sources = F.array_compact(F.array(F.when(n % 3 != 0, "bundle"), F.when(n % 4 == 0, "site_meta"), F.when(n % 5 == 0, "sitemap")))
    given = lambda k, name: F.when(n % k == 0, name).when(n % k == 1, "")
    kind = classify.public_docs(route, sources, F.when(n % 17 == 0, "/r"), given(2, "C"), given(3, "D"), given(2, "K"), include_blog=True)
    return table(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"))


def promotion_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promotion gate over a run whose totals are those of the tables: every check with its verdict."""
    one = lambda name, *aggs: table(spark, sf_dir, name).agg(*aggs).first()  # noqa: E731  a row of totals
    page, distinct = one("pages", F.count("*"), F.count_distinct("page_id"))
    planned, failed, missing = one("orders", F.count("*"), F.count_if(F.col("o_orderstatus") == "P"), F.count_if(F.col("o_totalprice") < 0))
    tried, broken = one("supplier", F.count("*"), F.count_if(F.col("s_acctbal") < 0))
    found, old = one("customer", F.count("*"), F.count_if(F.col("c_acctbal") > 0))
    groups = table(spark, sf_dir, "pages").groupBy(F.sha2("html", 256)).count().where("count > 1").count()
    facts = snapshot.Facts(page_count=page, listed_pages=distinct, planned=planned, saved=planned - failed, failed=failed, expected=found, unattempted=found - old, duplicate_groups=groups, sources_attempted=tried, sources_failed=broken, discovered=old, previous_discovered=found, previous_pages=page, missing_samples=missing, uncovered_routes=broken, token_tables_requested=5, blog_attempts=1)
    return spark.createDataFrame(snapshot.gate(facts), "place long, name string, passed boolean")


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, slugs, file names, image links and table cells made of page addresses."""
    n, url = F.col("page_id"), F.col("url")
    image = F.concat(F.lit("https://i/x"), F.when(n % 3 == 0, F.concat(F.lit("=w"), (n % 1200).cast("string"))).when(n % 3 == 1, "=s0").otherwise("=h20"))
    cell = F.concat(F.lit("a|b\\ "), F.lit("\n "), url)
    return table(spark, sf_dir, "pages").select("page_id", paths.promotion_key(F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit(".md"))).alias("promotion"), paths.kebab(F.concat(F.lit(" The "), url)).alias("kebab"), paths.safe_segment(url).alias("segment"), text.upscaled_image(image).alias("image"), text.escaped_cell(cell).alias("cell"), paths.resource_basename(F.concat(F.lit("designSystems/a/components/c"), n.cast("string"), F.lit("/x"))).alias("resource"))


def status_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as status tables of two connections in an order of their own, a nameless third, or of plain columns."""
    name, n = F.col("s_name"), F.col("s_suppkey")
    linked = F.concat(F.lit('{"connections": [{"displayName": "'), name, F.lit('", "status": "IN_PROGRESS"}, {"displayName": "W", "status": "DONE", "resourceUrl": "u/'), n.cast("string"), F.lit('", "orderInComponent": 1}, {"displayName": "", "status": "X"}]}'))
    plain = F.concat(F.lit('{"payload": {"columns": ["A", {"label": "B"}, ""], "rows": [["'), name, F.lit('", 2], ["", ""]]}}'))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", decode.status_table(F.when(n % 3 == 0, plain).when(n % 3 == 1, linked).otherwise("{}")).alias("t"))
    return rows.select("s_suppkey", F.array_join("t.headers", ",").alias("headers"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "=")), ";").alias("rows"))


def token_value_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as token values of every shape, with sizes and weights of their own."""
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    shapes = ('{"color": {"red": 1, "blue": 0.5}}', '{"color": {"green": 0.2, "alpha": 0.255}}', '{"length": {"unit": "DIPS", "value": #}}', '{"length": {"unit": "PERCENT"}}', '{"shape": {"family": "ROUND", "defaultSize": {"unit": "POINTS", "value": #.5}, "corners": [{"unit": "DIPS", "value": 1}, {"unit": "DIPS"}]}}', '{"type": {"fontNames": ["A", "B"], "fontWeight": #, "lineHeight": {"unit": "SP", "value": 20}}}', '{"axis": {"tag": "wght", "value": #}}', '{"tracking": {"values": [{"unit": "SP", "value": #}, 3]}, "undefined": false}', '{"undefined": true, "x": 1}', '{"odd": {"red": "no"}}', "broken")
    json = F.replace(F.element_at(F.array(*map(F.lit, shapes)), (n % 11 + 1).cast("int")), F.lit("#"), size)
    return table(spark, sf_dir, "part").select("p_partkey", tokens.resolved_value(json, F.when(n % 11 == 6, "AXIS_VALUE")).alias("shown"))


_SCORE = " + ".join(f"CASE WHEN {holds} THEN {quality.SCORES[name]} ELSE 0 END" for name, holds in {"payload_title": "o_orderstatus = 'F'", "meta_path": "o_totalprice > 100000", "has_sections": "o_custkey % 10 = 1", "url_has_route": "o_orderpriority = '1-URGENT'", "path_is_route": "o_custkey % 3 = 0", "title_is_token": "o_custkey % 2 = 0 AND o_custkey % 5 = 0", "url_fits_kind": "o_orderkey % 7 < 3"}.items())
_LIST = lambda items: ", ".join(f"'{x}'" for x in items)
_STARTS = lambda items: "(" + " OR ".join(f"starts_with(route, '{x}')" for x in items) + ")"

QUERIES = {
    "response_type_counts": (response_type_counts, "SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1"),
    "response_scores": (response_scores, f"SELECT o_orderkey, ({_SCORE})::BIGINT AS score FROM orders"),
    "site_meta_counts": (site_meta_counts, """WITH r AS (SELECT c_custkey % 5 = 0 AS hidden, c_custkey % 11 = 0 AS away, CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS others FROM customer)
SELECT count(*) FILTER (NOT hidden AND NOT away) AS public, count(*) FILTER (hidden) AS private, count(*) FILTER (NOT hidden AND away) AS redirect, coalesce(sum(others) FILTER (NOT hidden AND NOT away), 0)::BIGINT AS alias FROM r"""),
    "rejected_routes": (rejected_routes, """WITH p AS (SELECT count(*) FILTER (c_custkey % 2 = 0 AND c_custkey % 3 = 0) AS s, count(*) FILTER (c_custkey % 3 = 1) AS e FROM customer)
SELECT s AS stale_public, 'routePlanSummary' AS source, 4::BIGINT AS policy_skipped, (SELECT count(*) FROM supplier WHERE s_acctbal < 1000) AS non_content FROM p
UNION ALL SELECT s, 'coverageDiagnostics.fullRoutePlanSummary', 0, e FROM p"""),
    "candidate_order": (candidate_order, """WITH r AS (SELECT *, '/' || s_suppkey AS route, CASE WHEN s_suppkey % 7 = 0 THEN 0 WHEN s_suppkey % 5 = 0 THEN 1 WHEN s_suppkey % 3 = 0 THEN 2 WHEN s_suppkey % 2 = 0 THEN 3 ELSE 4 END AS p FROM supplier)
SELECT s_suppkey, p::BIGINT AS priority, row_number() OVER (PARTITION BY s_nationkey ORDER BY p, length(route), route) AS place FROM r"""),
    "token_requests": (token_requests, """WITH u AS (SELECT l_orderkey * 8 + l_linenumber AS seq, (['AIR', 'RAIL', 'SHIP', 'MAIL'])[l_suppkey % 4 + 1] AS mode, * FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT l_partkey AS resource_id, arg_min(l_linestatus, seq) FILTER (l_quantity > 20) AS name, arg_min(l_orderkey::VARCHAR, seq) FILTER (l_quantity > 30) AS artifact_id,
  coalesce(string_agg(DISTINCT mode, ',' ORDER BY mode) FILTER (l_discount > 0.02), '') AS sets, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS routes FROM u GROUP BY 1"""),
    "token_table_nodes": (token_table_nodes, """WITH t AS (SELECT p_partkey % 5 AS resource_id, string_split(p_type, ' ')[1] AS set, p_type || '/' || p_partkey AS token, p_partkey % 3 <> 0 AS active, p_size > 10 AS resolved FROM part),
s AS (SELECT DISTINCT resource_id, set FROM t WHERE resource_id <= 1 OR set IN ('STANDARD', 'PROMO'))
SELECT s.resource_id, s.set, count(token) AS n, min(token) AS first, max(token) AS last, count(*) FILTER (NOT resolved) AS unresolved FROM s LEFT JOIN t ON t.resource_id = s.resource_id AND t.active AND starts_with(t.token, s.set) GROUP BY 1, 2"""),
    "token_contexts": (token_contexts, """WITH e AS (SELECT (['AIR', 'RAIL', 'SHIP', 'MAIL'])[l_suppkey % 4 + 1] AS set, l_partkey % 40 AS token, CASE WHEN l_quantity > 2 THEN least(l_returnflag, l_linestatus) || '|' || greatest(l_returnflag, l_linestatus) END AS key, l_quantity > 48 AND l_returnflag <> 'R' AS sel, l_discount > 0.05 AS fb FROM lineitem),
p AS (SELECT set, token, bool_or(sel) AS found, count(DISTINCT key) AS keys, bool_or(sel AND fb) AS fb FROM e GROUP BY ALL),
f AS (SELECT set, count(*) FILTER (NOT found) AS unresolved, bool_or(fb) AS used_fallback, bool_or(keys > 1) AS several FROM p GROUP BY 1),
k AS (SELECT set, key, bool_or(sel) AS sel FROM e WHERE key IS NOT NULL GROUP BY ALL)
SELECT f.*, coalesce(string_agg(key, ',' ORDER BY key), '') AS available, coalesce(string_agg(key, ',' ORDER BY key) FILTER (sel), '') AS selected, coalesce(string_agg(key, ',' ORDER BY key) FILTER (NOT sel), '') AS skipped FROM f LEFT JOIN k USING (set) GROUP BY ALL"""),
    "public_index": (public_index, """WITH p AS (SELECT page_id AS n, url, CASE WHEN page_id % 4 <> 0 THEN 'p' || page_id ELSE '' END AS path FROM pages)
SELECT path, CASE WHEN n % 3 <> 0 THEN 'T' || n ELSE path END AS title, CASE WHEN n % 2 = 0 THEN 'url' WHEN n % 5 <> 0 THEN url ELSE '' END AS source_url, CASE WHEN n % 6 = 0 THEN 's' ELSE '' END AS section,
  CASE WHEN n % 7 = 0 THEN 'h1,h2' ELSE '' END AS headings, CASE WHEN n % 8 = 0 THEN '2024' ELSE 'now' END AS captured_at FROM p"""),
    "carbon_pages": (carbon_pages, r"""WITH h AS (SELECT page_id, unnest(l) AS t, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS l FROM pages)),
a AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Title ' || page_id ELSE page_id::VARCHAR END AS t, -3 AS i FROM pages UNION ALL SELECT page_id, 'Main', -2 FROM pages UNION ALL SELECT page_id, 'Block', -1 FROM pages
  UNION ALL SELECT page_id, trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), i FROM h UNION ALL SELECT page_id, 'More', 1000000 FROM pages),
d AS (SELECT page_id, t, min(i) AS i FROM a WHERE t <> '' GROUP BY ALL), g AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS headings FROM d GROUP BY 1)
SELECT '/p/' || page_id AS route, CASE WHEN page_id % 2 = 0 THEN 'id' || page_id ELSE '/p/' || page_id END AS page_id, headings, '/p/' || page_id || ':section-0,s9' AS sections, 6::BIGINT AS chunks, 2::BIGINT AS texts, 2::BIGINT AS unsupported, 'image:' || url AS resources FROM pages JOIN g USING (page_id)"""),
    "stable_json": (stable_json, """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN '{"B":{"y":false,"z":true},"a":[{"c":null,"d":' || event_id || '},[]],"b":"' || event_type || '"}' END AS json FROM events"""),
    "deep_first": (deep_first, "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id::VARCHAR WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'top' ELSE event_type END AS found FROM events"),
    "public_docs_classes": (public_docs_classes, rf"""WITH r AS (SELECT c_custkey AS n, ['/components', '/components/x', '/styles/y.png', '/go/z', '/develop/web/a', '/develop/b', '/news/c', '/about'][c_custkey % 8 + 1] AS route, c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AS plain,
  c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AS unseen, c_custkey % 2 <> 0 OR c_custkey % 3 <> 0 AS missing FROM customer)
SELECT n AS c_custkey, CASE WHEN n % 17 = 0 THEN 'redirect' WHEN starts_with(route, '/go/') THEN 'go-link' WHEN route LIKE '%.png' THEN 'asset' WHEN plain AND route IN ({_LIST(classify.SECTIONS)}) THEN 'non-content-index'
  WHEN {_STARTS(classify.UNSUPPORTED)} THEN 'unsupported-platform-or-policy' WHEN NOT (route IN ({_LIST(classify.SECTIONS)}) OR {_STARTS([f'{s}/' for s in classify.SECTIONS])} OR starts_with(route, '/develop/') OR {_STARTS(classify.NEWS)}) THEN 'outside-public-docs'
  WHEN unseen AND missing THEN 'missing-extraction-metadata' WHEN plain AND n % 2 <> 0 AND missing THEN 'missing-extraction-metadata' ELSE 'public-docs' END AS kind FROM r"""),
    "promotion_checks": (promotion_checks, """WITH f AS (SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT page_id) FROM pages) AS listed, (SELECT count(*) FROM orders) AS planned, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS failed,
  (SELECT count(*) FROM customer) AS found, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS old, (SELECT count(*) FROM supplier) AS tried, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS broken,
  (SELECT count(*) FROM (SELECT html FROM pages GROUP BY html HAVING count(*) > 1)) AS groups, (SELECT count(*) FROM orders WHERE o_totalprice < 0) AS missing)
SELECT unnest(range(19)) AS place, unnest(['enough-pages', 'page-count-matches', 'no-direct-json-failure', 'planned-accounted', 'few-unattempted', 'bundle-saved', 'no-blog', 'token-tables-rendered', 'no-duplicate-content', 'no-suspicious-pages', 'no-unexplained-gap', 'source-failures', 'virtual-failures', 'legacy-failures', 'discovered-kept', 'pages-kept', 'samples-saved', 'routes-covered', 'no-ambiguity']) AS name,
  unnest([pages >= 10, pages = listed, true, true, found - old < greatest(5, ceil(0.2 * found)), true, false, false, groups = 0, true, true, NOT (tried >= 10 AND broken / tried > 0.2), NOT (planned >= 10 AND failed / planned > 0.2), true, old >= ceil(0.8 * found), true, missing = 0, broken = 0, true]) AS passed FROM f"""),
    "text_helpers": (text_helpers, r"""WITH p AS (SELECT *, 'https://i/x' || CASE page_id % 3 WHEN 0 THEN '=w' || (page_id % 1200) WHEN 1 THEN '=s0' ELSE '=h20' END AS i, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+', ''), '^/+', '') AS path FROM pages)
SELECT page_id, regexp_replace(path, '/+$', '') AS promotion, regexp_replace(regexp_replace(lower(' The ' || url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS kebab, regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g') AS segment,
  CASE WHEN page_id % 3 = 1 OR (page_id % 3 = 0 AND page_id % 1200 < 800) THEN 'https://i/x=w1600' ELSE i END AS image, 'a\|b\\ ' || url AS cell, 'designSystems_a_components_c' || page_id AS resource FROM p"""),
    "token_value_shapes": (token_value_shapes, """SELECT p_partkey, [ '#ff0080', 'rgba(0, 51, 0, 0.26)', p_size || 'dp', '0percent', 'ROUND ' || p_size || '.5sp 1dp, 0dp', 'A, B ' || p_size || ' 20sp', '{"tag":"wght","value":' || p_size || '}', p_size || 'sp, 3', NULL, NULL, NULL][p_partkey % 11 + 1] AS shown FROM part"""),
    "status_tables": (status_tables, """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'A,B' WHEN 1 THEN 'Platform,Status' END AS headers, CASE s_suppkey % 3 WHEN 0 THEN s_name || '=2' WHEN 1 THEN '[W](u/' || s_suppkey || ')=Done;' || s_name || '=In progress' END AS rows FROM supplier"""),
}

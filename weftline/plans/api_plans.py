"""Queries that publish a snapshot made of star-schema tables and ask the named queries of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshot
from ..sources.tables import Written, table
from . import api

_N = "cast(array() as array<string>)"
#: Select expressions of each snapshot table over a star-schema table.
MADE = {
    "routes": ("customer", f"""c_custkey AS seq, '/components/c' || c_custkey AS route, if(c_custkey % 4 = 0, '/components/c' || (c_custkey + 1000000), null) AS canonical, array('/old/' || c_custkey) AS aliases, if(c_nationkey % 2 = 0, 'components', 'styles') AS section,
  element_at(array('covered', 'partial', 'failed'), int(c_custkey % 3) + 1) AS status, {_N} AS reasons, array('a', 'b') AS expected, if(c_custkey % 2 = 0, array('a'), array('b', 'a')) AS saved, {_N} AS failed, {_N} AS skipped,
  array('k:' || (c_custkey % 9 + 1), 'k:' || (c_custkey % 5 + 1)) AS artifacts, if(c_custkey % 5 = 0, array('specs'), {_N}) AS tabs, array('/components/c' || (c_custkey + 1), '/gone') AS shared_with"""),
    "pages": ("supplier", f"""s_suppkey AS seq, 'p' || s_suppkey AS page_id, '/components/c' || s_suppkey AS route, s_name AS title, 'https://s/components/c' || s_suppkey AS url, 'components' AS section, 'components/c' || (s_suppkey % 6) || '/page-' || s_suppkey || '.md' AS path,
  array(s_name, 'Usage') AS headings, if(s_suppkey % 3 = 0, null, 'Body of ' || s_name) AS markdown, array('r' || s_suppkey) AS resource_ids, {_N} AS section_ids"""),
    "resources": ("part", f"""p_partkey AS seq, 'r' || p_partkey AS resource_id, 'image' AS kind, p_name AS name, 'resolved' AS status, array('/components/c' || (p_partkey % 30)) AS routes, {_N} AS page_ids, if(p_partkey % 2 = 0, 'k:1', null) AS artifact_id, if(p_partkey % 5 = 0, 'odd', null) AS reason"""),
    "artifacts": ("supplier", "s_suppkey AS seq, 'k:' || s_suppkey AS id, 'k' AS kind, 'f' || s_suppkey AS local_path, '/components/c' || s_suppkey AS source_route, sha2(s_name, 256) AS sha256, bigint(length(s_name)) AS bytes, repeat(s_name, 200) AS text"),
    "sections": ("supplier", """s_suppkey AS seq, 's' || s_suppkey AS section_id, 'p' || s_suppkey AS page_id, 'Notes on ' || s_name AS title,
  array(named_struct('chunk_id', 'a', 'kind', 'text', 'text', 'Chunk of ' || s_name), named_struct('chunk_id', 'b', 'kind', 'image', 'text', cast(null as string))) AS chunks"""),
    "token_tables": ("supplier", """s_suppkey AS seq, 't' || s_suppkey AS resource_id, s_name AS name, array('/components/c' || s_suppkey) AS routes,
  array(named_struct('name', 'set ' || s_name, 'tokens', array(named_struct('name', 'tok ' || s_name, 'value', 'v' || s_suppkey, 'resolved', true, 'reason', cast(null as string)), named_struct('name', 'gap', 'value', cast(null as string), 'resolved', false, 'reason', 'upstream-empty')))) AS sets"""),
    "diagnostics": ("customer", "c_custkey AS seq, '/components/c' || c_custkey AS route, 'c' || c_custkey || '.md' AS path, element_at(array('saved', 'failed', 'skipped'), int(c_custkey % 3) + 1) AS status, 'x' AS reason"),
}
#: The routes and search words that are asked for.
ASKED, WORDS = "/components/c7", "supplier 000000007"


#: Snapshots that are there already, by session and data.
_published: dict[tuple[str, str], api.Snapshot] = {}


def published(spark: SparkSession, sf_dir: str) -> api.Snapshot:
    """A snapshot of all these tables, published through the gate, once for a session and its data."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _published or snapshot.current(spark, _published[key].root) is None:
        s = api.Snapshot(spark, Written(spark, "snapshot").folder)
        made = {name: table(spark, sf_dir, source).selectExpr(*_split(columns)) for name, (source, columns) in MADE.items()}
        api.refresh_docs(s, made, "v1", snapshot.Facts(page_count=10, listed_pages=10))
        _published[key] = s
    return _published[key]


def _split(columns: str) -> list[str]:
    """Select expressions at the commas that are in no parentheses."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _over(*_names: str) -> Callable[[Callable[[api.Snapshot], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def query(ask: Callable[[api.Snapshot], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: ask(published(spark, sf_dir))

    return query


joined = lambda c, sep=",": F.array_join(c, sep).alias(c)
api_list_routes = _over("routes", "pages")(lambda s: api.list_routes(s, section="components", status="covered", limit=50))
api_get_route = _over("routes")(lambda s: api.get_route(s, "components/c7/").union(api.get_route(s, "/old/33")).union(api.get_route(s, "/components/c1000008")).union(api.get_route(s, "/nope")).select("seq", "route", "status", joined("artifacts")))
api_get_page = _over("routes", "pages")(lambda s: api.get_page(s, ASKED).select("page_id", "route", "title", joined("headings"), joined("resource_ids")))
api_page_markdown = _over("routes", "pages")(lambda s: api.get_page(s, ASKED, "markdown", 9).select("page_id", "markdown"))
api_docs_page = _over("pages")(lambda s: api.get_docs_page(s, "https://s/components/c4/page-4").select("page_id", "title"))
api_component_docs = _over("pages")(lambda s: api.get_component_docs(s, "c1", include_markdown=True, max_chars=12).select("path", "title", joined("headings"), "markdown"))
api_list_components = _over("pages")(lambda s: api.list_components(s))
api_component_resources = _over("resources")(lambda s: api.get_component_resources(s, "C7").select("seq", "resource_id", "name"))
api_component_tabs = _over("routes")(lambda s: api.get_component_tabs(s, "c5").select("route", joined("tabs")))
api_route_artifacts = _over("routes", "artifacts")(lambda s: api.get_route_artifacts(s, ASKED).select("id", "local_path", "sha256"))
api_raw_artifact = _over("artifacts")(lambda s: api.get_raw_artifact(s, "k:3").select("id", "bytes", "text").union(api.get_raw_artifact(s, "k:2", full=True).select("id", "bytes", "text")))
api_cache_diagnostics = _over("diagnostics")(lambda s: api.docs_cache_diagnostics(s, failed=True, limit=40).union(api.docs_cache_diagnostics(s, path="c7.md")))
api_coverage = _over("routes")(lambda s: api.explain_route_coverage(s, ASKED).select("route", "status", "told", joined("missing"), F.array_join(F.transform("members", lambda m: F.concat(m["member"], F.lit("="), m["status"])), ",").alias("members")))
api_resource = _over("resources")(lambda s: api.explain_resource_resolution(s, "r10").union(api.explain_resource_resolution(s, "r11")).select("resource_id", "told", joined("routes")))
api_structured_search = _over("routes", "pages", "sections", "token_tables", "resources")(lambda s: api.search_structured_docs(s, WORDS).union(api.search_structured_docs(s, "old 77", 100)).union(api.search_structured_docs(s, "r77")))
api_component_overview = _over("routes", "resources", "token_tables")(lambda s: api.get_component_overview(s, "C5").select("resources", "image", "token_table", "token_tables", F.col("tokens").cast("long").alias("tokens"), joined("routes"), joined("tabs"), joined("recommended")))
api_component_tokens = _over("token_tables")(lambda s: api.get_component_tokens(s, " c7 ").select("resource_id", "name", F.explode("sets").alias("x")).select("resource_id", "name", F.col("x.name").alias("set"), F.explode("x.tokens").alias("t")).select("resource_id", "name", "set", F.col("t.name").alias("token"), "t.value", "t.resolved", "t.reason"))

QUERIES = {
    "api_list_routes": (api_list_routes, """WITH r AS (SELECT * FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 3 = 0) SELECT c_custkey AS seq, '/components/c' || c_custkey AS route, 'components' AS section, 'covered' AS status,
  EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) AS has_page, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_suppkey % 3 <> 0) AS has_markdown, (SELECT count(*) FROM r) AS total_matched, (SELECT count(*) FROM r) > 50 AS truncated FROM r ORDER BY c_custkey LIMIT 50"""),
    "api_get_route": (api_get_route, "SELECT c_custkey AS seq, '/components/c' || c_custkey AS route, ['covered', 'partial', 'failed'][c_custkey % 3 + 1] AS status, 'k:' || (c_custkey % 9 + 1) || ',k:' || (c_custkey % 5 + 1) AS artifacts FROM customer WHERE c_custkey IN (7, 33, 8)"),
    "api_get_page": (api_get_page, "SELECT 'p7' AS page_id, '/components/c7' AS route, s_name AS title, s_name || ',Usage' AS headings, 'r7' AS resource_ids FROM supplier WHERE s_suppkey = 7"),
    "api_page_markdown": (api_page_markdown, "SELECT 'p7' AS page_id, substr('Body of ' || s_name, 1, 9) AS markdown FROM supplier WHERE s_suppkey = 7"),
    "api_docs_page": (api_docs_page, "SELECT 'p4' AS page_id, s_name AS title FROM supplier WHERE s_suppkey = 4"),
    "api_component_docs": (api_component_docs, "SELECT 'components/c1/page-' || s_suppkey || '.md' AS path, s_name AS title, s_name || ',Usage' AS headings, CASE WHEN s_suppkey % 3 <> 0 THEN substr('Body of ' || s_name, 1, 12) END AS markdown FROM supplier WHERE s_suppkey % 6 = 1 ORDER BY s_suppkey LIMIT 10"),
    "api_list_components": (api_list_components, "SELECT 'c' || (s_suppkey % 6) AS component, 'components' AS section, 'components/c' || (s_suppkey % 6) || '/page-' || s_suppkey || '.md' AS path FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 6 ORDER BY s_suppkey) = 1"),
    "api_component_resources": (api_component_resources, "SELECT p_partkey AS seq, 'r' || p_partkey AS resource_id, p_name AS name FROM part WHERE p_partkey % 30 = 7"),
    "api_component_tabs": (api_component_tabs, "SELECT '/components/c' || c_custkey AS route, 'specs' AS tabs FROM customer WHERE c_custkey = 5"),
    "api_route_artifacts": (api_route_artifacts, "SELECT 'k:' || s_suppkey AS id, 'f' || s_suppkey AS local_path, sha256(s_name) AS sha256 FROM supplier WHERE s_suppkey IN (8, 3)"),
    "api_raw_artifact": (api_raw_artifact, "SELECT 'k:' || s_suppkey AS id, length(s_name) AS bytes, CASE WHEN s_suppkey = 2 THEN repeat(s_name, 200) ELSE substr(repeat(s_name, 200), 1, 2000) END AS text FROM supplier WHERE s_suppkey IN (2, 3)"),
    "api_cache_diagnostics": (api_cache_diagnostics, """SELECT c_custkey AS seq, '/components/c' || c_custkey AS route, 'c' || c_custkey || '.md' AS path, ['saved', 'failed', 'skipped'][c_custkey % 3 + 1] AS status, 'x' AS reason
  FROM (SELECT c_custkey FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 1 ORDER BY 1 LIMIT 40) UNION ALL SELECT 7)"""),
    "api_coverage": (api_coverage, """SELECT '/components/c' || a.c_custkey AS route, ['covered', 'partial', 'failed'][a.c_custkey % 3 + 1] AS status, 'some expected pages are missing' AS told, '' AS missing,
  '/components/c' || b.c_custkey || '=' || ['covered', 'partial', 'failed'][b.c_custkey % 3 + 1] || ',/gone=' || ['covered', 'partial', 'failed'][a.c_custkey % 3 + 1] AS members FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey = 7"""),
    "api_resource": (api_resource, "SELECT 'r' || p_partkey AS resource_id, CASE WHEN p_partkey % 5 = 0 THEN 'odd' WHEN p_partkey % 2 = 0 THEN 'decoded' ELSE 'no artifact' END AS told, '/components/c' || (p_partkey % 30) AS routes FROM part WHERE p_partkey IN (10, 11)"),
    "api_structured_search": (api_structured_search, """WITH s AS (SELECT s_name AS n, '/components/c' || s_suppkey AS route FROM supplier WHERE s_suppkey = 7)
SELECT 'page' AS kind, n || ' ' || n || ' Usage' AS label, route FROM s UNION ALL SELECT 'section', n || ' Notes on ' || n, route FROM s UNION ALL SELECT 'chunk', 'Chunk of ' || n, route FROM s
UNION ALL SELECT 'token-set', 'set ' || n, route FROM s UNION ALL SELECT 'token', 'tok ' || n || ' v7', route FROM s
UNION ALL (SELECT kind, label, route FROM (SELECT 0 AS o, c_custkey AS k, 'route' AS kind, '/components/c' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN ' /components/c' || (c_custkey + 1000000) ELSE '' END || ' /old/' || c_custkey AS label, '/components/c' || c_custkey AS route FROM customer WHERE contains(c_custkey::VARCHAR, '77')
  UNION ALL SELECT 3, p_partkey, 'resource', 'r' || p_partkey || ' ' || p_name, '/components/c' || (p_partkey % 30) FROM part WHERE contains(p_partkey::VARCHAR || p_name, '77') AND contains(lower(p_name), 'old')) ORDER BY o, k LIMIT 100)
UNION ALL (SELECT 'resource', 'r' || p_partkey || ' ' || p_name, '/components/c' || (p_partkey % 30) FROM part WHERE starts_with(p_partkey::VARCHAR, '77') ORDER BY p_partkey LIMIT 20)"""),
    "api_component_overview": (api_component_overview, """SELECT (SELECT count(*) FROM part WHERE p_partkey % 30 = 5) AS resources, (SELECT count(*) FROM part WHERE p_partkey % 30 = 5) AS image, 0 AS token_table, count(*) AS token_tables, 2 * count(*) AS tokens,
  (SELECT string_agg('/components/c' || c_custkey, ',') FROM customer WHERE c_custkey = 5) AS routes, (SELECT string_agg('specs', ',') FROM customer WHERE c_custkey = 5) AS tabs, (SELECT string_agg('/components/c' || c_custkey, ',') FROM customer WHERE c_custkey = 5) AS recommended FROM supplier WHERE s_suppkey = 5"""),
    "api_component_tokens": (api_component_tokens, """SELECT 't' || s_suppkey AS resource_id, s_name AS name, 'set ' || s_name AS "set", unnest(['tok ' || s_name, 'gap']) AS token, unnest(['v' || s_suppkey, NULL]) AS value, unnest([true, false]) AS resolved, unnest([NULL, 'upstream-empty']) AS reason FROM supplier WHERE s_suppkey = 7"""),
}

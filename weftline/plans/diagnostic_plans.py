"""Queries for page, section and resource graphs from diagnostics: orders as pages and notes, customers and suppliers as routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics
from ..sources.tables import table


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _path(key: str) -> Column:
    return F.concat(F.lit("pages/p"), _text(key), F.lit(".md"))


def _some(n: Column, item) -> Column:
    """item(i) for i from 1 to n."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n), item)).otherwise(F.transform(F.array().cast("array<bigint>"), item))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page_id"), _path("o_custkey").alias("path"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("section"),
        F.when(F.col("o_orderkey") % 8 != 0, F.split("o_orderpriority", "-")).alias("headings"),
    )


def _page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = lambda i: F.when((k + i) % 3 != 0, F.concat(F.lit("designSystems/d"), _text((k + i) % 7), F.lit("/components/c"), _text(k * i % 50)))
    texts = lambda cond, *items: F.when(cond, F.array(*map(F.lit, items))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").where(k % 9 != 0).select(
        _path("o_custkey").alias("path"), k.alias("seq"),
        _some(k % 4, lambda i: F.struct(name(i).alias("name"))).alias("token_tables"),
        texts(k % 5 == 0, "fetch failed", "no schema").alias("placeholders"),
        _some(k % 3, lambda i: F.struct(F.when((k + i) % 2 == 0, F.concat(F.lit("tables/s"), _text(k * i % 40))).alias("name"), (k % 4 == 0).alias("rendered"), F.when(k % 5 != 0, i == 2).alias("unsupported"))).alias("status_tables"),
        (k % 4).alias("images"), (k % 2).alias("videos"), texts(k % 6 == 0, "CAROUSEL", "EMBED").alias("unknown_chunks"), texts(k % 7 == 0, "GRID").alias("unknown_resources"),
    )


def _route_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    area = F.concat(F.lit("/components/x"), _text("c_nationkey"))
    first = table(spark, sf_dir, "customer").select(
        _path("c_custkey").alias("path"), c.alias("seq"), F.when(c % 3 != 0, F.concat(area, F.lit("/"))).alias("source_route"), F.when(c % 2 == 0, F.concat(F.lit("pages/y"), _text(c % 9), F.lit(".md"))).alias("normalized_route"),
        F.when(c % 5 == 0, F.concat(area, F.lit("/specs/"))).alias("virtual_route"), F.when(c % 7 == 0, "").when(c % 7 == 1, area).alias("canonical_route"), F.when(c % 5 == 0, "Specs").when(c % 11 == 0, "").alias("tab"), (c % 4).alias("tab_section"),
    )
    none = F.lit(None).cast("string")
    later = table(spark, sf_dir, "supplier").select(
        _path(s * 3).alias("path"), (s + 1_000_000_000).alias("seq"), none.alias("source_route"), F.concat(F.lit("/later//"), _text(s), F.lit("/")).alias("normalized_route"), none.alias("virtual_route"), none.alias("canonical_route"),
        F.lit("Later").alias("tab"), F.lit(None).cast("long").alias("tab_section"),
    )
    return first.union(later)


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("dsdb-resource", "page-data", "other", "dsdb-resource", "network-capture")))
    file = F.when(p % 2 == 0, F.concat(F.lit("raw/designSystems_d"), _text(p % 7), F.lit("_components_c"), _text(p % 50), F.lit(".json"))).otherwise(F.concat(F.lit("raw/s"), _text(p % 40), F.lit(".JSON")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("a"), _text(p)).alias("id"), F.element_at(kinds, (p % 5 + 1).cast("int")).alias("kind"), p.alias("seq"), F.when(p % 4 != 0, F.concat(F.lit("/components/x"), _text(p % 25))).alias("source_route"), file.alias("local_path"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.page_graph(_pages(spark, sf_dir), _page_notes(spark, sf_dir), _route_notes(spark, sf_dir))


def diagnostic_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnostics.chunk_rows(_graph(spark, sf_dir))
    return rows.withColumn("place", F.col("place").cast("long"))


def diagnostic_page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.array_join(c, ",").alias(c)
    return _graph(spark, sf_dir).select(
        "page_id", "route", "title", "section", F.col("tab.label").alias("tab"), F.col("tab.route").alias("tab_route"), F.col("tab.section_index").alias("tab_section"), listed("headings"),
        F.size("sections").cast("long").alias("n_sections"), listed("resource_ids"), listed("token_table_ids"), listed("unsupported"), "source_route", "canonical_route", "virtual_route",
    )


def diagnostic_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnostics.section_graph(_graph(spark, sf_dir))
    return rows.withColumn("chunk_ids", F.array_join("chunk_ids", ",")).withColumn("heading_level", F.col("heading_level").cast("long"))


def diagnostic_page_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many artifacts of each kind a page was made of, and the first of them."""
    pages = diagnostics.routed_pages(_pages(spark, sf_dir), _route_notes(spark, sf_dir))
    return diagnostics.page_artifact_counts(pages, _artifacts(spark, sf_dir))


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.resource_uses(_page_notes(spark, sf_dir), _route_notes(spark, sf_dir))


def diagnostic_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnostics.resource_graph(_uses(spark, sf_dir), _artifacts(spark, sf_dir))
    return rows.select("resource_id", "kind", "name", "status", "reason", "artifact_id", "routes", "chunks", F.col("first.seq").alias("first_seq"), F.col("first.generator").cast("long").alias("generator"), F.col("first.place").cast("long").alias("place"))


def diagnostic_resource_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnostics.resource_members(_uses(spark, sf_dir))
    return rows.select("resource_id", "member", "value", F.col("first.seq").alias("first_seq"), F.col("first.place").cast("long").alias("place"))


_BASE = """
pg AS (SELECT o_orderkey AS page_id, 'pages/p' || o_custkey || '.md' AS path, o_orderpriority AS title, o_orderstatus AS section,
  CASE WHEN o_orderkey % 8 <> 0 THEN string_split(o_orderpriority, '-') ELSE [] END AS heads FROM orders),
notes AS (SELECT 'pages/p' || o_custkey || '.md' AS path, o_orderkey AS k FROM orders WHERE o_orderkey % 9 <> 0),
cust AS (SELECT 'pages/p' || c_custkey || '.md' AS path, c_custkey AS seq, CASE WHEN c_custkey % 3 <> 0 THEN '/components/x' || c_nationkey END AS src,
    CASE WHEN c_custkey % 2 = 0 THEN '/y' || (c_custkey % 9) END AS norm, CASE WHEN c_custkey % 5 = 0 THEN '/components/x' || c_nationkey || '/specs' END AS virt,
    CASE WHEN c_custkey % 7 = 1 THEN '/components/x' || c_nationkey END AS canon, CASE WHEN c_custkey % 5 = 0 THEN 'Specs' END AS tab, c_custkey % 4 AS tab_section, CASE WHEN c_custkey % 7 = 0 THEN '' END AS blank FROM customer
  UNION ALL SELECT 'pages/p' || (s_suppkey * 3) || '.md', s_suppkey + 1000000000, NULL, '/later/' || s_suppkey, NULL, NULL, 'Later', NULL, NULL FROM supplier),
routes AS (SELECT * FROM cust QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1),
made AS (
  SELECT path, k, 0 AS g, i - 1 AS i, CASE WHEN (k + i) % 3 <> 0 THEN 'designSystems/d' || ((k + i) % 7) || '/components/c' || (k * i % 50) END AS name, NULL AS bad FROM notes, unnest(range(1, k % 4 + 1)) AS t(i)
  UNION ALL SELECT path, k, 1, i, NULL, ['fetch failed', 'no schema'][i + 1] FROM notes, unnest([0, 1]) AS t(i) WHERE k % 5 = 0
  UNION ALL SELECT path, k, 2, i - 1, CASE WHEN (k + i) % 2 = 0 THEN 'tables/s' || (k * i % 40) END,
    CASE WHEN k % 4 = 0 THEN NULL WHEN k % 5 <> 0 AND i = 2 THEN 'unsupported-status-table-schema' ELSE 'missing-status-table-resource' END FROM notes, unnest(range(1, k % 3 + 1)) AS t(i)
  UNION ALL SELECT path, k, 3, i, NULL, NULL FROM notes, unnest(range(0, k % 4)) AS t(i)
  UNION ALL SELECT path, k, 4, i, NULL, NULL FROM notes, unnest(range(0, k % 2)) AS t(i)
), named AS (
  SELECT *, CASE g WHEN 0 THEN 'token-table:' || coalesce(name, path || ':' || i) WHEN 1 THEN 'token-table:' || path || ':placeholder:' || i
    WHEN 2 THEN 'status-table:' || coalesce(name, path || ':' || i) WHEN 3 THEN 'image:' || path || ':' || i ELSE 'video:' || path || ':' || i END AS rid,
    'chunk-' || ['token-table', 'token-table-placeholder', 'status-table', 'image', 'video'][g + 1] || '-' || i AS cid FROM made
), lastnote AS (SELECT path, max(k) AS k FROM notes GROUP BY path),
node AS (
  SELECT page_id, path, title, section, heads, k, src, canon, virt, tab, tab_section, coalesce(src, norm, replace(replace(path, 'pages/', '/'), '.md', '')) AS fetched
  FROM pg LEFT JOIN lastnote USING (path) LEFT JOIN routes USING (path)
), chunk AS (
  SELECT page_id, coalesce(virt, fetched) AS route, -1 AS g, i - 1 AS i, 'chunk-' || (i - 1) || '-text' AS chunk_id, 'text' AS chunk_type, NULL AS resource_id, heads[i] AS excerpt FROM node, unnest(range(1, len(heads) + 1)) AS t(i)
  UNION ALL SELECT page_id, coalesce(virt, fetched), g, i, cid, CASE WHEN g < 3 THEN 'resource' WHEN g = 3 THEN 'image' ELSE 'video' END, rid,
    CASE g WHEN 0 THEN coalesce(name, 'token table') WHEN 1 THEN 'token table (' || bad || ')' WHEN 2 THEN coalesce(name, 'status table') END FROM node JOIN named USING (path, k)
  UNION ALL SELECT page_id, coalesce(virt, fetched), 5, i, 'chunk-unsupported-' || i, 'unsupported', 'unknown-resource:' || path || ':' || i, ['CAROUSEL', 'EMBED'][i + 1] FROM node, unnest([0, 1]) AS t(i) WHERE k % 6 = 0
)"""
_USES = """, uses AS (
  SELECT n.path, k, g, i, rid, CASE g WHEN 0 THEN 'token-table' WHEN 1 THEN 'token-table' WHEN 2 THEN 'status-table' WHEN 3 THEN 'image' ELSE 'video' END AS kind, name, bad, cid FROM named n
  UNION ALL SELECT path, k, 5, 0, 'unknown-resource:' || path || ':0', 'unknown-resource', 'GRID', 'unknown-resource-type:GRID', 'chunk-unknown-resource-0' FROM notes WHERE k % 7 = 0
), routed AS (SELECT u.*, nullif(coalesce(virt, blank, canon, src, norm), '') AS route FROM uses u LEFT JOIN routes USING (path)),
member AS (
  SELECT rid, member, value, min((k, g, i)) AS first FROM (SELECT rid, k, g, i, 'route' AS member, route AS value FROM routed UNION ALL SELECT rid, k, g, i, 'chunk', cid FROM routed) WHERE value IS NOT NULL GROUP BY ALL
)"""

QUERIES = {
    "diagnostic_page_chunks": (diagnostic_page_chunks, f"WITH {_BASE} SELECT page_id, route, row_number() OVER (PARTITION BY page_id ORDER BY g, i) - 1 AS place, chunk_id, chunk_type, resource_id, excerpt FROM chunk"),
    "diagnostic_page_nodes": (diagnostic_page_nodes, f"""WITH {_BASE}, ids AS (SELECT page_id, rid, min((g, i)) AS met FROM (SELECT page_id, resource_id AS rid, g, i FROM chunk WHERE resource_id IS NOT NULL) GROUP BY ALL),
lists AS (SELECT page_id, string_agg(rid, ',' ORDER BY met) AS a, string_agg(rid, ',' ORDER BY met) FILTER (rid LIKE 'token-table:%') AS b FROM ids GROUP BY page_id)
SELECT page_id, coalesce(virt, fetched) AS route, title, section, tab, CASE WHEN tab IS NOT NULL THEN CASE WHEN virt IS NULL THEN fetched ELSE virt || '/' END END AS tab_route, CASE WHEN tab IS NOT NULL THEN tab_section END AS tab_section,
  array_to_string(heads, ',') AS headings, len(heads) AS n_sections, coalesce(a, '') AS resource_ids, coalesce(b, '') AS token_table_ids, CASE WHEN k % 6 = 0 THEN 'CAROUSEL,EMBED' ELSE '' END AS unsupported,
  src AS source_route, canon AS canonical_route, virt AS virtual_route FROM node LEFT JOIN lists USING (page_id)"""),
    "diagnostic_sections": (diagnostic_sections, f"""WITH {_BASE} SELECT page_id || ':section-' || (i - 1) AS section_id, page_id, coalesce(virt, fetched) AS route, heads[i] AS title, CASE WHEN i = 1 THEN 1 ELSE 2 END AS heading_level,
  'chunk-' || (i - 1) || '-text' AS chunk_ids FROM node, unnest(range(1, len(heads) + 1)) AS t(i)"""),
    "diagnostic_page_artifacts": (diagnostic_page_artifacts, f"""WITH {_BASE}, art AS (SELECT p_partkey AS p, ['dsdb-resource', 'page-data', 'other', 'dsdb-resource', 'network-capture'][p_partkey % 5 + 1] AS kind, '/components/x' || (p_partkey % 25) AS fetched FROM part WHERE p_partkey % 4 <> 0)
SELECT page_id, kind, count(*) AS artifacts, 'a' || min(p) AS first FROM node JOIN art USING (fetched) WHERE kind <> 'other' GROUP BY ALL"""),
    "diagnostic_resources": (diagnostic_resources, f"""WITH {_BASE}{_USES},
art AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 2 = 0 THEN 'designSystems_d' || (p_partkey % 7) || '_components_c' || (p_partkey % 50) ELSE 's' || (p_partkey % 40) END AS base FROM part WHERE p_partkey % 5 IN (0, 3)),
files AS (SELECT base, 'a' || min(p) AS artifact_id FROM art GROUP BY base),
said AS (SELECT * FROM routed QUALIFY row_number() OVER (PARTITION BY rid ORDER BY k, g, i) = 1),
n AS (SELECT rid, count(*) FILTER (member = 'route') AS routes, count(*) FILTER (member = 'chunk') AS chunks FROM member GROUP BY rid)
SELECT rid AS resource_id, kind, name, CASE WHEN bad IS NULL THEN 'resolved' ELSE 'unresolved' END AS status, bad AS reason, artifact_id, routes, chunks, k AS first_seq, g AS generator, i AS place
FROM said JOIN n USING (rid) LEFT JOIN files ON kind LIKE '%-table' AND base = regexp_replace(regexp_replace(name, '^designSystems/(.*)/components/(.*)$', 'designSystems_\\1_components_\\2'), '^.*/', '')"""),
    "diagnostic_resource_members": (diagnostic_resource_members, f"WITH {_BASE}{_USES} SELECT rid AS resource_id, member, value, first[1] AS first_seq, first[3] AS place FROM member"),
}

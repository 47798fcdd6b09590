"""Queries for tabs and their sections, captured resources, known slugs, table entries and page findings, over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, coverage, extract, routes
from ..sources.tables import table

_c = F.col


def _t(c: str):
    return F.col(c).cast("string")


def tab_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments as tabs of a nation's page, suppliers as its sections: by slug, by label, by place."""
    tabs = table(spark, sf_dir, "customer").where("c_custkey % 30 < 4").select(_c("c_nationkey").alias("page"), _c("c_custkey").alias("pos"), F.concat(F.lit("Part "), (_c("c_custkey") % 13).cast("string")).alias("label"), F.when(_c("c_custkey") % 4 == 1, F.concat(F.lit("S-"), (_c("c_custkey") % 7).cast("string"))).alias("slug"), F.when(_c("c_custkey") % 4 == 2, F.array(F.lit("none"), F.concat(F.lit("s "), (_c("c_custkey") % 11).cast("string")))).alias("alternates"))
    sections = table(spark, sf_dir, "supplier").select(_c("s_nationkey").alias("page"), _c("s_suppkey").alias("pos"), F.when(_c("s_suppkey") % 2 == 0, F.concat(F.lit("S "), (_c("s_suppkey") % 11).cast("string"))).otherwise(F.concat(F.lit("part_"), (_c("s_suppkey") % 13).cast("string"))).alias("name"))
    return extract.match_tabs(tabs, sections)


def captured_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as resources that orders' pages want, parts' names as what was captured for them."""
    kind = F.element_at(F.array(F.lit("TOKEN_TABLE"), F.lit("STATUS_TABLE"), F.lit("OTHER")), (_c("l_linenumber") % 3 + 1).cast("int"))
    wanted = table(spark, sf_dir, "lineitem").select((_c("l_orderkey") % 500).alias("page"), F.concat(F.lit(" a/b"), (_c("l_suppkey") % 40).cast("string"), F.lit(" ")).alias("resource"), kind.alias("type")).distinct()
    p = _c("p_partkey")
    name = F.when(p % 3 == 0, F.concat(F.lit("a/b"), (p % 40).cast("string"))).when(p % 3 == 1, F.concat(F.lit("long b"), (p % 40).cast("string"))).otherwise("x")
    responses = table(spark, sf_dir, "part").select((p % 500).alias("page"), p.alias("seq"), name.alias("name"), F.concat(F.lit("https://h/TOKEN_TABLE.b"), (p % 37).cast("string"), F.lit(".json")).alias("url"), F.element_at(F.array(*map(F.lit, ("token-table", "status-table", "dsdb-resource", "unknown-json-resource", "other"))), (p % 5 + 1).cast("int")).alias("type"))
    return extract.captured_resource(wanted, responses)


def captures_without_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captures, by address, path and last part; suppliers as artifacts."""
    o, s = _c("o_custkey"), _c("s_suppkey")
    own = table(spark, sf_dir, "orders").select(_c("o_orderkey").alias("id"), checks.url_keys(F.concat(F.lit("https://h/d/"), (o % 300).cast("string"), F.lit(".json?v=1")), F.when(o % 2 == 0, F.concat(F.lit("raw/"), (o % 70).cast("string"), F.lit(".json")))).alias("keys"))
    have = table(spark, sf_dir, "supplier").select(checks.url_keys(F.concat(F.lit("https://other/e/"), (s * 3).cast("string"), F.lit(".json")), F.lit(None).cast("string")).alias("keys"))
    return checks.not_captured(own, have).select("id")


def slug_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' routes of one to three parts that a supplier's slug covers, themselves or by their parent."""
    c, s = _c("c_custkey"), _c("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("/a"), (c % 40).cast("string"), F.when(c % 3 > 0, F.concat(F.lit("/b"), (c % 5).cast("string"))).otherwise("/"), F.when(c % 3 > 1, F.concat(F.lit("/"), c.cast("string"))).otherwise("")).alias("route"))
    slugs = table(spark, sf_dir, "supplier").select(F.when(_c("s_suppkey") % 2 == 0, F.concat(F.lit("a"), s)).otherwise(F.concat(F.lit("a"), s, F.lit("/b2"))).alias("slug"))
    return coverage.covered_by_slug(rows.distinct(), slugs)


def table_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route-table entries of several bundles by slug: fields that disagree are told."""
    rows = table(spark, sf_dir, "orders").select((_c("o_custkey") % 700).alias("slug"), F.when(_c("o_orderkey") % 4 == 0, _c("o_orderstatus")).alias("collection"), F.concat(F.lit("d"), (_c("o_custkey") % 1400).cast("string")).alias("document"))
    found = routes.merge_entries(rows, "slug", ["collection", "document"])
    return found.select("slug", "collection", "document", F.array_join("conflicts", ",").alias("conflicts"))


def plan_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routes.plan_summary(table(spark, sf_dir, "customer").select(_c("c_mktsegment").alias("class"), F.concat(F.lit("/c"), _t("c_custkey")).alias("route")), "class")
    return found.select("class", "n", F.array_join("examples", ",").alias("examples"))


def tab_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of tabs that have no route of their own, with what of the parent's pages is theirs."""
    c = _c("c_custkey")
    path = lambda n: F.concat(F.lit("c/"), n.cast("string"), F.lit(".md"))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("/c/"), c.cast("string")).alias("route"), F.array(F.concat(F.lit("/c/"), (c + 1).cast("string")), F.concat(F.lit("/c/"), (c * 1000).cast("string"))).alias("tab_routes"), F.array(path(c)).alias("expected"), F.when(c % 2 == 0, F.array(path(c), path(c * 1000))).otherwise(F.array(path(c))).alias("saved"), F.array(path(c + 1)).alias("failed"), F.array().cast("array<string>").alias("skipped"))
    return extract.virtual_tabs(rows).select("route", "parent", *(F.array_join(x, ",").alias(x) for x in ("expected", "saved", "failed", "skipped")))


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(_c("l_orderkey").alias("key"), (_c("l_linenumber") - 1).alias("pos"), F.concat(_c("l_returnflag"), _t("l_partkey")).alias("line"))
    return extract.paired_lines(rows, "key").select("key", _c("pair").cast("long").alias("pair"), "name", "value")


def module_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How parts are read as resource chunks, whether their payload is of the wanted route, and whether a missing body is no failure."""
    p = _c("p_partkey")
    word = lambda k, *words: F.element_at(F.array(*[F.lit(w) for w in words]), (p % k + 1).cast("int"))
    kind = extract.module_kind(word(3, None, None, "STATUS_TABLE"), word(4, None, "TYPOGRAPHY", None, "GRID"), word(2, None, "TOKEN_TABLE"))
    same = extract.identity_accepted(F.concat(F.lit("pages/c"), (p % 5).cast("string"), F.lit(".md")), F.array(F.lit("/c1"), F.lit("c2/")), F.when(p % 7 == 0, "AbC"), F.lit("aBc"))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), same.alias("accepted"))




QUERIES = {
    "tab_sections": (tab_sections, f"""WITH t AS (SELECT c_nationkey AS page, c_custkey AS pos, 'part-' || (c_custkey % 13) AS label, CASE c_custkey % 4 WHEN 1 THEN ['s-' || (c_custkey % 7)] WHEN 2 THEN ['none', 's-' || (c_custkey % 11)] ELSE [] END AS slugs FROM customer WHERE c_custkey % 30 < 4),
s AS (SELECT s_nationkey AS page, s_suppkey AS sec, CASE WHEN s_suppkey % 2 = 0 THEN 's-' || (s_suppkey % 11) ELSE 'part-' || (s_suppkey % 13) END AS key FROM supplier),
a AS (SELECT page, pos, min(sec) AS sec FROM t JOIN s USING (page) WHERE list_contains(slugs, key) GROUP BY ALL), b AS (SELECT page, pos, min(sec) AS sec FROM t JOIN s USING (page) WHERE label = key GROUP BY ALL),
e AS (SELECT page FROM (SELECT page, count(*) AS n FROM t GROUP BY page) JOIN (SELECT page, count(*) AS n FROM s GROUP BY page) USING (page, n))
SELECT page, pos, coalesce(a.sec, b.sec, CASE WHEN e.page IS NOT NULL THEN pos END) AS section, CASE WHEN a.sec IS NOT NULL THEN 'slug' WHEN b.sec IS NOT NULL THEN 'label' WHEN e.page IS NOT NULL THEN 'position' ELSE 'tab-section-mismatch' END AS matched_by
FROM t LEFT JOIN a USING (page, pos) LEFT JOIN b USING (page, pos) LEFT JOIN e USING (page)"""),
    "captured_resources": (captured_resources, """WITH w AS (SELECT DISTINCT l_orderkey % 500 AS page, ' a/b' || (l_suppkey % 40) || ' ' AS resource, ['TOKEN_TABLE', 'STATUS_TABLE', 'OTHER'][l_linenumber % 3 + 1] AS type, 'b' || (l_suppkey % 40) AS last FROM lineitem),
r AS (SELECT p_partkey % 500 AS page, p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'a/b' || (p_partkey % 40) WHEN 1 THEN 'long b' || (p_partkey % 40) ELSE 'x' END AS name, 'https://h/TOKEN_TABLE.b' || (p_partkey % 37) || '.json' AS url, p_partkey % 5 AS k FROM part),
m AS (SELECT w.*, seq, url, CASE WHEN name = trim(resource) THEN 1 WHEN contains(name, last) THEN 2 WHEN type = 'TOKEN_TABLE' AND contains(url, 'TOKEN_TABLE.' || last || '.json') OR type = 'STATUS_TABLE' AND contains(url, last) THEN 3 END AS rule
  FROM w JOIN r USING (page) WHERE CASE type WHEN 'TOKEN_TABLE' THEN k = 0 WHEN 'STATUS_TABLE' THEN k = 1 ELSE k IN (2, 3) END)
SELECT page, resource, type, rule, seq, url FROM m WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page, resource, type ORDER BY rule, seq) = 1"""),
    "captures_without_artifact": (captures_without_artifact, """WITH a AS (SELECT s_suppkey * 3 AS n FROM supplier) SELECT o_orderkey AS id FROM orders WHERE o_custkey % 300 NOT IN (SELECT n FROM a) AND NOT (o_custkey % 2 = 0 AND o_custkey % 70 IN (SELECT n FROM a))"""),
    "slug_coverage": (slug_coverage, """WITH r AS (SELECT DISTINCT '/a' || (c_custkey % 40) || CASE WHEN c_custkey % 3 > 0 THEN '/b' || (c_custkey % 5) ELSE '/' END || CASE WHEN c_custkey % 3 > 1 THEN '/' || c_custkey ELSE '' END AS route FROM customer),
s AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'a' || s_suppkey ELSE 'a' || s_suppkey || '/b2' END AS slug FROM supplier), b AS (SELECT route, trim(route, '/') AS bare FROM r)
SELECT route FROM b WHERE bare IN (SELECT slug FROM s) OR contains(bare, '/') AND regexp_replace(bare, '/[^/]*$', '') IN (SELECT slug FROM s)"""),
    "table_conflicts": (table_conflicts, """WITH e AS (SELECT o_custkey % 700 AS slug, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS c, 'd' || (o_custkey % 1400) AS d FROM orders)
SELECT slug, max(c) AS collection, max(d) AS document, array_to_string(list_filter([CASE WHEN count(DISTINCT c) > 1 THEN 'collection' END, CASE WHEN count(DISTINCT d) > 1 THEN 'document' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM e GROUP BY slug"""),
    "plan_examples": (plan_examples, """SELECT c_mktsegment AS class, count(*) AS n, array_to_string(list_sort(list('/c' || c_custkey))[1:5], ',') AS examples FROM customer GROUP BY 1"""),
    "tab_routes": (tab_routes, """WITH t AS (SELECT c_custkey AS c, unnest([c_custkey + 1, c_custkey * 1000]) AS n FROM customer)
SELECT '/c/' || n AS route, '/c/' || c AS parent, 'c/' || n || '.md' AS expected, CASE WHEN c % 2 = 0 AND n = c * 1000 THEN 'c/' || n || '.md' ELSE '' END AS saved, CASE WHEN n = c + 1 THEN 'c/' || n || '.md' ELSE '' END AS failed, '' AS skipped FROM t WHERE n NOT IN (SELECT c_custkey FROM customer)"""),
    "line_pairs": (line_pairs, """SELECT l_orderkey AS key, (l_linenumber - 1) // 2 AS pair, max(l_returnflag || l_partkey) FILTER (l_linenumber % 2 = 1) AS name, max(l_returnflag || l_partkey) FILTER (l_linenumber % 2 = 0) AS value FROM lineitem GROUP BY ALL"""),
    "module_kinds": (module_kinds, """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'status-table' WHEN p_partkey % 4 = 1 THEN 'token-table' WHEN p_partkey % 4 = 3 THEN 'placeholder' WHEN p_partkey % 2 = 1 THEN 'token-table' ELSE 'placeholder' END AS kind,
  p_partkey % 5 IN (1, 2) OR p_partkey % 7 = 0 AS accepted FROM part"""),
}

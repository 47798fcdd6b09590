"""Queries for acceptance, artifact and fallback joins, planned outputs and validation, over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, graph, validation, versions
from ..sources.tables import Written, table


def acceptance_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as attempts by the four methods in turn: the first method one of whose lines is returned 'A' is accepted."""
    c = F.col
    methods = F.array(*map(F.lit, extract.METHODS))
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("page"), F.element_at(methods, ((c("l_linenumber") - 1) % 4 + 1).cast("int")).alias("method"), (c("l_returnflag") == "A").alias("ok"), F.concat("l_linestatus", c("l_linenumber").cast("string")).alias("reason"), c("l_partkey").alias("payload"))
    return extract.accepted_attempts(rows).select("page", "method", "payload", F.array_join("reasons", ",").alias("reasons"))


def route_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda x: F.col(x).cast("string")
    routes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("route"), F.array(text("n_nationkey"), text("n_regionkey")).alias("keys"))
    found = table(spark, sf_dir, "supplier").select(text("s_suppkey").alias("id"), text("s_nationkey").alias("source_route"))
    return graph.with_artifacts(routes, found).select("route", F.array_join("artifacts", ",").alias("artifacts"))


def canonical_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("canonical"), F.array("c_mktsegment").alias("artifacts"))
    return graph.share_by_canonical(rows).select("route", F.array_join("artifacts", ",").alias("artifacts"))


def fallback_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(n.alias("id"), (n * 3).alias("k1"), (n % 200).alias("k2"), F.col("c_nationkey").alias("k3"))
    entries = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60).alias("key"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"))
    return graph.by_fallback_keys(rows, ["k1", "k2", "k3"], entries, "key", "seq").select("id", F.col("rank").cast("long").alias("rank"), "name")


def planned_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as routes, brands of their words as tabs: the files that are expected."""
    words = F.split("p_type", " ")
    tabs = F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<struct<label: string, slug: string>>")).otherwise(F.transform(words, lambda w: F.struct(w.alias("label"), F.lit(None).cast("string").alias("slug"))))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string"), F.lit("/")).alias("route"), tabs.alias("tabs"))
    return extract.planned_outputs(rows).select("route", F.array_join("files", ",").alias("files"))


def validation_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages as rows: counts that a manifest declares, required routes with pages, and a table that has rows."""
    t = lambda n: table(spark, sf_dir, n)
    counted = t("nation").agg(F.count("*").alias("n")).select(F.lit("nation").alias("name"), "n")
    declared = t("region").agg(F.count("*").alias("n")).select(F.lit("nation").alias("name"), "n")
    required = t("nation").select(F.col("n_name").alias("route"))
    pages = t("nation").where("n_nationkey > 2").select(F.col("n_name").alias("route"))
    stages = [validation.manifest_consistency(declared, counted), validation.required_pages(pages, required), validation.artifact_index(t("supplier"))]
    out = None
    for place, made in enumerate(stages):
        one = made.withColumn("place", F.lit(place).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out.select("place", "stage", "passed", "findings", F.array_join("reasons", ",").alias("reasons"))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderstatus").alias("body"))


_POST, _THIS_YEAR = "id long, year long, body string", 1997


def version_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts of three versions: posts change in one year and go in another; old years are taken from the version before. Parts of the last manifest, and which version wrote them."""
    posts, id_ = _posts(spark, sf_dir), F.col("id")
    table_ = versions.Versions(spark, Written(spark, "versions").folder, F.col("year"))
    table_.commit(posts.where(id_ % 10 != 1), "v1")
    edited = posts.withColumn("body", F.when(F.col("year").isin(1993, _THIS_YEAR), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    planned = edited.select("id").where(id_ % 7 != 3)
    reusable = F.col("year") < _THIS_YEAR - 1
    table_.commit(versions.next_version(planned, edited, table_.read(_POST), "id", reusable), "v2")
    table_.commit(table_.read(_POST).where((F.col("year") != 1994) | (id_ % 2 == 0)), "v3")
    found = table_.read(_POST).groupBy(F.col("year").cast("string").alias("part")).agg(F.count("*").alias("read"), F.count_if(F.col("body").endswith("!")).alias("edited"))
    return table_.manifest().join(found, "part").select("part", "version", "rows", "read", "edited")


def version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the second of these versions: reused posts as they were, others as they are now."""
    posts, id_ = _posts(spark, sf_dir), F.col("id")
    before = posts.where(id_ % 10 != 1).withColumn("body", F.concat("body", F.lit("?")))
    return versions.next_version(posts.where(id_ % 7 != 3).select("id"), posts, before, "id", F.col("year") < _THIS_YEAR - 1)


_PLANNED = "SELECT o_orderkey AS id, year(o_orderdate) AS y, o_orderstatus AS body, y < 1996 AND id % 10 <> 1 AS old FROM orders WHERE id % 7 <> 3"

QUERIES = {
    "version_rows": (version_rows, f"SELECT id, y AS year, CASE WHEN old THEN body || '?' ELSE body END AS body FROM ({_PLANNED})"),
    "version_parts": (version_parts, f"""WITH v2 AS (SELECT *, NOT old AND y IN (1993, 1997) AS edited FROM ({_PLANNED})), v3 AS (SELECT * FROM v2 WHERE y <> 1994 OR id % 2 = 0),
n AS (SELECT year(o_orderdate) AS y, count(*) FILTER (o_orderkey % 10 <> 1) AS n1, bool_and((o_orderkey % 10 <> 1) = (o_orderkey % 7 <> 3)) AS same FROM orders GROUP BY 1)
SELECT y::VARCHAR AS part, CASE WHEN y = 1994 THEN 'v3' WHEN any_value(same) AND NOT bool_or(edited) THEN 'v1' ELSE 'v2' END AS version, count(*) AS rows, count(*) AS read, count(*) FILTER (edited) AS edited FROM v3 JOIN n USING (y) GROUP BY y"""),
    "acceptance_cascade": (acceptance_cascade, """WITH a AS (SELECT l_orderkey AS page, (l_linenumber - 1) % 4 + 1 AS r, l_returnflag = 'A' AS ok, l_linestatus || l_linenumber AS reason, l_partkey AS payload FROM lineitem),
w AS (SELECT page, r, min(payload) AS payload FROM a WHERE ok GROUP BY page, r QUALIFY r = min(r) OVER (PARTITION BY page)),
l AS (SELECT a.page, string_agg(reason, ',' ORDER BY a.r, reason) AS reasons FROM a LEFT JOIN w USING (page) WHERE NOT ok AND (w.r IS NULL OR a.r < w.r) GROUP BY a.page)
SELECT p.page, coalesce(['direct-json', 'network-json', 'dom-fallback', 'failed'][w.r], 'failed') AS method, w.payload, coalesce(l.reasons, '') AS reasons FROM (SELECT DISTINCT page FROM a) p LEFT JOIN w USING (page) LEFT JOIN l USING (page)"""),
    "route_artifacts": (route_artifacts, """WITH h AS (SELECT n_name AS route, s_suppkey::VARCHAR AS id, min(CASE WHEN s_nationkey = n_nationkey THEN 0 ELSE 1 END) AS o FROM nation JOIN supplier ON s_nationkey IN (n_nationkey, n_regionkey) GROUP BY 1, 2)
SELECT n_name AS route, coalesce(string_agg(id, ',' ORDER BY o, id), '') AS artifacts FROM nation LEFT JOIN h ON h.route = n_name GROUP BY 1"""),
    "canonical_share": (canonical_share, """WITH c AS (SELECT c_nationkey AS k, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS a FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1)
SELECT c_custkey AS route, CASE WHEN c_custkey % 4 <> 0 THEN a ELSE c_mktsegment END AS artifacts FROM customer LEFT JOIN c ON k = c_nationkey"""),
    "fallback_keys": (fallback_keys, """WITH e AS (SELECT s_suppkey % 60 AS key, arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN a.name IS NOT NULL THEN 0 WHEN b.name IS NOT NULL THEN 1 WHEN c.name IS NOT NULL THEN 2 END::BIGINT AS rank, coalesce(a.name, b.name, c.name) AS name
FROM customer LEFT JOIN e a ON a.key = c_custkey * 3 LEFT JOIN e b ON b.key = c_custkey % 200 LEFT JOIN e c ON c.key = c_nationkey"""),
    "planned_outputs": (planned_outputs, """SELECT '/p/' || p_partkey || '/' AS route, CASE WHEN p_partkey % 3 = 0 THEN 'p/' || p_partkey || '.md'
  ELSE array_to_string(list_sort(list_distinct(['p/' || p_partkey || '/' || regexp_replace(lower(w), '[^a-z0-9]+', '-', 'g') || '.md' FOR w IN string_split(p_type, ' ')])), ',') END AS files FROM part"""),
    "validation_stages": (validation_stages, """SELECT 0::BIGINT AS place, 'manifest-consistency' AS stage, false AS passed, 1::BIGINT AS findings, 'count of nation' AS reasons
UNION ALL SELECT 1, 'query-smoke', count(*) = 0, count(*), coalesce(string_agg('no page: ' || n_name, ',' ORDER BY 'no page: ' || n_name), '') FROM nation WHERE n_nationkey <= 2
UNION ALL SELECT 2, 'artifact-index', count(*) > 0, (count(*) = 0)::BIGINT, '' FROM supplier"""),
}

"""Queries for the promotion gate over tables: nations as runs, with suppliers as pages, customers as routes and parts as candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import promotion, snapshot
from ..sources.tables import table

_SLUGS = ", ".join(f"'{s}'" for s in promotion.SAMPLES)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name, *columns: table(spark, sf_dir, name).selectExpr(*columns)
    runs = t(
        "nation", "bigint(n_nationkey) AS run", "if(n_nationkey % 4 = 0, 3, 0) AS min_pages", "n_nationkey % 3 <> 1 AS full_run", "n_nationkey % 2 = 0 AS include_blog", "n_nationkey % 6 = 0 AS partial",
        "if(n_nationkey % 9 = 0, array('x', 'direct-json-failure: all'), array(n_name)) AS warnings", "if(n_nationkey % 7 = 0, null, bigint(12)) AS resolvable", "bigint(n_regionkey) AS blog_routes", "if(n_nationkey % 5 = 2, null, bigint(n_regionkey * 3)) AS planned",
        "bigint(20 - n_nationkey) AS discovered", "if(n_nationkey % 8 = 3, null, bigint(n_nationkey)) AS previous_discovered", "if(n_nationkey % 8 = 4, null, bigint(n_regionkey)) AS previous_pages", "n_nationkey % 10 = 5 AS previous_gap", "n_nationkey = 24 AS force",
    )
    pages = t("supplier", "bigint(s_nationkey) AS run", f"element_at(array({_SLUGS}, 'other'), int(s_suppkey % 5) + 1) || '.md' AS path", "if(s_suppkey % 3 = 0, null, string(s_suppkey % 23)) AS content", "s_acctbal < -900 AS suspicious")
    counted = pages.groupBy("run").agg(F.count("*").alias("pages"))
    runs = runs.join(counted, "run", "left").withColumn("page_count", F.coalesce("pages", F.lit(0)) + F.when(F.col("run") % 11 == 1, 1).otherwise(0)).drop("pages")
    notes = t("customer", "bigint(c_nationkey) AS run", "c_custkey % 40 = 7 AS blog", "c_mktsegment = 'BUILDING' AS bundle", "c_custkey % 2 = 0 AS direct", "c_acctbal > 1000 AS saved", "bigint(c_custkey % 2) AS virtual_saved", "bigint(c_custkey % 10 = 0) AS virtual_failed", "bigint(c_custkey % 31 = 3) AS token_tables", "bigint(c_custkey % 62 = 3) AS tokens_rendered")
    coverage = t("customer", "bigint(c_nationkey) AS run", f"element_at(array({_SLUGS}), int(c_custkey % 4) + 1) AS path", "element_at(array('covered', 'failed', 'not-selected', 'covered', 'partial'), int(c_custkey % 5) + 1) AS status", "c_custkey % 25 = 1 AS accepted")
    candidates = t("part", "bigint(p_partkey % 25) AS run", "p_size = 50 AND p_partkey % 3 = 0 AS ambiguous", "p_partkey % 50 <> 9 AS covered")
    return promotion.run_facts(runs, pages, notes, coverage, candidates)


def promotion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of every run, decided by the run's tables."""
    return promotion.gate_rows(_facts(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


def promotion_first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's verdict and the check that is reported."""
    rows = promotion.gate_rows(_facts(spark, sf_dir)).withColumnRenamed("run", "grp")
    return snapshot.decided(rows).select(F.col("grp").alias("run"), "passed", "failed_check")


_LIST = "['components/buttons/specs', 'components/lists/specs', 'styles/color/roles', 'foundations/design-tokens/overview', 'other']"
_GATE = f"""
s AS (SELECT s_nationkey AS run, {_LIST}[s_suppkey % 5 + 1] AS path, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 23 END AS content, s_acctbal < -900 AS odd FROM supplier),
p AS (SELECT run, count(*) AS listed, count(*) FILTER (odd) AS odd FROM s GROUP BY run),
d AS (SELECT DISTINCT run FROM (SELECT run FROM s WHERE content IS NOT NULL GROUP BY run, content HAVING count(*) > 1)),
n AS (SELECT c_nationkey AS run, count(*) AS tried, count(*) FILTER (c_acctbal <= 1000) AS lost, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0) AS bundled,
  count(*) FILTER (c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 AND c_acctbal > 1000) AS bundled_ok, count(*) FILTER (c_custkey % 40 = 7) AS blogs, count(*) FILTER (c_custkey % 2 = 1) AS vs, count(*) FILTER (c_custkey % 10 = 0) AS vf,
  count(*) FILTER (c_custkey % 31 = 3) AS tt, count(*) FILTER (c_custkey % 62 = 3) AS tr, count(*) FILTER (c_custkey % 25 = 1 AND c_custkey % 5 IN (1, 4)) AS bad FROM customer GROUP BY 1),
q AS (SELECT p_partkey % 25 AS run, count(*) FILTER (p_size = 50 AND p_partkey % 3 = 0) AS amb, count(*) FILTER (p_partkey % 50 = 9) AS unc FROM part GROUP BY 1),
x AS (SELECT run, count(DISTINCT path) AS samples FROM (SELECT run, path FROM s WHERE path <> 'other' UNION ALL SELECT c_nationkey, {_LIST}[c_custkey % 4 + 1] FROM customer WHERE c_custkey % 5 = 2) GROUP BY run),
f AS (
  SELECT n_nationkey::BIGINT AS run, n_nationkey AS k, n_regionkey AS r, coalesce(listed, 0) AS listed, coalesce(listed, 0) + CASE WHEN n_nationkey % 11 = 1 THEN 1 ELSE 0 END AS pages, coalesce(odd, 0) AS odd, d.run IS NOT NULL AS doubled,
    coalesce(tried, 0) AS tried, coalesce(lost, 0) AS lost, coalesce(bundled, 0) AS bundled, coalesce(bundled_ok, 0) AS bundled_ok, coalesce(blogs, 0) AS blogs, coalesce(vs, 0) AS vs, coalesce(vf, 0) AS vf, coalesce(tt, 0) AS tt, coalesce(tr, 0) AS tr,
    coalesce(bad, 0) AS bad, coalesce(amb, 0) AS amb, coalesce(unc, 0) AS unc, coalesce(samples, 0) AS samples, k % 3 <> 1 AS whole, CASE WHEN k % 5 <> 2 THEN r * 3 END AS planned, CASE WHEN k % 2 = 0 THEN 12 ELSE 12 - r END AS expected
  FROM nation LEFT JOIN p ON p.run = n_nationkey LEFT JOIN d ON d.run = n_nationkey LEFT JOIN n ON n.run = n_nationkey LEFT JOIN q ON q.run = n_nationkey LEFT JOIN x ON x.run = n_nationkey
), checks AS (
  SELECT run, unnest(range(19)) AS place, unnest([{", ".join(f"'{c}'" for c in promotion.CHECKS)}]) AS name, unnest([
    pages >= CASE WHEN k % 4 = 0 THEN 3 ELSE 0 END, listed = pages, k = 24 OR k % 9 <> 0, k = 24 OR coalesce(planned = vs + vf, true), k = 24 OR NOT (whole AND k % 7 <> 0 AND expected > tried AND expected - tried >= greatest(5, ceil(0.2 * expected))),
    k = 24 OR bundled = 0 OR bundled_ok > 0, k = 24 OR k % 2 = 0 OR blogs = 0, k = 24 OR tt = 0 OR tr > 0, k = 24 OR NOT doubled, k = 24 OR odd = 0, k = 24 OR NOT (whole AND k % 10 = 5), k = 24 OR NOT (tried >= 10 AND lost > 0.2 * tried),
    k = 24 OR NOT coalesce(planned >= 10 AND vf > 0.2 * planned, false), k = 24 OR planned IS NOT NULL OR NOT (tried >= 10 AND lost > 0.2 * tried), k = 24 OR k % 6 = 0 OR k % 8 = 3 OR 20 - k >= ceil(0.8 * k), k = 24 OR k % 8 = 4 OR pages >= ceil(0.8 * r),
    k = 24 OR samples = 4, k = 24 OR NOT (whole AND bad > 0), k = 24 OR NOT (whole AND (amb > 0 OR unc > 0))]) AS passed FROM f
)"""

QUERIES = {
    "promotion_runs": (promotion_runs, f"WITH {_GATE} SELECT run, place, name, passed FROM checks"),
    "promotion_first_failures": (promotion_first_failures, f"WITH {_GATE} SELECT run, bool_and(passed) AS passed, arg_min(name, place) FILTER (NOT passed) AS failed_check FROM checks GROUP BY run"),
}

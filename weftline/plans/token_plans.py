"""Queries for the values of tokens and why some have none: parts as tokens, lines as their context entries, nations as routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens
from ..sources.tables import table


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, n = F.col("l_partkey"), F.col("l_quantity").cast("long"), F.col("l_linenumber")
    part = F.col("p_partkey")
    kind = F.when(part % 6 == 0, "FONT_TRACKING").when(part % 6 == 1, "AXIS_VALUE").otherwise("COLOR")
    own = table(spark, sf_dir, "part").select((part % 20).alias("table"), F.split("p_type", " ")[0].alias("set"), part.alias("token"), kind.alias("kind"))
    tags = F.array_compact(F.array(F.when((n % 2 == 0) | (p % 10 == 2), "dark").when(n % 3 == 0, "light"), F.when(n >= 5, "high.contrast"), F.when(q > 40, "3p"), F.when(q % 7 == 0, "medium.contrast"), F.when((q % 9 == 0) | (p % 10 == 1), "web")))
    shapes = F.array(*map(F.lit, ('{"length":{"unit":"DIPS","value":#}}', "{}", '{"odd":{"x":1}}', '{"fontTracking":{}}', '{"undefined":false}', '{"axis":{"tag":"wght","value":#}}', '{"t":"text #","n":null}')))
    value = F.replace(F.element_at(shapes, (p % 7 + 1).cast("int")), F.lit("#"), q.cast("string"))
    entries = table(spark, sf_dir, "lineitem").where(p % 10 != 0).select((p % 20).alias("table"), p.alias("token"), (F.col("l_orderkey") * 8 + n).alias("seq"), F.when(q % 5 != 0, tags).alias("tags"), ((p % 10 == 3) | (q % 11 == 0)).alias("undefined"), value.alias("value"))
    return tokens.token_cells(own, entries)


def token_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir)


def token_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.resolution(cells(spark, sf_dir))


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.resolution_totals(cells(spark, sf_dir))


def token_unresolved_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.resolution_by_table(cells(spark, sf_dir))


def token_unresolved_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as routes of tables: worst first, each with its first five tokens."""
    routes = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 22).cast("long").alias("table"), F.col("n_regionkey").cast("string").alias("route"))
    found = tokens.resolution_by_route(cells(spark, sf_dir), routes)
    shown = F.transform("found", lambda x: F.concat_ws(":", x["token"], x["role"], x["reason"]))
    return found.select("route", "rows", "cells", "tables", F.array_join(shown, ",").alias("examples"))


_CELLS = """
roles(ord, role, theme, other, high) AS (VALUES (1, 'light', 'light', 'dark', false), (2, 'dark', 'dark', 'light', false), (3, 'light-high-contrast', 'light', 'dark', true), (4, 'dark-high-contrast', 'dark', 'light', true)),
e AS (
  SELECT l_partkey AS token, l_orderkey * 8 + l_linenumber AS seq, l_quantity::BIGINT AS q, l_partkey % 10 = 3 OR q % 11 = 0 AS undef, q % 5 = 0 AS untagged,
    CASE WHEN l_linenumber % 2 = 0 OR l_partkey % 10 = 2 THEN 'dark' WHEN l_linenumber % 3 = 0 THEN 'light' END AS mode, l_linenumber >= 5 AS high, q > 40 AS ours, q % 7 = 0 OR q % 9 = 0 OR l_partkey % 10 = 1 AS barred
  FROM lineitem WHERE l_partkey % 10 <> 0
), total AS (SELECT token, count(*) FILTER (NOT undef) AS defined FROM e GROUP BY token),
pick AS (
  SELECT token, ord, arg_max(q, (CASE WHEN untagged THEN -1 ELSE CASE WHEN mode = theme THEN 8 ELSE 0 END + CASE WHEN ours THEN 4 ELSE 0 END + CASE WHEN r.high THEN 1 ELSE 0 END END, -seq)) AS q
  FROM e, roles r WHERE NOT undef AND CASE WHEN untagged THEN NOT r.high ELSE NOT barred AND coalesce(mode <> other, true) AND e.high = r.high END GROUP BY token, ord
), shown AS (
  SELECT p_partkey % 20 AS "table", split_part(p_type, ' ', 1) AS "set", p_partkey AS token, ord, role, q, coalesce(defined, 0) AS defined,
    CASE WHEN p_partkey % 6 = 1 THEN CASE WHEN p_partkey % 7 = 5 THEN '{"tag":"wght","value":' || q || '}' END
      WHEN p_partkey % 7 = 0 THEN q || 'dp' WHEN p_partkey % 7 = 6 THEN 'text ' || q END AS value
  FROM part CROSS JOIN roles LEFT JOIN pick USING (token, ord) LEFT JOIN total USING (token)
  WHERE NOT high OR q IS NOT NULL
), cells AS (
  SELECT *, CASE WHEN value IS NOT NULL THEN NULL WHEN q IS NULL THEN CASE WHEN defined = 0 THEN 'upstream-empty' ELSE 'missing-context-entry' END
    WHEN token % 7 IN (1, 4) OR token % 7 = 3 AND token % 6 = 0 THEN 'upstream-empty' ELSE 'unsupported-value-type' END AS reason FROM shown
)""".replace("FROM part CROSS JOIN roles LEFT JOIN pick USING (token, ord) LEFT JOIN total USING (token)", "FROM part CROSS JOIN roles LEFT JOIN pick ON pick.token = p_partkey AND pick.ord = roles.ord LEFT JOIN total ON total.token = p_partkey").replace("p_partkey AS token, ord, role", "p_partkey AS token, roles.ord, role")
BAD = _CELLS + ", bad AS (SELECT * FROM cells WHERE value IS NULL)"

QUERIES = {
    "token_cells": (token_cells, f'WITH {_CELLS} SELECT "table", "set", token, role, value, value IS NOT NULL AS resolved, reason FROM cells'),
    "token_reasons": (token_reasons, f"""WITH {BAD} SELECT r.reason, count(token) AS cells, count(DISTINCT token) AS rows, count(DISTINCT "table") AS tables
FROM (VALUES ('missing-alias-target'), ('missing-context-entry'), ('unsupported-value-type'), ('upstream-empty'), ('parser-bug'), ('unclassified')) AS r(reason) LEFT JOIN bad USING (reason) GROUP BY r.reason"""),
    "token_totals": (token_totals, f"""WITH {BAD} SELECT (SELECT count(DISTINCT "table") FROM cells) AS tables, (SELECT count(DISTINCT token) FROM cells) AS token_rows, count(DISTINCT token) AS unresolved_rows, count(*) AS unresolved_cells FROM bad"""),
    "token_unresolved_tables": (token_unresolved_tables, f"""WITH {BAD} SELECT "table", count(DISTINCT token) AS rows, count(*) AS cells FROM bad GROUP BY "table" """),
    "token_unresolved_routes": (token_unresolved_routes, f"""WITH {BAD}, pairs AS (SELECT DISTINCT n_nationkey % 22 AS t, n_regionkey::VARCHAR AS route FROM nation),
per AS (SELECT route, "table", token, count(*) AS n, arg_min(token || ':' || role || ':' || reason, ord) AS one FROM bad JOIN pairs ON t = "table" GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY "table", token) AS place FROM per)
SELECT route, count(*) AS rows, sum(n)::BIGINT AS cells, count(DISTINCT "table") AS tables, string_agg(one, ',' ORDER BY place) FILTER (place <= 5) AS examples FROM ranked GROUP BY route"""),
}

"""Queries for totals of diagnostics: lines as notes on routes, pages as notes on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup, routes, tokens
from ..sources.tables import table
from .token_plans import BAD, cells

#: What each counter of a line is: its number in COUNTERS and the line decide.
_COUNTER = "if((l_linenumber + {i}) % 3 = 0, null, bigint((l_quantity + {i}) % 5))"
_WORDS = "element_at(array({}), int(l_partkey % {}) + 1)"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda *words: _WORDS.format(", ".join("null" if w is None else f"'{w}'" for w in words), len(words))
    ways = [x for i, way in enumerate(rollup.WAYS) for x in (f"(l_partkey + {i}) % 2 = 0 AS {way}_attempted", f"if((l_partkey + {i}) % 7 = 0, null, (l_suppkey + {i}) % 3 = 0) AS {way}_succeeded")]
    lists = [f"if((l_partkey + {i}) % 4 = 0, null, array_repeat('X', int((l_linenumber + {i}) % 3))) AS {name}" for i, name in enumerate(rollup.LISTS)]
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS run", f"{text('json', 'dom', None)} AS final_method", f"{text('direct-json', 'network-json', 'dom-fallback', 'failed', None)} AS source_used", *ways, *lists,
        *[f"{_COUNTER.format(i=i)} AS {name}" for i, name in enumerate(rollup.COUNTERS)], "bigint(l_linenumber % 4) AS tables", "if(l_linenumber % 2 = 0, null, bigint(l_linenumber)) AS tables_requested",
        "if(l_partkey % 5 = 0, null, transform(sequence(1, int(l_linenumber)), i -> named_struct('fallback', i % 2 = 0, 'several', if(i % 3 = 0, null, i > 2), 'unresolved', bigint(i % 4)))) AS contexts",
    )


def route_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.route_totals(_notes(spark, sf_dir), ["run"])


def content_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    notes = table(spark, sf_dir, "pages").select((n % 3).alias("run"), (F.length("html") - 3000).alias("markdown_length"), (n % 4 == 0).alias("no_sections"), F.when(n % 5 != 0, n % 6 == 0).alias("no_headings"), F.regexp_count("html", F.lit("<b>")).cast("long").alias("images"), F.when(n % 2 == 0, F.regexp_count("html", F.lit("<p>"))).cast("long").alias("videos"), (n % 3).alias("unresolved"))
    return rollup.content_totals(notes, ["run"])


def combined_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three summaries in one row: tokens of parts, customers' specification pages, suppliers as rejected routes."""
    own = cells(spark, sf_dir)
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    specs = rollup.spec_totals(table(spark, sf_dir, "customer").select((c % 3 == 0).alias("component"), F.when(c % 4 != 0, c % 5).alias("tables")))
    plan = table(spark, sf_dir, "supplier").select(s.alias("route"), (s % 2 == 0).alias("stale"), F.when(s % 3 == 0, "public-docs").when(s % 3 == 1, "non-content-index").alias("class"))
    return rollup.combined(tokens.resolution_totals(own), tokens.resolution(own), specs, routes.rejected_summary(plan, None, None, 4))


def _of(i: int, name: str) -> str:
    return f"coalesce(sum(CASE WHEN (l_linenumber + {i}) % 3 <> 0 THEN (l_quantity::BIGINT + {i}) % 5 END), 0)::BIGINT AS {name}"


_LEN = [f"CASE WHEN (l_partkey + {i}) % 4 = 0 THEN 0 ELSE (l_linenumber + {i}) % 3 END" for i in range(3)]
_CTX = "CASE WHEN l_partkey % 5 <> 0 THEN {} ELSE 0 END"
_RENDERED = f"CASE WHEN (l_linenumber + {rollup.COUNTERS.index('tables_rendered')}) % 3 <> 0 THEN (l_quantity::BIGINT + {rollup.COUNTERS.index('tables_rendered')}) % 5 ELSE 0 END"

QUERIES = {
    "route_totals": (route_totals, f"""SELECT l_returnflag AS run, count(*) AS routes, count(*) FILTER (l_partkey % 3 = 0) AS through_json, count(*) FILTER (l_partkey % 3 = 1) AS through_dom,
  {", ".join(f"count(*) FILTER (l_partkey % 5 = {i}) AS {name}" for i, name in enumerate(("from_direct_json", "from_network_json", "from_dom", "failed")))},
  {", ".join(f"count(*) FILTER ((l_partkey + {i}) % 2 = 0 AND ((l_partkey + {i}) % 7 = 0 OR (l_suppkey + {i}) % 3 <> 0)) AS {way}_failed" for i, way in enumerate(rollup.WAYS))},
  {", ".join(f"count(*) FILTER ({_LEN[i]} > 0) AS with_{name}" for i, name in enumerate(rollup.LISTS[:2]))}, {", ".join(f"sum({_LEN[i]})::BIGINT AS {name}" for i, name in enumerate(rollup.LISTS))},
  {", ".join(_of(i, name) for i, name in enumerate(rollup.COUNTERS))}, count(*) FILTER (l_linenumber % 4 > 0) AS with_tables,
  sum(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber % 4 ELSE l_linenumber END)::BIGINT AS tables_requested, sum(greatest(0, l_linenumber % 4 - {_RENDERED}))::BIGINT AS tables_not_rendered,
  sum({_CTX.format("l_linenumber")})::BIGINT AS contexts, sum({_CTX.format("l_linenumber // 2")})::BIGINT AS contexts_fallback, sum({_CTX.format("len(list_filter(range(1, l_linenumber + 1), lambda i: i > 2 AND i % 3 <> 0))")})::BIGINT AS contexts_several,
  sum({_CTX.format("len(list_filter(range(1, l_linenumber + 1), lambda i: i % 4 > 0))")})::BIGINT AS contexts_unresolved FROM lineitem GROUP BY 1"""),
    "content_totals": (content_totals, """SELECT page_id % 3 AS run, count(*) AS pages, count(*) FILTER (length(html) < 3080) AS short, count(*) FILTER (page_id % 4 = 0) AS no_sections, count(*) FILTER (page_id % 5 <> 0 AND page_id % 6 = 0) AS no_headings,
  sum(len(regexp_extract_all(html, '<b>')))::BIGINT AS images, coalesce(sum(CASE WHEN page_id % 2 = 0 THEN len(regexp_extract_all(html, '<p>')) END), 0)::BIGINT AS videos, sum(page_id % 3)::BIGINT AS unresolved FROM pages GROUP BY 1"""),
    "combined_diagnostics": (combined_diagnostics, f"""WITH {BAD}, s AS (SELECT c_custkey % 3 = 0 AS own, c_custkey % 4 <> 0 AND c_custkey % 5 > 0 AS has FROM customer)
SELECT (SELECT count(DISTINCT token) FROM bad) AS unresolved_token_rows, (SELECT count(*) FROM bad) AS unresolved_token_cells,
  {", ".join(f"(SELECT count(*) FROM bad WHERE reason = '{r}') AS reason_{r.replace('-', '_')}" for r in ("missing-alias-target", "missing-context-entry", "unsupported-value-type", "upstream-empty", "parser-bug", "unclassified"))},
  count(*) FILTER (has) AS spec_with_tables, count(*) FILTER (NOT has) AS spec_without_tables, count(*) FILTER (own) AS component_specs, count(*) FILTER (own AND has) AS component_with_tables, count(*) FILTER (own AND NOT has) AS component_without_tables,
  (SELECT count(*) FROM supplier WHERE s_suppkey % 6 = 0) AS stale_public, 'routePlanSummary' AS source, 4 AS policy_skipped, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 1) AS non_content FROM s"""),
}

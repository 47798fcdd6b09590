"""Validation stages of a snapshot: each gives one row (place, stage, passed, reasons).

A stage collects findings as rows (reason), so that any number of them is aggregated;
stages are DataFrames until they are run, all of them or up to the first that fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

MOST_REASONS = 100
HARD_FAILURES = ("ambiguous", "unresolved", "stale")
#: Cells that block a table, and fillers that rendering leaves.
BLOCKING_VALUES = ("[unresolved]", "[missing]", "undefined", "[object Object]")
PLACEHOLDERS = r"(?i)\[unresolved|\[missing|Unsupported Material chunk|Material resource placeholder"
SMOKE_QUERIES = ("button", "switch", "list")
HEALTH = ("raw", "structured", "rendered", "coverage")


def stage(name: str, findings: Iterable[DataFrame], place: int = 0) -> DataFrame:
    """One row from findings (reason): passed without any; the first hundred reasons and how many there are."""
    found = None
    for part in findings:
        own = part.select(F.col("reason").cast("string").alias("reason")).where("reason is not null")
        found = own if found is None else found.unionByName(own)
    first = found.orderBy("reason").limit(MOST_REASONS).agg(F.array_sort(F.collect_list("reason")).alias("reasons"))
    total = found.agg(F.count("*").alias("n"))
    return total.crossJoin(first).select(F.lit(place).alias("place"), F.lit(name).alias("stage"), (F.col("n") == 0).alias("passed"), F.col("n").alias("findings"), "reasons")  # one row each


def no_rows(rows: DataFrame, reason: str) -> DataFrame:
    """A finding if the table is empty."""
    return rows.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(reason).alias("reason"))


def whenever(one: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    """Findings of a one-row table: the reasons of the conditions that hold."""
    return one.select(F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in checks)))).alias("reason"))


def raw_snapshot(manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Hashes and artifacts agree both ways; shell and script are there, and a site map of either kind is complete."""
    counts = artifacts.agg(*(F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in ("site-shell", "site-meta", "sitemap", "angular-bundle")))
    one = manifest.select("carbon_version", "bundle_hash", "site_meta_hash", "sitemap_hash").crossJoin(counts)  # one row each
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    meta, site = ~none("site_meta_hash"), ~none("sitemap_hash")
    findings = whenever(
        one,
        (none("carbon_version"), "no carbon version"),
        (none("bundle_hash"), "no script hash"),
        (F.col("site_shell") == 0, "no site-shell artifact"),
        (F.col("angular_bundle") == 0, "no angular-bundle artifact"),
        (~((meta & (F.col("site_meta") > 0)) | (site & (F.col("sitemap") > 0))), "no complete source of routes"),
        (meta & (F.col("site_meta") == 0), "site-meta hash without artifact"),
        (~meta & (F.col("site_meta") > 0), "site-meta artifact without hash"),
        (site & (F.col("sitemap") == 0), "sitemap hash without artifact"),
        (~site & (F.col("sitemap") > 0), "sitemap artifact without hash"),
    )
    unhashed = artifacts.where(F.col("kind").isin("site-shell", "site-meta", "sitemap", "angular-bundle") & (F.coalesce("sha256", F.lit("")) == "")).select(F.concat(F.lit("no sha256: "), "id").alias("reason"))
    return stage("raw-snapshot", [findings, unhashed])


def route_graph(routes: DataFrame, required: DataFrame) -> DataFrame:
    """Each required route (route) has exactly one node, no hard failure, and artifacts.

    routes: route, canonical, aliases, tab_routes, status, original_status, artifacts. A
    node that has the route as a tab comes before others, nodes of one canonical route
    are one.
    """
    want = required.select(paths.graph_route(F.col("route")).alias("want")).distinct()
    keys = F.array_compact(F.concat(F.array("route", "canonical"), "aliases"))
    named = routes.select(F.explode(F.concat(F.transform("tab_routes", lambda t: F.struct(F.lit(0).alias("rank"), paths.graph_route(t).alias("want"))), F.transform(keys, lambda k: F.struct(F.lit(1).alias("rank"), paths.graph_route(k).alias("want"))))).alias("k"), F.coalesce("canonical", "route").alias("node"), "status", "original_status", F.size("artifacts").alias("n"))
    hits = named.select("k.*", "node", "status", "original_status", "n").join(want, "want")
    nodes = hits.groupBy("want", "rank", "node").agg(F.min_by(F.struct("status", "original_status"), "node").alias("s"), F.max("n").alias("artifacts"))
    best = nodes.groupBy("want").agg(F.min("rank").alias("rank"))
    chosen = nodes.join(best, ["want", "rank"]).groupBy("want").agg(F.count("*").alias("nodes"), F.min("s").alias("s"), F.max("artifacts").alias("artifacts"))
    told = lambda text: F.concat(F.lit(text), "want")
    hard = F.col("s.status").isin(*HARD_FAILURES) | F.coalesce(F.col("s.original_status").isin(*HARD_FAILURES), F.lit(False))
    reason = F.when(F.col("nodes").isNull(), told("no node: ")).when(F.col("nodes") > 1, told("ambiguous: ")).when(hard, told("failed status: ")).when(F.col("artifacts") == 0, told("no artifacts: "))
    return stage("route-graph", [want.join(chosen, "want", "left").select(reason.alias("reason"))])


def browser_oracle(differences: DataFrame, captures: DataFrame, strict: bool) -> DataFrame | None:
    """Differences (reason) between captures and snapshot; without captures a strict run fails and another skips (None)."""
    if captures.limit(1).count():
        return stage("browser-oracle", [differences])
    return stage("browser-oracle", [no_rows(captures, "no captures")]) if strict else None


def structured_graph(pages: DataFrame, resources: DataFrame, token_tables: DataFrame, required: DataFrame) -> DataFrame:
    """No blocking token values, references hold both ways, and required routes have sections, chunks and resources.

    pages: page_id, route, resource_ids, sections, chunks; resources: resource_id, routes;
    token_tables: resource_id, values.
    """
    values = token_tables.select("resource_id", F.explode("values").alias("v")).where(F.col("v").isin(*BLOCKING_VALUES)).select(F.concat(F.lit("blocking value: "), "resource_id").alias("reason")).distinct()
    uses = pages.select("page_id", "route", F.explode("resource_ids").alias("resource_id"))
    orphans = uses.join(resources.select("resource_id"), "resource_id", "left_anti").select(F.concat(F.lit("unknown resource: "), "resource_id").alias("reason")).distinct()
    back = uses.join(resources.select("resource_id", "routes"), "resource_id").where(~F.array_contains("routes", F.col("route"))).select(F.concat(F.lit("route missing in resource: "), "resource_id").alias("reason")).distinct()
    want = required.select("route").distinct().join(pages.select("route", F.size("sections").alias("s"), F.size("chunks").alias("c"), F.size("resource_ids").alias("r")), "route", "left")
    bad = want.where("s is null or s = 0 or c = 0 or r = 0").select(F.concat(F.lit("incomplete page: "), "route").alias("reason"))
    return stage("structured-graph", [values, orphans, back, bad])


def rendered_output(files: DataFrame, required: DataFrame, rebuilt: DataFrame | None = None) -> DataFrame:
    """Required files (path) are there, none holds a placeholder, and a rebuild (path, text) equals what is stored."""
    missing = required.select("path").join(files.select("path"), "path", "left_anti").select(F.concat(F.lit("missing: "), "path").alias("reason"))
    filler = files.where(F.col("text").rlike(PLACEHOLDERS)).select(F.concat(F.lit("placeholder: "), "path").alias("reason"))
    parts = [missing, filler]
    if rebuilt is not None:
        other = files.select("path", F.sha2("text", 256).alias("stored")).join(rebuilt.select("path", F.sha2("text", 256).alias("again")), "path", "full").where(~F.col("stored").eqNullSafe(F.col("again")))
        parts.append(other.select(F.concat(F.lit("differs: "), "path").alias("reason")))
    return stage("rendered-output", parts)


def search_index(run: Callable[[str], DataFrame], structured: Callable[[str], DataFrame], queries: tuple[str, ...] = SMOKE_QUERIES) -> DataFrame:
    """Each smoke query finds something, and so does the structured search for the first."""
    parts = [no_rows(run(q), f"no result: {q}") for q in queries]
    return stage("search-index", [*parts, no_rows(structured(queries[0]), f"no structured result: {queries[0]}")])


def coverage_summary(summary: DataFrame, smoke: bool = False) -> DataFrame:
    """summary: health, failed, unresolved, partial. A full run is verified without problem routes; a smoke run may be partial."""
    c = F.col
    good = c("health").isin("partial", "verified") if smoke else c("health") == "verified"
    checks = [(~F.coalesce(good, F.lit(False)), "health")]
    if not smoke:
        checks += [(c(k) != 0, f"{k} routes") for k in ("failed", "unresolved", "partial")]
    return stage("coverage-summary", [whenever(summary, *checks)])


def manifest_consistency(declared: DataFrame, counted: DataFrame) -> DataFrame:
    """Declared counts (name, n) equal what is counted (name, n)."""
    rows = declared.select("name", F.col("n").alias("said")).join(counted.select("name", F.col("n").alias("found")), "name", "full").where(~F.col("said").eqNullSafe(F.col("found")))
    return stage("manifest-consistency", [rows.select(F.concat(F.lit("count of "), "name").alias("reason"))])


def manifest_health(manifest: DataFrame) -> DataFrame:
    """All four health values are verified."""
    checks = [(~F.col(f"{h}_health").eqNullSafe("verified"), f"{h} is not verified") for h in HEALTH]
    return stage("manifest-health", [whenever(manifest, *checks)])


def graph_files(tables: dict[str, DataFrame | None], filled: tuple[str, ...] = ("routes", "pages", "resources", "token_tables"), present: tuple[str, ...] = ("sections", "provenance")) -> DataFrame:
    """Four tables have rows, two more are there."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    absent = [n for n in (*filled, *present) if tables.get(n) is None]
    gone = spark.createDataFrame([(f"missing: {n}",) for n in absent], "reason string")
    return stage("graph-files", [gone, *(no_rows(tables[n], f"empty: {n}") for n in filled if n not in absent)])


def artifact_index(artifacts: DataFrame) -> DataFrame:
    return stage("artifact-index", [no_rows(artifacts, "no artifacts")])


def cache_files(names: DataFrame, required: DataFrame, pages: DataFrame) -> DataFrame:
    """Required files (name) are there and some page file is."""
    missing = required.select("name").join(names.select("name"), "name", "left_anti").select(F.concat(F.lit("missing: "), "name").alias("reason"))
    return stage("cache-files", [missing, no_rows(pages, "no pages")])


def required_pages(pages: DataFrame, required: DataFrame) -> DataFrame:
    """Required routes have a structured page."""
    missing = required.select("route").distinct().join(pages.select("route"), "route", "left_anti")
    return stage("query-smoke", [missing.select(F.concat(F.lit("no page: "), "route").alias("reason"))])


def fail_fast(stages: list[tuple[str, Callable[[], DataFrame | None]]]) -> list[dict]:
    """Runs stages in order until one fails; a stage that gives None is skipped."""
    out = []
    for place, (_, make) in enumerate(stages):
        made = make()
        if made is None:
            continue
        row = made.first().asDict() | {"place": place}
        out.append(row)
        if not row["passed"]:
            break
    return out


def run_all(stages: list[tuple[str, Callable[[], DataFrame | None]]]) -> list[dict]:
    """Runs all stages, whatever they find."""
    return [made.first().asDict() | {"place": place} for place, (_, make) in enumerate(stages) if (made := make()) is not None]

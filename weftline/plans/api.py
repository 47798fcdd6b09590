"""The named queries of the documentation graph, over a snapshot's tables.

A snapshot is a folder of Parquet tables (routes, pages, sections, resources,
token_tables, provenance, artifacts, manifest, diagnostics). Every query returns a
DataFrame; a table that isn't there gives no rows, which callers tell as unavailable.
Limits are the queries' own documented bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import paths, text
from ..operators import checks, graph, search, snapshot
from ..operators.coverage import STATUSES

SCHEMAS = {
    "routes": "seq long, route string, canonical string, aliases array<string>, section string, status string, reasons array<string>, expected array<string>, saved array<string>, failed array<string>, skipped array<string>, artifacts array<string>, tabs array<string>, shared_with array<string>",
    "pages": "seq long, page_id string, route string, title string, url string, section string, path string, headings array<string>, markdown string, resource_ids array<string>, section_ids array<string>",
    "sections": "seq long, section_id string, page_id string, title string, chunks array<struct<chunk_id: string, kind: string, text: string>>",
    "resources": "seq long, resource_id string, kind string, name string, status string, routes array<string>, page_ids array<string>, artifact_id string, reason string",
    "token_tables": "seq long, resource_id string, name string, routes array<string>, sets array<struct<name: string, tokens: array<struct<name: string, value: string, resolved: boolean, reason: string>>>>",
    "provenance": "subject string, artifact_ids array<string>, source_method string",
    "artifacts": "seq long, id string, kind string, local_path string, source_route string, sha256 string, bytes long, text string",
    "manifest": "generated_at timestamp, page_count long, health string",
    "diagnostics": "seq long, route string, path string, status string, reason string",
}
LIMITS = {"search_structured_docs": (20, 100), "list_routes": (100, 500), "search_docs": (10, 25), "get_component_docs": (10, 25), "get_page": (20_000, 100_000)}


def bounded(name: str, limit: int | None) -> int:
    own, most = LIMITS[name]
    n = own if limit is None else limit
    if not 1 <= n <= most:
        raise ValueError(f"{name}: limit must be from 1 to {most}")
    return n


class Snapshot:
    """A published snapshot; tables are read lazily, with filters and columns pushed to the scan.

    Tables are those of the version that was published last when the snapshot was opened or
    refreshed; a folder without versions holds the tables itself.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.folder = snapshot.current(spark, root) or root

    def available(self, name: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.folder}/{name}").schema  # noqa: B018
        except AnalysisException:
            return False
        return True

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(SCHEMAS[name])
        return rows.parquet(f"{self.folder}/{name}") if self.available(name) else self.spark.createDataFrame([], SCHEMAS[name])

    def refresh(self) -> None:
        self.spark.catalog.refreshByPath(self.root)
        self.folder = snapshot.current(self.spark, self.root) or self.root


def _slug(name: str, spark: SparkSession) -> str:
    return spark.range(1).select(paths.component_slug(F.lit(name)).alias("s")).first()["s"]


def belongs(routes: Column, slug: str) -> Column:
    """Whether one of these routes is of the component, in any of its singular forms."""
    forms = paths.singular_forms(F.lit(slug))
    own = F.transform(routes, lambda r: F.regexp_extract(r, r"^/?components/([^/]+)", 1))
    return F.exists(own, lambda c: F.array_contains(forms, c) | F.arrays_overlap(paths.singular_forms(c), forms))


def find_route(s: Snapshot, route: str) -> DataFrame:
    """The route itself before one that has it as canonical route or alias: one row at most."""
    wanted = s.spark.range(1).select(paths.graph_route(F.lit(route)).alias("r")).first()["r"]
    rank = F.when(F.col("route") == wanted, 0).when((F.col("canonical") == wanted) | F.array_contains("aliases", wanted), 1)
    return s.table("routes").withColumn("rank", rank).where("rank is not null").orderBy("rank", "seq").limit(1).drop("rank")


def get_component_overview(s: Snapshot, component: str) -> DataFrame:
    """One row: resources by kind, token counts, sorted routes and tabs, and the five first routes to read."""
    slug = _slug(component, s.spark)
    kinds = ("token-table", "status-table", "image", "video", "other")
    resources = s.table("resources").where(belongs(F.col("routes"), slug))
    counts = resources.agg(F.count("*").alias("resources"), *(F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in kinds))
    tokens = s.table("token_tables").where(belongs(F.col("routes"), slug)).agg(F.count("*").alias("token_tables"), F.coalesce(F.sum(F.aggregate(F.transform("sets", lambda x: F.size(x["tokens"])), F.lit(0), lambda a, b: a + b)), F.lit(0)).alias("tokens"))
    own = s.table("routes").where(belongs(F.array("route"), slug))
    rank = F.when(F.col("route").endswith("/specs"), 0).when(F.col("route").endswith("/overview"), 1).when(F.col("route").rlike(r"^/components/[^/]+$"), 2).otherwise(3)
    first = own.select("route", rank.alias("rank")).orderBy("rank", "route").limit(5).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "route"))), lambda x: x["route"]).alias("recommended"))
    listed = own.agg(F.array_sort(F.collect_set("route")).alias("routes"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tabs")))).alias("tabs"))  # one component's routes
    return counts.crossJoin(tokens).crossJoin(listed).crossJoin(first)  # one row each


def searchable(s: Snapshot) -> DataFrame:
    """Rows of the structured search: routes, pages with their sections and chunks, token sets with tokens, resources."""
    pages = s.table("pages").select("seq", "page_id", "route", "title", "headings")
    parts = s.table("sections").join(pages.select("page_id", F.col("seq").alias("page_seq"), "route", F.col("title").alias("page_title")), "page_id")
    row = lambda df, ord_, sub, kind, label, route: df.select(F.lit(ord_).alias("ord"), F.array(*[x.cast("long") for x in sub]).alias("id"), F.lit(kind).alias("kind"), label.alias("label"), route.alias("route"))
    c, zero = F.col, F.lit(0)
    routes = row(s.table("routes"), 0, [c("seq")], "route", F.concat_ws(" ", "route", "canonical", F.array_join("aliases", " ")), c("route"))
    page_rows = row(pages, 1, [c("seq"), zero, zero], "page", F.concat_ws(" ", "title", F.array_join("headings", " ")), c("route"))
    section_rows = row(parts, 1, [c("page_seq"), F.lit(1), c("seq"), zero], "section", F.concat_ws(" ", "page_title", "title"), c("route"))
    chunk = parts.select("page_seq", "seq", "route", F.posexplode("chunks").alias("pos", "c"))
    chunk_rows = row(chunk, 1, [c("page_seq"), F.lit(1), c("seq"), c("pos") + 1], "chunk", c("c.text"), c("route"))
    sets = s.table("token_tables").select("seq", F.element_at("routes", 1).alias("route"), F.posexplode("sets").alias("pos", "s"))
    set_rows = row(sets, 2, [c("seq"), c("pos"), zero], "token-set", c("s.name"), c("route"))
    toks = sets.select("seq", "route", "pos", F.posexplode("s.tokens").alias("tpos", "t"))
    token_rows = row(toks, 2, [c("seq"), c("pos"), c("tpos") + 1], "token", F.concat_ws(" ", "t.name", "t.value"), c("route"))
    resources = row(s.table("resources"), 3, [c("seq")], "resource", F.concat_ws(" ", "resource_id", "name"), F.element_at("routes", 1))
    out = routes
    for part in (page_rows, section_rows, chunk_rows, set_rows, token_rows, resources):
        out = out.unionByName(part)
    return out


def search_structured_docs(s: Snapshot, query: str, limit: int | None = None) -> DataFrame:
    return search.structured(searchable(s), query, bounded("search_structured_docs", limit)).select("kind", "label", "route")


def list_routes(s: Snapshot, section: str | None = None, status: str | None = None, query: str | None = None, limit: int | None = None) -> DataFrame:
    """Routes that pass all filters, with flags for structured page and Markdown, and how many match in all."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    rows = s.table("routes")
    rows = rows.where(F.col("section") == section) if section else rows
    rows = rows.where(F.col("status") == status) if status else rows
    rows = rows.where(F.lower("route").contains(query.lower())) if query else rows
    pages = s.table("pages")
    flagged = checks.with_flag(rows.select("seq", "route", "section", "status"), "route", pages.select("route"), "has_page")
    flagged = checks.with_flag(flagged, "route", pages.where("markdown is not null").select("route"), "has_markdown")
    total = rows.agg(F.count("*").alias("total_matched"))
    n = bounded("list_routes", limit)
    return flagged.orderBy("seq").limit(n).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total_matched") > n)  # total: one row


def get_route(s: Snapshot, route: str) -> DataFrame:
    return find_route(s, route)


def get_page(s: Snapshot, route: str, view: str = "structured", max_markdown: int | None = None) -> DataFrame:
    """The page of a route: 'structured', 'markdown' (cut at a length) or 'provenance'."""
    if view not in ("structured", "markdown", "provenance"):
        raise ValueError(f"unknown view: {view}")
    page = s.table("pages").join(find_route(s, route).select("route"), "route").orderBy("seq").limit(1)
    if view == "markdown":
        return page.select("page_id", "route", "title", F.substring("markdown", 1, bounded("get_page", max_markdown)).alias("markdown"))
    if view == "structured":
        sections = s.table("sections").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "section_id", "title"))).alias("sections"))
        return page.select("page_id", "route", "title", "headings", "resource_ids").join(sections, "page_id", "left")
    refs = s.table("provenance").join(page.select(F.concat(F.lit("page:"), "page_id").alias("subject")), "subject").select(F.explode("artifact_ids").alias("id"))
    return refs.join(s.table("artifacts").drop("text"), "id")


def _of_component(s: Snapshot, table: str, name: str) -> DataFrame:
    return s.table(table).where(belongs(F.col("routes"), _slug(name, s.spark))).orderBy("seq")


def get_component_tokens(s: Snapshot, name: str) -> DataFrame:
    return _of_component(s, "token_tables", name)


def get_component_tabs(s: Snapshot, name: str) -> DataFrame:
    return s.table("routes").where(belongs(F.array("route"), _slug(name, s.spark)) & (F.size("tabs") > 0)).orderBy("seq").select("route", "tabs")


def get_component_resources(s: Snapshot, name: str) -> DataFrame:
    return _of_component(s, "resources", name)


def docs_cache_status(s: Snapshot, fresh_hours: int = 24) -> DataFrame:
    age = F.unix_millis(F.current_timestamp()) - F.unix_millis("generated_at")
    return s.table("manifest").select("generated_at", "page_count", "health", (age < fresh_hours * 3_600_000).alias("fresh"))


SEARCHED = ("title", "section", "headings", "body")


def searched_pages(pages: DataFrame) -> DataFrame:
    """Pages as the full-text index takes them: four fields, the body's first 30,000 characters."""
    body = F.substring(text.strip_frontmatter(F.col("markdown")), 1, search.BODY_LIMIT)
    return pages.where("markdown is not null").select(F.col("seq").alias("id"), "title", "section", F.array_join("headings", " ").alias("headings"), body.alias("body"))


def build_search_index(s: Snapshot) -> search.Index:
    """Writes the full-text index beside the tables of the snapshot's version; search_docs() then reads it."""
    return search.write_index(searched_pages(s.table("pages")), f"{s.folder}/search", SEARCHED)


def search_docs(s: Snapshot, query: str, limit: int | None = None) -> DataFrame:
    """Full text over title, section, headings and the first 30,000 characters of the body, best first, with excerpts."""
    pages = s.table("pages").where("markdown is not null")
    index = search.read_index(s.spark, f"{s.folder}/search") if s.available("search/terms") else search.index_of(searched_pages(pages), SEARCHED)
    best = search.top(search.ranked(index, search.words(query) or ["\x00"]), bounded("search_docs", limit))
    return best.join(pages, best["id"] == pages["seq"]).select("title", "url", "path", "section", "headings", "score", text.excerpt(text.strip_frontmatter(F.col("markdown")), query).alias("excerpt")).orderBy(F.desc("score"), "path")


def get_docs_page(s: Snapshot, path_or_url: str) -> DataFrame:
    keys = s.spark.range(1).select(paths.lookup_keys(F.lit(path_or_url)).alias("k")).first()["k"]
    rows = s.table("pages").withColumn("keys", F.array_union(paths.lookup_keys(F.col("path")), paths.lookup_keys(F.col("url"))))
    return search.lookup(rows, "seq", "keys", keys).drop("keys")


def get_component_docs(s: Snapshot, name: str, include_markdown: bool = False, max_pages: int | None = None, max_chars: int = 20_000) -> DataFrame:
    """Pages of a component: by its routes, or by its name in the title."""
    slug = s.spark.range(1).select(paths.component_lookup(F.lit(name)).alias("s")).first()["s"]
    title = text.collapsed(F.lower("title")).contains(" ".join(name.lower().split()))
    rows = s.table("pages").where((F.lit(slug) != "") & (belongs(F.array(paths.graph_route(F.col("path"))), slug) | title))
    rows = rows.orderBy("seq").limit(bounded("get_component_docs", max_pages))
    shown = ["path", "title", "url", "section", "headings"]
    return rows.select(*shown, F.substring("markdown", 1, max_chars).alias("markdown")) if include_markdown else rows.select(*shown)


def list_components(s: Snapshot) -> DataFrame:
    named = s.table("pages").withColumn("component", F.regexp_extract("path", r"^components/([^/]+)/", 1)).where("component <> ''")
    return graph.first_rows(named.select("component", "seq", "section", "path"), ["component"], "seq").select("component", "section", "path").orderBy("component")


def refresh_docs(s: Snapshot, tables: dict[str, DataFrame], version: str, facts: snapshot.Facts, force: bool = False, limited: bool = False, allow_partial: bool = False, verified_full: bool = False) -> DataFrame:
    """Publishes new tables as a version if the gate lets it; the checks, in order. A version that fails stays unpublished.

    A limited run replaces no verified full snapshot and is no first one, unless partial ones
    are allowed: ``verified_full`` says of what manner the published one is. The snapshot
    itself reads the new version from then on.
    """
    may = snapshot.may_replace(verified_full, s.folder != s.root, limited, allow_partial)
    found = [*snapshot.gate(facts, force), (snapshot.CHECKS, "may-replace", may)]
    if all(passed for _, _, passed in found):
        snapshot.publish(s.spark, tables, s.root, version)
        s.refresh()
    return s.spark.createDataFrame(found, "place int, name string, passed boolean")


def docs_cache_diagnostics(s: Snapshot, route: str | None = None, path: str | None = None, failed: bool = False, skipped: bool = False, limit: int = 100) -> DataFrame:
    rows = s.table("diagnostics")
    rows = rows.where(F.col("route") == route) if route else rows
    rows = rows.where(F.col("path") == path) if path else rows
    kinds = [k for k, on in (("failed", failed), ("skipped", skipped)) if on]
    return (rows.where(F.col("status").isin(*kinds)) if kinds else rows).orderBy("seq").limit(limit)


def get_route_artifacts(s: Snapshot, route: str) -> DataFrame:
    ids = find_route(s, route).select(F.posexplode("artifacts").alias("pos", "id"))
    return ids.join(s.table("artifacts").drop("text"), "id").orderBy("pos").drop("pos")


def get_raw_artifact(s: Snapshot, id: str, full: bool = False, preview_chars: int = 2000) -> DataFrame:
    """An artifact with the start of its text, or all of it up to 200,000 bytes."""
    whole = F.lit(full) & (F.col("bytes") <= 200_000)
    return s.table("artifacts").where(F.col("id") == id).select("id", "kind", "local_path", "sha256", "bytes", F.when(whole, F.col("text")).otherwise(F.substring("text", 1, preview_chars)).alias("text"))


def explain_route_coverage(s: Snapshot, route: str) -> DataFrame:
    """A route's status, what is missing of it, and the status of each route that shares its pages."""
    own = find_route(s, route)
    shared = own.select("route", F.col("status").alias("own_status"), F.explode_outer("shared_with").alias("member"))
    status = s.table("routes").select(F.col("route").alias("member"), F.col("status").alias("member_status"))
    members = shared.join(status, "member", "left").groupBy("route").agg(F.array_sort(F.collect_list(F.when(F.col("member").isNotNull(), F.struct("member", F.coalesce("member_status", "own_status").alias("status"))))).alias("members"))
    told = F.when(F.col("status") == "covered", "all expected pages are saved").when(F.col("status") == "partial", "some expected pages are missing").when(F.col("status") == "failed", "all expected pages failed").when(F.col("status") == "skipped", "all expected pages were skipped").otherwise("no expected page was decided")
    return own.select("route", "status", told.alias("told"), F.array_except("expected", "saved").alias("missing"), "reasons").join(members, "route", "left")


def explain_resource_resolution(s: Snapshot, resource_id: str) -> DataFrame:
    rows = s.table("resources").where(F.col("resource_id") == resource_id)
    return rows.select("resource_id", "kind", "status", F.coalesce("reason", F.when(F.col("artifact_id").isNull(), "no artifact").otherwise("decoded")).alias("told"), "routes", "page_ids")


TOOLS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        get_component_overview, search_structured_docs, list_routes, get_route, get_page, get_component_tokens, get_component_tabs, get_component_resources, docs_cache_status, search_docs,
        get_docs_page, get_component_docs, list_components, refresh_docs, docs_cache_diagnostics, get_route_artifacts, get_raw_artifact, explain_route_coverage, explain_resource_resolution,
    )
}

"""Extraction of pages: acceptance, identity, tabs, resources, planned outputs and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import match_text

METHODS = ("direct-json", "network-json", "dom-fallback", "failed")
NON_CONTENT_REASONS = ("json-title-missing", "json-no-sections", "json-no-headings", "json-short-markdown")
PREVIEW = 800


def accepted_attempts(attempts: DataFrame) -> DataFrame:
    """The first successful attempt of each page (page, method, ok, reason, payload) in the order of METHODS.

    Reasons of the attempts before it are kept, in order; a page without a success fails.
    """
    rank = reduce(lambda out, m: out.when(F.col("method") == m[1], m[0]), enumerate(METHODS), F.when(F.lit(False), 0))
    rows = attempts.withColumn("rank", rank)
    won = rows.where("ok").groupBy("page").agg(F.min(F.struct("rank", "method", "payload")).alias("w"))
    lost = rows.where("not ok").select("page", "rank", "reason").join(won.select("page", F.col("w.rank").alias("at")), "page", "left").where("at is null or rank < at")
    reasons = lost.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "reason"))), lambda r: r["reason"]).alias("reasons"))  # at most one a method
    out = rows.select("page").distinct().join(won, "page", "left").join(reasons, "page", "left")
    return out.select("page", F.coalesce("w.method", F.lit("failed")).alias("method"), "w.payload", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def identity_accepted(actual: Column, expected: Column, actual_id: Column, expected_id: Column) -> Column:
    """Whether a payload is of the wanted route: its route is one of the expected, or the ids agree, case aside."""
    return F.coalesce(F.array_contains(F.transform(expected, paths.graph_route), paths.graph_route(actual)), F.lit(False)) | F.coalesce(F.lower(actual_id) == F.lower(expected_id), F.lit(False))


def content_mismatch(route: Column, title: Column, headings: Column, text: Column) -> Column:
    """Why a component page shows something else; null if it doesn't."""
    slug = F.regexp_extract(F.regexp_replace(route, "^/+", ""), r"^components/+([^/]+)", 1)
    words = F.filter(F.split(match_text(slug), " "), lambda w: F.length(w) > 1)
    acronym = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    body = match_text(F.concat_ws(" ", title, F.array_join(headings, " "), F.substring(text, 1, PREVIEW)))
    mentions = F.forall(words, lambda w: body.contains(w)) | ((F.length(acronym) >= 2) & body.contains(acronym))
    index = (match_text(title) == "components") | (match_text(F.coalesce(F.get(headings, F.lit(0)), title)) == "components")
    return F.when(slug == "", F.lit(None).cast("string")).when(index, "parent index").when(~mentions, "slug not mentioned")


def non_content_index(path: Column, reason: Column) -> Column:
    """Bare section index pages, whose lack of content is no failure."""
    return F.coalesce(path.rlike(r"^[a-z][a-z-]*\.md$") & reason.isin(*NON_CONTENT_REASONS), F.lit(False))


def module_kind(library: Column, module: Column, resource: Column) -> Column:
    """How a resource chunk is read: status-table, token-table or placeholder."""
    own = F.coalesce(library, module, resource, F.lit("UNKNOWN_RESOURCE"))
    return F.when(own == "STATUS_TABLE", "status-table").when(own.isin("TOKEN_TABLE", "TYPOGRAPHY"), "token-table").otherwise("placeholder")


def planned_outputs(routes: DataFrame) -> DataFrame:
    """Expected routes and files of routes (route, tabs: (label, slug)): a file a tab, or one for the route itself."""
    own = paths.coverage_route(F.col("route"))
    tabs = F.transform("tabs", lambda t: F.concat(F.when(own == "/", F.lit("")).otherwise(own), F.lit("/"), paths.tab_slug(t["label"], t["slug"])))
    expected = F.when(F.size("tabs") > 0, F.array_sort(F.array_distinct(tabs))).otherwise(F.array(own))
    return routes.select("route", expected.alias("routes"), F.transform(expected, paths.markdown_path).alias("files"))


def virtual_tabs(routes: DataFrame) -> DataFrame:
    """A route for each tab that has none of its own: its expected path is the tab's, the other sets are cut to it.

    routes: route, tab_routes, expected, saved, failed, skipped.
    """
    tabs = routes.select(F.col("route").alias("parent"), F.explode("tab_routes").alias("route"), "expected", "saved", "failed", "skipped")
    fresh = tabs.join(routes.select("route"), "route", "left_anti")
    path = paths.markdown_path(F.col("route"))
    cut = lambda c: F.filter(c, lambda p: p == path)
    return fresh.select("route", "parent", F.array(path).alias("expected"), *(cut(F.col(c)).alias(c) for c in ("saved", "failed", "skipped")))


def match_tabs(tabs: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections of tabs: by slug or alternate slug, then by label, then by place if there are as many of both.

    tabs: page, pos, label, slug, alternates; sections: page, pos, name.
    """
    kebab = paths.kebab
    named = sections.select("page", F.col("pos").alias("section"), kebab(F.col("name")).alias("key")).where("key <> ''")
    slugs = tabs.select("page", "pos", F.explode(F.array_compact(F.concat(F.array("slug"), F.coalesce("alternates", F.array().cast("array<string>"))))).alias("s")).select("page", "pos", kebab(F.col("s")).alias("key"))
    one = slugs.join(named, ["page", "key"]).groupBy("page", "pos").agg(F.min("section").alias("section")).withColumn("rule", F.lit(1))
    two = tabs.select("page", "pos", kebab(F.col("label")).alias("key")).join(named, ["page", "key"]).groupBy("page", "pos").agg(F.min("section").alias("section")).withColumn("rule", F.lit(2))
    even = tabs.groupBy("page").agg(F.count("*").alias("n")).join(sections.groupBy("page").agg(F.count("*").alias("m")), "page").where("n = m").select("page")
    three = tabs.join(even, "page").select("page", "pos", F.col("pos").alias("section"), F.lit(3).alias("rule"))
    best = one.unionByName(two).unionByName(three).groupBy("page", "pos").agg(F.min_by(F.struct("rule", "section"), "rule").alias("b"))
    by = F.when(F.col("b.rule") == 1, "slug").when(F.col("b.rule") == 2, "label").when(F.col("b.rule") == 3, "position").otherwise("tab-section-mismatch")
    return tabs.select("page", "pos").join(best, ["page", "pos"], "left").select("page", "pos", F.col("b.section").alias("section"), by.alias("matched_by"))


def captured_resource(wanted: DataFrame, responses: DataFrame) -> DataFrame:
    """The captured response (page, seq, name, url, type) for each wanted resource (page, resource, type).

    By equal name, then by its last part within a name, then by that part in the URL; the
    first response of the best rule. Joined by page, so that only a page's own responses count.
    """
    last = F.element_at(F.filter(F.split(F.trim("resource"), "/"), lambda x: x != ""), -1)
    r = responses.select("page", F.col("seq"), F.col("name"), F.col("url"), F.col("type").alias("r_type"))
    fits = F.when(F.col("type") == "TOKEN_TABLE", F.col("r_type") == "token-table").when(F.col("type") == "STATUS_TABLE", F.col("r_type") == "status-table").otherwise(F.col("r_type").isin("dsdb-resource", "unknown-json-resource"))
    rows = wanted.withColumn("last", last).join(r, "page").where(fits)
    by_url = F.when(F.col("type") == "TOKEN_TABLE", F.col("url").contains(F.concat(F.lit("TOKEN_TABLE."), "last", F.lit(".json")))).when(F.col("type") == "STATUS_TABLE", F.col("url").contains(F.col("last")))
    rule = F.when(F.col("name") == F.trim("resource"), 1).when(F.col("name").contains(F.col("last")), 2).when(by_url, 3)
    best = rows.withColumn("rule", rule).where("rule is not null").groupBy("page", "resource", "type").agg(F.min(F.struct("rule", "seq", "url")).alias("b"))
    return best.select("page", "resource", "type", "b.rule", "b.seq", "b.url")


def nav_links(rows: DataFrame, key: str, json: str, base: str) -> DataFrame:
    """Document paths of every href at any depth of navigation JSON: text is scanned, so no depth is too deep."""
    hrefs = F.regexp_extract_all(F.col(json), F.lit(r'"href"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    found = rows.select(key, F.explode(hrefs).alias("href")).select(key, paths.doc_path(F.col("href"), F.lit(base)).alias("path"))
    return found.where("path is not null").distinct()


def display_sets(html: Column) -> Column:
    """Token sets that a viewer element names in a JSON attribute."""
    raw = F.regexp_extract(html, r"""(?i)<token-viewer[^>]*display-token-sets=(?:'([^']*)'|"([^"]*)")""", 0)
    value = F.replace(F.regexp_extract(raw, r"""=(?:'|")(\[.*\])(?:'|")""", 1), F.lit("&quot;"), F.lit('"'))
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def metadata_warnings(collection: Column, document: Column, carbon: Column) -> Column:
    """What an entry of the route table lacks."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.array_compact(F.array(F.when(empty(collection), "missing-collection-id"), F.when(empty(document), "missing-document-id"), F.when(empty(carbon), "missing-exported-carbon-file-id")))


def renderer_report(pages: DataFrame, required: list[str]) -> DataFrame:
    """Findings of each page (route, unknown_chunks, unknown_resources, placeholders, source_titles, rendered_titles)."""
    counts = pages.select("route", F.explode("unknown_chunks").alias("k")).groupBy("route", "k").agg(F.count("*").alias("n"))
    chunks = counts.groupBy("route").agg(F.array_sort(F.collect_list(F.struct(F.col("k").alias("chunk"), F.col("n").alias("count")))).alias("chunks"))
    must = F.col("route").isin(*required)
    dropped = F.array_except(F.transform("source_titles", match_text), F.transform("rendered_titles", match_text))
    bad = (F.size("unknown_chunks") > 0) | (F.size("unknown_resources") > 0) | (F.size("placeholders") > 0)
    out = pages.select("route", "unknown_resources", "placeholders", dropped.alias("dropped_titles"), F.size("source_titles").alias("source_sections"), (F.size("source_titles") - F.size(dropped)).alias("rendered_sections"), must.alias("required"), F.when(bad & must, "error").otherwise("warning").alias("severity"))
    return out.join(chunks, "route", "left")


def paired_lines(rows: DataFrame, key: str) -> DataFrame:
    """Even and odd lines (key, pos, line) as names and values."""
    return rows.groupBy(key, F.floor(F.col("pos") / 2).alias("pair")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("line"))).alias("name"), F.max(F.when(F.col("pos") % 2 == 1, F.col("line"))).alias("value"))

"""Column expressions for URLs, routes, cache paths, slugs and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and path prefixes that never are documents.
ASSET = r"(?i)\.(png|jpg|jpeg|gif|webp|svg|ico|pdf|zip|xml|json|txt)$"
NON_DOCUMENT = ("assets/", "static/", "_dsm/", "m3/pages/", "favicon", "manifest", "robots.txt", "sitemap")
_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)"


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def url_path(url: Column) -> Column:
    """Path of an absolute URL, '/' if it has none; '' for anything else."""
    path = F.regexp_extract(url, _SPLIT, 2)
    return F.when(origin(url) == "", F.lit("")).otherwise(F.when(path == "", F.lit("/")).otherwise(path))


def without_dots(path: Column) -> Column:
    """'.' and '..' segments resolved, as URL resolution does."""
    last_dots = path.rlike(r"(^|/)\.\.?$")
    parts = F.aggregate(
        F.split(F.regexp_replace(path, r"^/", ""), "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"), F.when(last_dots & (F.size(parts) > 0), F.lit("/")).otherwise(F.lit("")))


def absolute_url(raw: Column, base: Column) -> Column:
    """A reference made absolute: a bare relative one counts from the site's root; null if it is no web address."""
    own = origin(base)
    folder = F.regexp_replace(url_path(base), r"[^/]*$", "")
    other = raw.rlike(r"(?i)^[a-z][a-z\d+.-]*:") & ~raw.rlike(r"(?i)^https?://[^/?#]+")
    return (
        F.when(raw.isNull() | (own == "") | other, F.lit(None).cast("string"))
        .when(raw.rlike(r"(?i)^https?://"), F.concat(origin(raw), without_dots(url_path(raw))))
        .when(raw.startswith("//"), F.concat(F.regexp_extract(own, r"^([a-z]+:)", 1), F.regexp_extract(raw, r"^(//[^/?#]*)", 1), without_dots(F.regexp_extract(raw, r"^//[^/?#]*([^?#]*)", 1))))
        .when(raw.startswith("/"), F.concat(own, without_dots(F.regexp_extract(raw, r"^([^?#]*)", 1))))
        .when(raw.rlike(r"^[?#]") | (raw == ""), F.concat(own, url_path(base)))
        .otherwise(F.concat(own, without_dots(F.concat(F.lit("/"), F.regexp_extract(raw, r"^([^?#]*)", 1)))))
    )


def normalize_url(raw: Column, base: Column) -> Column:
    """Same-origin documents only, without query, fragment or final slash; else null."""
    full = absolute_url(raw, base)
    return F.when((origin(full) == origin(base)) & ~url_path(full).rlike(ASSET), F.regexp_replace(full, r"/$", ""))


def doc_path(raw: Column, base: Column) -> Column:
    """Path of a normalised document URL; null for other resources."""
    path = F.regexp_replace(url_path(normalize_url(raw, base)), r"/+", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/$", ""))
    bare = F.regexp_replace(path, r"^/+", "")
    bad = F.lit(False)
    for prefix in NON_DOCUMENT:
        bad = bad | bare.startswith(prefix)
    return F.when(~bad, path)


def page_path(url: Column) -> Column:
    bare = F.regexp_replace(url_path(url), r"^/+|/+$", "")
    return F.concat(F.when(bare == "", F.lit("index")).otherwise(bare), F.lit(".md"))


def section(path: Column) -> Column:
    bare = F.regexp_replace(path, r"\.md$", "")
    return F.when(bare.contains("/"), F.regexp_replace(bare, r"/[^/]*$", "")).otherwise(F.lit("root"))


def page_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def graph_route(value: Column) -> Column:
    """The route key: a path with one leading slash, no extension and no outer slashes."""
    text = F.btrim(value, F.lit(" \t\r\n\f"))
    path = F.when(text.rlike("^https?://"), url_path(text)).otherwise(text)
    path = F.regexp_replace(F.regexp_replace(path, r"(?i)^pages/", ""), r"[\\/]+", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"(?i)\.md$", ""), r"^/+|/+$", "")
    return F.concat(F.lit("/"), F.regexp_replace(path, r"^index\z", ""))  # named once, so that Spark makes it once


def markdown_path(route: Column) -> Column:
    own = graph_route(route)
    return F.when(own == "/", F.lit("index.md")).otherwise(F.concat(F.regexp_replace(own, "^/+", ""), F.lit(".md")))


def coverage_route(path: Column) -> Column:
    return F.when(path.isin("", "/"), F.lit("/")).otherwise(F.concat(F.lit("/"), F.regexp_replace(path, r"^/+|/+$", "")))


def output_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"(?i)\.md$", ".md")


def promotion_key(value: Column) -> Column:
    bare = F.regexp_replace(F.when(origin(value) != "", url_path(value)).otherwise(value), r"^/+", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.md$", ""), r"/+$", "")


def kebab(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def tab_slug(label: Column, slug: Column) -> Column:
    return F.when(F.coalesce(slug, F.lit("")) != "", F.regexp_replace(slug, r"^/+|/+$", "")).otherwise(kebab(label))


def component_lookup(name: Column) -> Column:
    """Slug of a component's name as page lookups use it: 'overview' dropped, other signs to '-'."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(F.btrim(name, F.lit(" \t\r\n"))), F.lit("overview"), F.lit("")), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def component_slug(name: Column) -> Column:
    """Slug as graph lookups use it: spaces to '-', other signs dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(name, F.lit(" \t\r\n"))), r"\s+", "-"), r"[^a-z0-9-]", "")


def singular_forms(token: Column) -> Column:
    """The token and its singular candidates, distinct, in order."""
    n = F.length(token)
    forms = F.array(
        token,
        F.when(token.endswith("ies") & (n > 3), F.concat(token.substr(F.lit(1), n - 3), F.lit("y"))),
        F.when(token.endswith("es") & (n > 3), token.substr(F.lit(1), n - 2)),
        F.when(token.endswith("s") & (n > 2), token.substr(F.lit(1), n - 1)),
    )
    return F.array_distinct(F.array_compact(forms))


def lookup_keys(value: Column) -> Column:
    """Keys a page answers to: its bare route, with 'overview' and the landing page as one."""
    bare = F.regexp_replace(graph_route(value), "^/+", "")
    root = F.regexp_replace(bare, r"/?overview$", "")
    return F.array_distinct(F.array(bare, root, F.when(root == "", F.lit("overview")).otherwise(F.concat(root, F.lit("/overview")))))


def text_id(value: Column) -> Column:
    """An id given as text or number: trimmed, empty as null."""
    return F.nullif(F.btrim(value.cast("string"), F.lit(" \t\r\n")), F.lit(""))


def safe_segment(value: Column) -> Column:
    return F.regexp_replace(value, r"[^a-zA-Z0-9._-]+", "_")


def resource_basename(name: Column) -> Column:
    parts = F.regexp_extract(name, r"designSystems/([^/]+)/components/([^/]+)", 1)
    other = F.regexp_extract(name, r"designSystems/([^/]+)/components/([^/]+)", 2)
    return F.when(parts != "", F.concat(F.lit("designSystems_"), parts, F.lit("_components_"), other)).otherwise(F.element_at(F.split(name, "/"), -1))

"""Ordered classifications: each is one CASE whose branches keep their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path prefixes of the crawl tiers and of news, and sections that are documents.
TIERS = ((1, ("/components", "/styles", "/foundations")), (2, ("/develop", "/get-started", "/designing")), (3, ("/resources", "/templates", "/case-studies")))
NEWS = ("/blog", "/articles", "/news")
SECTIONS = ("/components", "/styles", "/foundations")
UNSUPPORTED = ("/develop/android", "/develop/web", "/develop/ios", "/develop/flutter", "/develop/compose", "/develop/views", "/develop/figma", "/policies/", "/platform/")


def starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | value.startswith(prefix)
    return out


def _rooted(path: Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, "^/+", ""), r"[?#].*$", ""))


def is_blog(path: Column) -> Column:
    own = _rooted(path)
    return starts_with_any(own, NEWS) | own.rlike(r"^/20\d\d(/|$)")


def priority(path: Column) -> Column:
    """Crawl tier, 1 (core) to 5 (unknown)."""
    own = _rooted(path)
    out = F.when(own == "/", 1)
    for tier, prefixes in TIERS:
        out = out.when(starts_with_any(own, prefixes), tier)
    return out.when(is_blog(path), 4).otherwise(5)


def is_docs_path(route: Column, include_blog: bool) -> Column:
    docs = route.isin(*SECTIONS) | starts_with_any(route, tuple(f"{s}/" for s in SECTIONS)) | route.startswith("/develop/")
    return ~route.startswith("/go/") & (docs | (is_blog(route) & F.lit(include_blog)))


def public_docs(route: Column, sources: Column, redirect: Column, collection: Column, document: Column, carbon: Column, include_blog: bool = False) -> Column:
    """Eight-way class of a route candidate; ``sources`` is an array of the origins that name it."""
    has = lambda s: F.array_contains(sources, s)
    plain = has("bundle") & ~has("site_meta") & ~has("nav_drawers")
    unseen = plain & ~has("sitemap") & ~has("rendered")
    missing = F.coalesce(collection, F.lit("")).eqNullSafe("") | F.coalesce(document, F.lit("")).eqNullSafe("")
    return (
        F.when(F.coalesce(redirect, F.lit("")) != "", "redirect")
        .when(route.startswith("/go/"), "go-link")
        .when(route.rlike(r"(?i)\.(png|jpg|jpeg|gif|svg|webp|css|js|xml|txt|json)$"), "asset")
        .when(plain & route.isin(*SECTIONS), "non-content-index")
        .when(starts_with_any(route, UNSUPPORTED), "unsupported-platform-or-policy")
        .when(~is_docs_path(route, include_blog), "outside-public-docs")
        .when(unseen & missing, "missing-extraction-metadata")
        .when(plain & (F.coalesce(carbon, F.lit("")) == "") & missing, "missing-extraction-metadata")
        .otherwise("public-docs")
    )


def response_type(path: Column, payload: Column) -> Column:
    """Class of a captured JSON response: the payload's shape first, then its URL path. ``payload`` is VARIANT."""
    shape = lambda p: F.schema_of_variant(F.try_variant_get(payload, p, "variant"))
    there = lambda p: F.try_variant_get(payload, p, "variant").isNotNull()
    array = lambda p: F.coalesce(shape(p).startswith("ARRAY"), F.lit(False))
    text = lambda p: F.coalesce(F.trim(F.try_variant_get(payload, p, "string")) != "", F.lit(False))
    any_of = lambda f, *ps: F.greatest(*(f(p).cast("int") for p in ps), F.lit(0)) == 1
    content_url = path.rlike(r"(?i)/_dsm/content/m3/.+\.json$")
    inner = any_of(array, "$.contentBlocks", "$.contentChunks")
    title = any_of(text, "$.title", "$.name", "$.page.title", "$.content.title")
    return (
        F.when(array("$.system.tokenSets"), "token-table")
        .when(any_of(array, "$.states", "$.rows"), "status-table")
        .when(any_of(array, "$.sections", "$.content.sections", "$.page.sections", "$.data.sections") | (title & inner) | (content_url & inner), "content-page")
        .when(any_of(text, "$.result.pageContext.pageCanonId", "$.pageCanonId", "$.result.pageContext.title", "$.pathname", "$.path", "$.title"), "page-metadata")
        .when(any_of(text, "$.resourceName", "$.resourcePath", "$.libraryModuleType") | any_of(there, "$.moduleConfigurationOverrides", "$.resource", "$.component", "$.tokenSets"), "dsdb-resource")
        .when(path.rlike(r"(?i)TOKEN_TABLE\.[^/]+\.json$"), "token-table")
        .when(path.rlike(r"(?i)STATUS_TABLE"), "status-table")
        .when(content_url, "content-page")
        .when(path.rlike(r"(?i)/page-data/.+\.json$"), "page-metadata")
        .when(path.rlike(r"(?i)/_dsm/data/dsdb-m3/.+\.json$"), "dsdb-resource")
        .otherwise("unknown-json-resource")
    )


def resource_name(path: Column, payload: Column, kind: Column) -> Column:
    """Name of a captured resource: five places in the payload, then its URL."""
    direct = [F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")) for p in ("$.resourceName", "$.name", "$.id", "$.resource.name", "$.metadata.resourceName")]
    last = F.element_at(F.filter(F.split(path, "/"), lambda x: x != ""), -1)
    table = F.nullif(F.regexp_extract(path, r"(?i)TOKEN_TABLE\.([^/.]+)\.json$", 1), F.lit(""))
    return F.when(~kind.isin("page-metadata", "content-page"), F.coalesce(*direct, F.when(kind == "token-table", table), last, path))


#: Signs of a page that was not found, and of filler text.
NOT_FOUND_TITLE = r"(?i)\b(page cannot be found|this page cannot be found|page not found|404)\b"
NOT_FOUND_BODY = r"(?i)\b(this page cannot be found|page cannot be found|page not found|requested page was not found|could not find (that|this) page|try a different destination|head back to the homepage)\b"
PLACEHOLDER = r"(?i)\[(?:unresolved|missing|unknown)[^\]]*\]|Unsupported Material chunk|Material resource placeholder"


def not_found(title: Column, body: Column) -> Column:
    return title.rlike(NOT_FOUND_TITLE) | F.substring(body, 1, 800).rlike(NOT_FOUND_BODY)


def fallback_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds; null if none does."""
    out = F.when(checks[0][0], checks[0][1])
    for check, reason in checks[1:]:
        out = out.when(check, reason)
    return out


def placeholders(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)))


def title_mismatch(path: Column, title: Column) -> Column:
    """Whether a component page's title lacks a word of the component's slug."""
    slug = F.regexp_extract(F.regexp_replace(path, "^/+", ""), r"^components/+([^/]+)", 1)
    words = F.filter(F.split(slug, "-"), lambda w: F.length(w) > 1)
    return F.exists(words, lambda w: ~F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " ").contains(w))

"""Queries over pages and documents: paths, headings, links, search, duplicates, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, paths, text
from ..operators import quality, search, segments
from ..sources.tables import Written, table

_STRIP = lambda x: f"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({x}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'), chr(32) || chr(9) || chr(13) || chr(10))"""  # noqa: E731, E501
_TITLE = f"CASE WHEN {_STRIP("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} <> '' THEN {_STRIP("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} ELSE {_STRIP("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} END"
_PATH = "CASE WHEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)', 2) = '' THEN '/' ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)', 2) END"
_ORIGIN = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"
_BARE = f"regexp_replace({_PATH}, '^/+|/+$', '', 'g')"
_MD = f"(CASE WHEN {_BARE} = '' THEN 'index' ELSE {_BARE} END || '.md')"
_SECTION = f"CASE WHEN contains(regexp_replace({_MD}, '\\.md$', ''), '/') THEN regexp_replace(regexp_replace({_MD}, '\\.md$', ''), '/[^/]*$', '') ELSE 'root' END"
_NORM = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' ')"
_COLLAPSE = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ')"
_PRIORITY = lambda p: f"""CASE WHEN {p} = '/' THEN 1
  WHEN starts_with({p}, '/components') OR starts_with({p}, '/styles') OR starts_with({p}, '/foundations') THEN 1
  WHEN starts_with({p}, '/develop') OR starts_with({p}, '/get-started') OR starts_with({p}, '/designing') THEN 2
  WHEN starts_with({p}, '/resources') OR starts_with({p}, '/templates') OR starts_with({p}, '/case-studies') THEN 3
  WHEN starts_with({p}, '/blog') OR starts_with({p}, '/articles') OR starts_with({p}, '/news') OR regexp_matches({p}, '^/20\\d\\d(/|$)') THEN 4 ELSE 5 END"""  # noqa: E731


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", paths.normalize_url(url, url).alias("normalized"), paths.doc_path(url, url).alias("doc_path"), paths.page_id(url).alias("id"))


def page_path_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = paths.page_path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), paths.section(path).alias("section"), paths.graph_route(F.col("url")).alias("route"), paths.markdown_path(F.col("url")).alias("markdown_path"))


def html_title_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.html_title(html).alias("title"), F.array_join(text.html_headings(html), "\n").alias("headings"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(text.html_links(F.col("html"))).alias("pos", "href"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "href", paths.normalize_url(F.col("href"), F.col("url")).alias("target"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(text.html_heading_levels(F.col("html"))).alias("h"))
    return found.groupBy("page_id", F.col("h.level").cast("long").alias("level")).agg(F.count("*").alias("n"), F.min("h.text").alias("first_text"))


def pages_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(paths.section(paths.page_path(F.col("url"))).alias("section")).agg(F.count("*").alias("n"))


def route_priority_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty first routes of the crawl order: a top-k report."""
    path = paths.url_path(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("route"), classify.priority(path).cast("long").alias("tier"), classify.is_blog(path).alias("is_blog"))
    return rows.orderBy("tier", "route", "page_id").limit(50)


#: Payload shapes of captured responses, one for each class that a shape decides.
SHAPES = ('{"system": {"tokenSets": []}}', '{"rows": [1]}', '{"content": {"sections": []}}', '{"title": "t", "contentBlocks": []}', '{"pathname": "/p"}', '{"resourceName": " r "}', '{"component": {"a": 1}, "id": "i7"}')


def classify_url_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured responses classed by shape, then by path: an event's number says which payload it has, seven shapes or its own JSON."""
    url = F.concat(F.lit("/_dsm/data/dsdb-m3/"), F.col("event_type"), F.when(F.col("event_id") % 3 == 0, F.lit("/TOKEN_TABLE.x.json")).when(F.col("event_id") % 3 == 1, F.lit("/a.json")).otherwise(F.lit("/b")))
    number = (F.get_json_object("props", "$.k").cast("int") % 10 + 1).cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", url.alias("path"), F.coalesce(F.get(F.array(*map(F.lit, SHAPES)), number - 1), "props").alias("payload"))
    rows = rows.withColumn("kind", classify.response_type(F.col("path"), F.try_parse_json("payload")))
    return rows.select("event_id", "kind", classify.resource_name(F.col("path"), F.col("payload"), F.col("kind")).alias("name"))


def json_path_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.coalesce(*(F.nullif(F.trim(F.get_json_object("props", p)), F.lit("")) for p in ("$.result.id", "$.id", "$.k")))
    return table(spark, sf_dir, "events").select("event_id", paths.text_id(first).alias("id"))


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.match_text(own), 256).alias("match_sha"), F.sha2(text.search_text(own), 256).alias("search_sha"), F.length(text.search_text(own)).cast("long").alias("n"))


def structured_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the query within a row's normalised text; kinds in order, first fifty: a capped search."""
    return search.structured(search_rows(spark, sf_dir), "the tion", 50).select("kind", "id", "label")


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    parts = [
        ("route", pages, "page_id", F.col("url")),
        ("page", pages, "page_id", text.html_title(F.col("html"))),
        ("document", table(spark, sf_dir, "documents"), "doc_id", F.col("text")),
        ("item", table(spark, sf_dir, "benchmark"), "item_id", F.col("text")),
    ]
    out = None
    for ord_, (kind, rows, key, label) in enumerate(parts):
        own = rows.select(F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), label.alias("label"))
        out = own if out is None else out.unionByName(own)
    return out


def structured_search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(search_rows(spark, sf_dir), "in").groupBy("kind").agg(F.count("*").alias("n"))


def fulltext_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 in whole thousandths of all documents that a three-word query reaches, by prefix and typos."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return search.full_text(docs, ["worthless", "idiot", "nicht"]).select(F.col("id").alias("doc_id"), F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score_milli"), F.col("terms").alias("n_terms"))


def fulltext_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search of an index that was made of most documents, some of them other than now, and then brought up to date."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    before = docs.where(F.col("id") % 50 != 7).withColumn("body", F.when(F.col("id") % 97 == 3, F.concat(F.lit("worthless draft "), "body")).otherwise(F.col("body")))
    index = segments.open_index(spark, Written(spark, "grown").folder).update(before, ["body"]).update(docs, ["body"])
    return index.search(["worthless", "idiot", "nicht"]).select(F.col("id").alias("doc_id"), F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score_milli"), F.col("terms").alias("n_terms"))


def fulltext_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over title, section, headings and body of all pages, summed over the fields."""
    path = paths.url_path(F.col("url"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.html_title(F.col("html")).alias("title"), F.regexp_extract(path, "^/([^/]*)", 1).alias("section"), F.array_join(text.html_headings(F.col("html")), "\n").alias("headings"), F.col("html").alias("body"))
    found = search.full_text(pages, ["example", "tion", "href"], ("title", "section", "headings", "body"))
    return found.select(F.col("id").alias("page_id"), F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score_milli"), F.col("terms").alias("n_terms"))


def prefix_fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    written = Written(spark, "vocabulary")
    terms = written.keep(search.vocabulary(docs).repartitionByRange("term").sortWithinPartitions("term"), "terms")
    by_piece = written.keep(search.pieces(terms), "pieces")
    return search.expanded(terms, ["idiot", "clown", "worthless"], by_piece).select("query_term", "term", "weight_milli")


def search_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text"), "is worthless").alias("excerpt"))


def page_lookup_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that answer to another page's keys: looked up by key equality, the first page each."""
    pages = table(spark, sf_dir, "pages").select("page_id", paths.lookup_keys(paths.url_path(F.col("url"))).alias("keys"))
    return search.first_by_key(pages, "page_id", "keys").select("key", F.col("page_id").alias("page_id"))


def component_docs_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    token = F.element_at(F.split(paths.component_lookup(name), "-"), 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", paths.component_lookup(name).alias("lookup"), paths.component_slug(name).alias("slug"), F.array_join(paths.singular_forms(token), ",").alias("forms"))
    return rows.withColumn("matches", F.col("lookup").contains("a") | F.col("slug").contains("red"))


def list_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.regexp_extract("p_type", r"^([^ ]+)", 1).alias("component"), "p_partkey", "p_name")
    return rows.where("component <> ''").groupBy("component").agg(F.min_by("p_name", "p_partkey").alias("name"), F.min("p_partkey").alias("p_partkey"))


def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text"), F.col("text").alias("markdown"), F.col("source").alias("title"), F.col("doc_id").cast("string").alias("path"))
    return quality.duplicate_content(docs).select("hash", "n", "title", "path")


def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), text.html_title(F.col("html")).alias("title"), F.col("url").alias("path"))
    return quality.duplicate_titles(pages).select("key", "n", "title", "path")


def short_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.short_pages(table(spark, sf_dir, "documents"), F.col("text")).select("doc_id", F.length("text").cast("long").alias("n"))


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text", F.col("text").alias("markdown"), F.col("source").alias("title"), F.col("doc_id").cast("string").alias("path"))
    return quality.summary(docs, F.lit(160))


def not_found_and_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring("text", 1, 60)
    return table(spark, sf_dir, "documents").select("doc_id", classify.not_found(title, F.col("text")).alias("not_found"), classify.placeholders(F.col("text")).cast("long").alias("placeholders"))


def extraction_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    lines = F.size(F.split("text", "\n"))
    facts = docs.select(
        "doc_id",
        (F.length("text") > 20).alias("has_title"),
        (lines > 1).alias("has_sections"),
        lines.alias("headings"),
        F.length("text").alias("text_length"),
        F.length("text").alias("markdown_length"),
        F.lit(0).alias("media"),
        F.coalesce("quality", F.lit(0)).alias("token_tables"),
        F.coalesce("quality", F.lit(0)).alias("token_tables_rendered"),
        F.lit(0).alias("status_tables"),
        F.lit(0).alias("unknown_chunks"),
        F.lit(0).alias("unknown_resources"),
        F.coalesce("toxic", F.lit(0)).alias("unresolved"),
        F.lit(0).alias("missing_sets"),
        F.lit(False).alias("mismatch"),
        classify.placeholders(F.col("text")).alias("placeholders"),
    )
    return quality.scored(facts).select("doc_id", F.col("score").cast("long").alias("score"), "reason", "accepted")


def spec_pages_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = paths.graph_route(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", route.alias("route"), (F.length("html") > 3000).alias("has_page"))
    return quality.spec_pages(rows, r"/\d+$")


_BM25 = rf"""WITH q AS (SELECT unnest(['worthless', 'idiot', 'nicht']) AS query_term),
t AS (SELECT doc_id, unnest(string_split(n, ' ')) AS term FROM (SELECT doc_id, {_NORM('text')} AS n FROM documents) WHERE n <> ''),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) * 1.0 / (SELECT count(*) FROM documents) AS avgdl),
v AS (SELECT DISTINCT term FROM tf),
x AS (SELECT query_term, term, CASE WHEN term = query_term THEN 1000 WHEN starts_with(term, query_term) THEN 375 ELSE 450 END AS w FROM q JOIN v ON starts_with(term, query_term)
  OR (abs(length(term) - length(query_term)) <= floor(0.2 * length(query_term) + 0.5) AND levenshtein(term, query_term) <= floor(0.2 * length(query_term) + 0.5))),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, floor(sum(w / 1000.0 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * 1000 + 0.5)::BIGINT AS score_milli, count(*) AS n_terms
FROM x JOIN tf USING (term) JOIN dfs USING (term) JOIN dl USING (doc_id), st GROUP BY doc_id"""

QUERIES = {
    "url_normalize": (url_normalize, rf"""SELECT page_id,
  CASE WHEN NOT regexp_matches({_PATH}, '(?i)\.(png|jpg|jpeg|gif|webp|svg|ico|pdf|zip|xml|json|txt)$') THEN regexp_replace({_ORIGIN} || {_PATH}, '/$', '') END AS normalized,
  CASE WHEN NOT regexp_matches({_PATH}, '(?i)\.(png|jpg|jpeg|gif|webp|svg|ico|pdf|zip|xml|json|txt)$')
    AND NOT regexp_matches(regexp_replace({_PATH}, '^/+', ''), '^(assets/|static/|_dsm/|m3/pages/|favicon|manifest|robots\.txt|sitemap)')
    THEN CASE WHEN regexp_replace({_PATH}, '/+', '/', 'g') = '/' THEN '/' ELSE regexp_replace(regexp_replace({_PATH}, '/+', '/', 'g'), '/$', '') END END AS doc_path,
  substr(sha256(url), 1, 16) AS id FROM pages"""),
    "page_path_section": (page_path_section, rf"""SELECT page_id, {_MD} AS path, {_SECTION} AS section,
  CASE WHEN b IN ('', 'index') THEN '/' ELSE '/' || b END AS route, CASE WHEN b IN ('', 'index') THEN 'index.md' ELSE b || '.md' END AS markdown_path
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PATH}, '(?i)^pages/', ''), '[\\/]+', '/', 'g'), '(?i)\.md$', ''), '^/+|/+$', '', 'g') AS b FROM pages)"""),
    "html_title_headings": (html_title_headings, rf"""SELECT page_id, {_TITLE} AS title,
  array_to_string(list_filter([{_STRIP('h')} FOR h IN regexp_extract_all(html, '(?is)<h[1-4][^>]*>(.*?)</h[1-4]>', 1)], lambda h: h <> ''), chr(10)) AS headings FROM pages"""),
    "html_links": (html_links, rf"""SELECT page_id, (i - 1)::BIGINT AS pos, l[i] AS href,
  CASE WHEN regexp_matches(l[i], '^/[^/]') AND NOT regexp_matches(l[i], '(?i)\.(png|jpg|jpeg|gif|webp|svg|ico|pdf|zip|xml|json|txt)([?#]|$)') THEN regexp_replace({_ORIGIN} || regexp_replace(l[i], '[?#].*$', ''), '/$', '')
    WHEN l[i] = '/' THEN {_ORIGIN} END AS target
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1) AS l FROM pages), unnest(range(1, len(l) + 1)) AS t(i)"""),
    "heading_levels": (heading_levels, " UNION ALL ".join(rf"""SELECT page_id, {n}::BIGINT AS level, count(*) AS n, min(h) AS first_text FROM (SELECT page_id, unnest([{_STRIP('x')} FOR x IN regexp_extract_all(html, '(?is)<h{n}[^>]*>(.*?)</h{n}>', 1)]) AS h FROM pages) GROUP BY page_id""" for n in range(1, 7))),
    "pages_by_section": (pages_by_section, f"SELECT {_SECTION} AS section, count(*) AS n FROM pages GROUP BY 1"),
    "route_priority_topk": (route_priority_topk, rf"""SELECT page_id, route, ({_PRIORITY('p')})::BIGINT AS tier,
  starts_with(p, '/blog') OR starts_with(p, '/articles') OR starts_with(p, '/news') OR regexp_matches(p, '^/20\d\d(/|$)') AS is_blog
  FROM (SELECT page_id, {_PATH} AS route, '/' || regexp_replace({_PATH}, '^/+', '') AS p FROM pages) ORDER BY tier, route, page_id LIMIT 50"""),
    "classify_url_payload": (classify_url_payload, """WITH e AS (SELECT event_id, (props->>'$.k')::INT % 10 AS s, event_id % 3 AS p FROM events),
k AS (SELECT *, CASE WHEN s = 0 THEN 'token-table' WHEN s = 1 THEN 'status-table' WHEN s IN (2, 3) THEN 'content-page' WHEN s = 4 THEN 'page-metadata' WHEN s IN (5, 6) THEN 'dsdb-resource' WHEN p = 0 THEN 'token-table' WHEN p = 1 THEN 'dsdb-resource' ELSE 'unknown-json-resource' END AS kind FROM e)
SELECT event_id, kind, CASE WHEN kind IN ('content-page', 'page-metadata') THEN NULL WHEN s = 5 THEN 'r' WHEN s = 6 THEN 'i7' WHEN kind = 'token-table' AND p = 0 THEN 'x' ELSE ['TOKEN_TABLE.x.json', 'a.json', 'b'][p + 1] END AS name FROM k"""),
    "json_path_coalesce": (json_path_coalesce, "SELECT event_id, nullif(trim(coalesce(props->>'$.result.id', props->>'$.id', props->>'$.k')), '') AS id FROM events"),
    "text_normalize": (text_normalize, rf"""SELECT doc_id, sha256({_COLLAPSE(r"regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')")}) AS match_sha,
  sha256({_NORM('text')}) AS search_sha, length({_NORM('text')})::BIGINT AS n FROM documents"""),
    "structured_search": (structured_search, f"""SELECT kind, id, label FROM (
  SELECT 0 AS ord, 'route' AS kind, page_id AS id, url AS label FROM pages UNION ALL SELECT 1, 'page', page_id, {_TITLE} FROM pages
  UNION ALL SELECT 2, 'document', doc_id, text FROM documents UNION ALL SELECT 3, 'item', item_id, text FROM benchmark)
  WHERE contains({_NORM('label')}, 'the') AND contains({_NORM('label')}, 'tion') ORDER BY ord, id LIMIT 50"""),
    "structured_search_counts": (structured_search_counts, f"""SELECT kind, count(*) AS n FROM (
  SELECT 'route' AS kind, url AS label FROM pages UNION ALL SELECT 'page', {_TITLE} FROM pages
  UNION ALL SELECT 'document', text FROM documents UNION ALL SELECT 'item', text FROM benchmark) WHERE contains({_NORM('label')}, 'in') GROUP BY kind"""),
    "fulltext_bm25": (fulltext_bm25, _BM25),
    "fulltext_grown": (fulltext_grown, _BM25),
    "fulltext_fields": (fulltext_fields, rf"""WITH q AS (SELECT unnest(['example', 'tion', 'href']) AS query_term),
f AS (SELECT page_id, 'title' AS field, {_TITLE} AS t FROM pages UNION ALL SELECT page_id, 'section', regexp_extract({_PATH}, '^/([^/]*)', 1) FROM pages UNION ALL SELECT page_id, 'headings', {_TITLE} FROM pages UNION ALL SELECT page_id, 'body', html FROM pages),
t AS (SELECT page_id, field, unnest(string_split(n, ' ')) AS term FROM (SELECT page_id, field, {_NORM('t')} AS n FROM f) WHERE n <> ''),
tf AS (SELECT page_id, field, term, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT page_id, field, sum(tf) AS dl FROM tf GROUP BY ALL),
st AS (SELECT field, (SELECT count(*) FROM pages) AS n, sum(dl) * 1.0 / (SELECT count(*) FROM pages) AS avgdl FROM dl GROUP BY 1),
v AS (SELECT term, field, count(*) AS df FROM tf GROUP BY ALL),
x AS (SELECT query_term, term, field, df, CASE WHEN term = query_term THEN 1000 WHEN starts_with(term, query_term) THEN 375 ELSE 450 END AS w FROM q JOIN v ON starts_with(term, query_term)
  OR (abs(length(term) - length(query_term)) <= floor(0.2 * length(query_term) + 0.5) AND levenshtein(term, query_term) <= floor(0.2 * length(query_term) + 0.5)))
SELECT page_id, floor(sum(w / 1000.0 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * 1000 + 0.5)::BIGINT AS score_milli, count(*) AS n_terms
FROM x JOIN tf USING (term, field) JOIN dl USING (page_id, field) JOIN st USING (field) GROUP BY page_id"""),
    "prefix_fuzzy_terms": (prefix_fuzzy_terms, rf"""WITH q AS (SELECT unnest(['idiot', 'clown', 'worthless']) AS query_term),
v AS (SELECT DISTINCT unnest(string_split(n, ' ')) AS term FROM (SELECT {_NORM('text')} AS n FROM documents) WHERE n <> '')
SELECT query_term, term, (CASE WHEN term = query_term THEN 1000 WHEN starts_with(term, query_term) THEN 375 ELSE 450 END)::BIGINT AS weight_milli FROM q JOIN v
ON starts_with(term, query_term) OR (abs(length(term) - length(query_term)) <= floor(0.2 * length(query_term) + 0.5) AND levenshtein(term, query_term) <= floor(0.2 * length(query_term) + 0.5))"""),
    "search_excerpt": (search_excerpt, rf"""SELECT doc_id, trim(regexp_replace(substr(text, greatest(0, instr(lower(text), 'worthless') - 181) + 1, 500), '\s+', ' ', 'g'), ' ') AS excerpt FROM documents"""),
    "page_lookup_alias": (page_lookup_alias, rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PATH}, '(?i)^pages/', ''), '[\\/]+', '/', 'g'), '(?i)\.md$', ''), '^/+|/+$', '', 'g') AS k0 FROM pages),
c AS (SELECT page_id, CASE WHEN k0 = 'index' THEN '' ELSE k0 END AS k FROM b),
r AS (SELECT page_id, k, regexp_replace(k, '/?overview$', '') AS root FROM c)
SELECT key, min(page_id) AS page_id FROM (SELECT page_id, unnest([k, root, CASE WHEN root = '' THEN 'overview' ELSE root || '/overview' END]) AS key FROM r) GROUP BY key"""),
    "component_docs_match": (component_docs_match, r"""WITH x AS (SELECT p_partkey, regexp_replace(regexp_replace(replace(lower(trim(p_name)), 'overview', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS lookup,
  regexp_replace(regexp_replace(lower(trim(p_name)), '\s+', '-', 'g'), '[^a-z0-9-]', '', 'g') AS slug FROM part), t AS (SELECT *, string_split(lookup, '-')[1] AS k FROM x)
SELECT p_partkey, lookup, slug, k || CASE WHEN k LIKE '%ies' AND length(k) > 3 THEN ',' || substr(k, 1, length(k) - 3) || 'y' ELSE '' END
  || CASE WHEN k LIKE '%es' AND length(k) > 3 THEN ',' || substr(k, 1, length(k) - 2) ELSE '' END || CASE WHEN k LIKE '%s' AND length(k) > 2 THEN ',' || substr(k, 1, length(k) - 1) ELSE '' END AS forms,
  contains(lookup, 'a') OR contains(slug, 'red') AS matches FROM t"""),
    "list_components": (list_components, "SELECT regexp_extract(p_type, '^([^ ]+)', 1) AS component, arg_min(p_name, p_partkey) AS name, min(p_partkey) AS p_partkey FROM part WHERE regexp_extract(p_type, '^([^ ]+)', 1) <> '' GROUP BY 1"),
    "duplicate_content": (duplicate_content, rf"""WITH d AS (SELECT substr(sha256({_COLLAPSE(r"regexp_replace(text, '(?s)^---.*?---', '')")}), 1, 16) AS hash, source, doc_id FROM documents WHERE length(text) >= 160),
  g AS (SELECT hash, count(*) AS n, arg_min(source, doc_id) AS title FROM d GROUP BY 1 HAVING count(*) > 1) SELECT hash, n, title, doc_id::VARCHAR AS path FROM d JOIN g USING (hash)"""),
    "duplicate_titles": (duplicate_titles, rf"""WITH d AS (SELECT {_COLLAPSE(r"regexp_replace(replace(lower(t), '&', ' and '), '[^a-z0-9]+', ' ', 'g')")} AS key, t, page_id, url FROM (SELECT page_id, url, {_TITLE} AS t FROM pages)),
  g AS (SELECT key, count(*) AS n, arg_min(t, page_id) AS title FROM d GROUP BY 1 HAVING count(*) > 1 AND key <> '') SELECT key, n, title, url AS path FROM d JOIN g USING (key)"""),
    "short_documents": (short_documents, "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) < 160"),
    "quality_summary": (quality_summary, rf"""WITH g AS (SELECT substr(sha256({_COLLAPSE(r"regexp_replace(text, '(?s)^---.*?---', '')")}), 1, 16) AS h, count(*) AS n FROM documents WHERE length(text) >= 160 GROUP BY 1 HAVING count(*) > 1),
t AS (SELECT {_COLLAPSE(r"regexp_replace(replace(lower(source), '&', ' and '), '[^a-z0-9]+', ' ', 'g')")} AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 AND k <> '')
SELECT (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM documents WHERE length(text) < 160) AS short_pages, (SELECT count(*) FROM g) AS duplicate_groups,
  (SELECT coalesce(sum(n), 0) FROM g)::BIGINT AS duplicate_pages, (SELECT count(*) FROM t) AS duplicate_titles"""),
    "not_found_and_placeholder": (not_found_and_placeholder, r"""SELECT doc_id, regexp_matches(substr(text, 1, 60), '(?i)\b(page cannot be found|this page cannot be found|page not found|404)\b') OR
  regexp_matches(substr(text, 1, 800), '(?i)\b(this page cannot be found|page cannot be found|page not found|requested page was not found|could not find (that|this) page|try a different destination|head back to the homepage)\b') AS not_found,
  len(regexp_extract_all(text, '(?i)\[(?:unresolved|missing|unknown)[^\]]*\]|Unsupported Material chunk|Material resource placeholder'))::BIGINT AS placeholders FROM documents"""),
    "extraction_score": (extraction_score, r"""WITH x AS (SELECT doc_id, length(text) AS n, len(string_split(text, chr(10))) AS l, coalesce(quality, 0) AS q, coalesce(toxic, 0) AS t,
  len(regexp_extract_all(text, '(?i)\[(?:unresolved|missing|unknown)[^\]]*\]|Unsupported Material chunk|Material resource placeholder')) AS p FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT *, (CASE WHEN n > 20 THEN 2 ELSE 0 END + CASE WHEN l > 1 THEN 2 ELSE 0 END + CASE WHEN l > 0 THEN 1 ELSE 0 END + CASE WHEN n >= 80 THEN 2 ELSE 0 END + CASE WHEN l >= 2 THEN 1 ELSE 0 END + 1
  - t - CASE WHEN n < 80 THEN 1 ELSE 0 END - CASE WHEN p >= 3 THEN 2 ELSE 0 END)::BIGINT AS score FROM x),
r AS (SELECT *, CASE WHEN NOT n > 20 THEN 'json-title-missing' WHEN NOT l > 1 THEN 'json-no-sections' WHEN l = 0 THEN 'json-no-headings' WHEN n < 80 THEN 'json-short-markdown' WHEN score < 4 THEN 'json-low-quality' END AS reason FROM s)
SELECT doc_id, score, reason, reason IS NULL AS accepted FROM r"""),
    "spec_pages_summary": (spec_pages_summary, rf"""SELECT count(*) AS routes, count(*) FILTER (regexp_matches(r, '/\d+$')) AS spec_routes, count(*) FILTER (regexp_matches(r, '/\d+$') AND h) AS spec_with_page,
  count(*) FILTER (regexp_matches(r, '/\d+$') AND NOT h) AS spec_missing_page, count(*) FILTER (regexp_matches(r, '/\d+$') AND starts_with(r, '/components/')) AS component_spec_routes FROM (
  SELECT CASE WHEN b IN ('', 'index') THEN '/' ELSE '/' || b END AS r, h FROM (SELECT length(html) > 3000 AS h, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PATH}, '(?i)^pages/', ''), '[\\/]+', '/', 'g'), '(?i)\.md$', ''), '^/+|/+$', '', 'g') AS b FROM pages))"""),
}

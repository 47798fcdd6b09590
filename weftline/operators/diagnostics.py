"""Page, section and resource graphs from what an extraction run noted about its pages.

A note on a page (one row of page diagnostics) has lists and counters: headings are those of
the page, token tables and status tables have names, placeholders have reasons, images and
videos are only counted. Each kind is a generator of chunks whose ids are made of the
kind and the place in its list, so the same note always gives the same ids. The
generators of GENERATORS run in this order, and a chunk's order is (generator, place).

Expected columns:

* pages: page_id, path, title, section, headings
* page diagnostics: path, seq, token_tables and status_tables (arrays of structs with ``name``,
  those of status tables also with ``rendered`` and ``unsupported``), placeholders (reasons),
  images, videos (counts), unknown_chunks, unknown_resources (types)
* route diagnostics: path, seq, source_route, normalized_route, virtual_route,
  canonical_route, tab, tab_section
* artifacts: id, kind, seq, source_route, local_path
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import graph_route, resource_basename
from .graph import last_rows

#: Kinds of artifacts that a graph refers to, and the kind that holds resources.
REFERRED = ("page-data", "carbon-content", "dsdb-resource", "network-capture")
RESOURCE_KIND = "dsdb-resource"
CHUNK = "struct<chunk_id:string,chunk_type:string,resource_id:string,excerpt:string>"
_TEXTS = "array<string>"


def _filled(value: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(value, F.lit(""))


def _place(i: Column) -> Column:
    return i.cast("string")


def _id(kind: str, path: Column, i: Column, infix: str = "") -> Column:
    return F.concat(F.lit(f"{kind}:"), path, F.lit(f":{infix}"), _place(i))


def _counted(n: str) -> Column:
    """Places 0 to n - 1."""
    return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _listed(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(_TEXTS))


#: What each generator lists, the kind and the id of the resource of an item (path, item, place), and the chunk's id and label.
_OWN_ID: dict[str, Callable[[Column, Column, Column], Column]] = {
    "token_table": lambda path, x, i: F.coalesce(F.concat(F.lit("token-table:"), _filled(x["name"])), _id("token-table", path, i)),
    "placeholder": lambda path, x, i: _id("token-table", path, i, "placeholder:"),
    "status_table": lambda path, x, i: F.coalesce(F.concat(F.lit("status-table:"), _filled(x["name"])), _id("status-table", path, i)),
    "image": lambda path, x, i: _id("image", path, i),
    "video": lambda path, x, i: _id("video", path, i),
    "unknown": lambda path, x, i: _id("unknown-resource", path, i),
}


def _chunk(chunk_id: Column, kind: str, resource: Column | None, excerpt: Column | None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(chunk_id.alias("chunk_id"), F.lit(kind).alias("chunk_type"), (none if resource is None else resource).alias("resource_id"), (none if excerpt is None else excerpt).alias("excerpt"))


def heading_chunks(headings: Column) -> Column:
    return F.transform(headings, lambda t, i: _chunk(F.concat(F.lit("chunk-"), _place(i), F.lit("-text")), "text", None, t))


def resource_chunks(path: Column) -> Column:
    """Chunks of the note on a page, by generator and place; none without a note."""
    of = lambda name: lambda x, i: F.concat(F.lit(f"chunk-{name}-"), _place(i))
    parts = [
        F.transform("token_tables", lambda x, i: _chunk(of("token-table")(x, i), "resource", _OWN_ID["token_table"](path, x, i), F.coalesce(x["name"], F.lit("token table")))),
        F.transform("placeholders", lambda x, i: _chunk(of("token-table-placeholder")(x, i), "resource", _OWN_ID["placeholder"](path, x, i), F.concat(F.lit("token table ("), x, F.lit(")")))),
        F.transform("status_tables", lambda x, i: _chunk(of("status-table")(x, i), "resource", _OWN_ID["status_table"](path, x, i), F.coalesce(x["name"], F.lit("status table")))),
        F.transform(_counted("images"), lambda i: _chunk(of("image")(i, i), "image", _OWN_ID["image"](path, i, i), None)),
        F.transform(_counted("videos"), lambda i: _chunk(of("video")(i, i), "video", _OWN_ID["video"](path, i, i), None)),
        F.transform("unknown_chunks", lambda x, i: _chunk(of("unsupported")(x, i), "unsupported", _OWN_ID["unknown"](path, x, i), x)),
    ]
    none = F.array().cast(f"array<{CHUNK}>")
    return F.concat(*[F.coalesce(p, none) for p in parts])


def routed_pages(pages: DataFrame, route_notes: DataFrame) -> DataFrame:
    """pages with the last note on their route, and artifact_route, which is made once for each note and not each page."""
    routed = last_rows(route_notes, ["path"], "seq").drop("seq").withColumn("noted_route", graph_route(F.coalesce("source_route", "normalized_route")))
    return pages.join(routed, "path", "left").withColumn("artifact_route", F.coalesce("noted_route", graph_route(F.col("path")))).drop("noted_route")


def page_graph(pages: DataFrame, page_notes: DataFrame, route_notes: DataFrame) -> DataFrame:
    """One node for each page, with the last note on its path and the last one on its route.

    Columns: page_id, path, route, title, section, tab (struct or null), headings, sections,
    chunks, resource_ids, token_table_ids, unsupported, source_route, canonical_route,
    virtual_route, and artifact_route, by which ``page_artifacts`` finds what it was made of.
    A node's lists are those of its own page and note.
    """
    noted = last_rows(page_notes, ["path"], "seq").drop("seq")
    rows = routed_pages(pages.join(noted, "path", "left"), route_notes)
    rows = rows.withColumn("route", graph_route(F.coalesce("virtual_route", "artifact_route")))
    headings = _listed("headings")
    sections = F.transform(headings, lambda t, i: F.struct(
        F.concat(F.lit("section-"), _place(i)).alias("section_id"), t.alias("title"), F.when(i == 0, 1).otherwise(2).alias("heading_level"),
        F.array(F.concat(F.lit("chunk-"), _place(i), F.lit("-text"))).alias("chunk_ids"),
    ))
    rows = rows.withColumn("noted", resource_chunks(F.col("path")))
    ids = F.array_distinct(F.array_compact(F.transform("noted", lambda c: c["resource_id"])))
    tab = F.when(_filled(F.col("tab")).isNotNull(), F.struct(F.col("tab").alias("label"), F.coalesce("virtual_route", "route").alias("route"), F.col("tab_section").alias("section_index")))
    known = lambda c: graph_route(_filled(F.col(c))).alias(c)
    return rows.select(
        "page_id", "path", "route", "title", "section", tab.alias("tab"), headings.alias("headings"), sections.alias("sections"),
        F.concat(heading_chunks(headings), F.col("noted")).alias("chunks"), ids.alias("resource_ids"),
        F.filter(ids, lambda x: x.startswith("token-table:")).alias("token_table_ids"), _listed("unknown_chunks").alias("unsupported"),
        known("source_route"), known("canonical_route"), known("virtual_route"), "artifact_route",
    )


def section_graph(nodes: DataFrame) -> DataFrame:
    """Sections of page_graph() as rows: section_id (with its page's), page_id, route, title, heading_level, chunk_ids."""
    rows = nodes.select("page_id", "route", F.explode("sections").alias("s"))
    return rows.select(F.concat(F.col("page_id").cast("string"), F.lit(":"), "s.section_id").alias("section_id"), "page_id", "route", "s.title", "s.heading_level", "s.chunk_ids")


def chunk_rows(nodes: DataFrame) -> DataFrame:
    """Chunks of page_graph() as rows, each with its place in the page."""
    return nodes.select("page_id", "route", F.posexplode("chunks").alias("place", "c")).select("page_id", "route", "place", "c.*")


def _referred(artifacts: DataFrame) -> DataFrame:
    return artifacts.where(F.col("kind").isin(*REFERRED)).select(F.col("id").alias("artifact_id"), "kind", "seq", graph_route(_filled(F.col("source_route"))).alias("artifact_route"))


def page_artifacts(nodes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(page_id, artifact_id, kind, seq): what each page of page_graph() or routed_pages() was made of, a row each, however many a route has."""
    return nodes.select("page_id", "artifact_route").join(_referred(artifacts), "artifact_route").select("page_id", "artifact_id", "kind", "seq")


def page_artifact_counts(nodes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(page_id, kind, artifacts, first): page_artifacts() counted by kind, and the first of them by seq.

    Pages of one route have the same artifacts, so these are counted by route before pages
    meet them: a page joins a row for each kind, not each artifact.
    """
    own = _referred(artifacts).groupBy("artifact_route", "kind").agg(F.count("*").alias("artifacts"), F.min_by("artifact_id", "seq").alias("first"), F.min("seq").alias("seq"))
    rows = nodes.select("page_id", "artifact_route").join(own, "artifact_route")
    return rows.groupBy("page_id", "kind").agg(F.sum("artifacts").alias("artifacts"), F.min_by("first", "seq").alias("first"))


#: Order of the generators among the uses of a note.
GENERATORS = ("token_table", "placeholder", "status_table", "image", "video", "unknown")


def resource_uses(page_notes: DataFrame, route_notes: DataFrame) -> DataFrame:
    """Every use of a resource by a note: resource_id, ord, kind, name, status, reason, route, chunk_id.

    ``ord`` is (seq, generator, place), so uses have one order whatever partition they are in.
    The route is that of the last note on the path; all notes on a path count.
    """
    route = graph_route(_filled(F.coalesce("virtual_route", "canonical_route", "source_route", "normalized_route")))
    routed = last_rows(route_notes, ["path"], "seq").select("path", route.alias("route"))
    path, none = F.col("path"), F.lit(None).cast("string")

    def use(g: str, kind: str, x: Column, i: Column, name: Column, bad: Column, reason: Column, chunk: str) -> Column:
        return F.struct(
            _OWN_ID[g](path, x, i).alias("resource_id"), F.lit(GENERATORS.index(g)).alias("generator"), i.cast("int").alias("place"), F.lit(kind).alias("kind"), name.alias("name"),
            F.when(bad, "unresolved").otherwise("resolved").alias("status"), F.when(bad, reason).alias("reason"), F.concat(F.lit(f"chunk-{chunk}-"), _place(i)).alias("chunk_id"),
        )

    yes, no = F.lit(True), F.lit(False)
    lost = lambda x: ~F.coalesce(x["rendered"], no)
    why = lambda x: F.when(F.coalesce(x["unsupported"], no), "unsupported-status-table-schema").otherwise("missing-status-table-resource")
    parts = [
        F.transform("token_tables", lambda x, i: use("token_table", "token-table", x, i, x["name"], no, none, "token-table")),
        F.transform("placeholders", lambda x, i: use("placeholder", "token-table", x, i, none, yes, x, "token-table-placeholder")),
        F.transform("status_tables", lambda x, i: use("status_table", "status-table", x, i, x["name"], lost(x), why(x), "status-table")),
        F.transform(_counted("images"), lambda i: use("image", "image", i, i, none, no, none, "image")),
        F.transform(_counted("videos"), lambda i: use("video", "video", i, i, none, no, none, "video")),
        F.transform("unknown_resources", lambda x, i: use("unknown", "unknown-resource", x, i, x, yes, F.concat(F.lit("unknown-resource-type:"), x), "unknown-resource")),
    ]
    uses = page_notes.select("path", "seq", F.explode(F.array_compact(F.flatten(F.array_compact(F.array(*parts))))).alias("u"))
    order = F.struct(F.col("seq"), F.col("u.generator").alias("generator"), F.col("u.place").alias("place")).alias("ord")
    return uses.join(routed, "path", "left").select("u.resource_id", order, "u.kind", "u.name", "u.status", "u.reason", "route", "u.chunk_id")


def resource_graph(uses: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One node for each resource of resource_uses(): resource_id, kind, name, status, reason, artifact_id, routes and chunks (counts), first.

    A resource is what its first use says of it. That, like the counts of its different routes
    and chunks, combines in the tasks before rows meet by resource. Tables that have a
    name take the first artifact of that base name. ``first`` orders nodes as first met.
    """
    said = uses.groupBy("resource_id").agg(F.min_by(F.struct("kind", "name", "status", "reason"), "ord").alias("u"), F.min("ord").alias("first"))
    members = resource_members(uses).groupBy("resource_id").agg(F.count_if(F.col("member") == "route").alias("routes"), F.count_if(F.col("member") == "chunk").alias("chunks"))
    file = F.element_at(F.filter(F.split(F.regexp_replace("local_path", r"(?i)\.json$", ""), "/"), lambda s: s != ""), -1)
    files = artifacts.where(F.col("kind") == RESOURCE_KIND).groupBy(F.coalesce(file, "local_path").alias("base")).agg(F.min_by("id", "seq").alias("artifact_id"))
    nodes = said.select("resource_id", "u.*", "first").join(members, "resource_id")
    base = F.when(F.col("kind").isin("token-table", "status-table"), resource_basename(_filled(F.col("name"))))
    return nodes.withColumn("base", base).join(files, "base", "left").select("resource_id", "kind", "name", "status", "reason", "artifact_id", "routes", "chunks", "first")


def resource_members(uses: DataFrame) -> DataFrame:
    """(resource_id, member, value, first): each route and chunk of each resource once, ordered by where it was first met."""
    pairs = F.explode(F.array(F.struct(F.lit("route").alias("member"), F.col("route").alias("value")), F.struct(F.lit("chunk").alias("member"), F.col("chunk_id").alias("value")))).alias("m")
    rows = uses.select("resource_id", "ord", pairs).where("m.value IS NOT NULL")
    return rows.groupBy("resource_id", "m.member", "m.value").agg(F.min("ord").alias("first"))

"""Tolerant decoders of nested JSON: content pages, token systems, status tables, page metadata.

Input columns hold JSON text; what isn't JSON, or has another shape, decodes to null or
to fewer items, never to an error. Alternatives are tried in order, as COALESCE does.
"""

from __future__ import annotations

import json as json_
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places where a page's metadata can stand, in order, and segments of collections.
TITLE = ("$.result.pageContext.title", "$.pageContext.title", "$.title", "$.page.title")
CANON = ("$.result.pageContext.pageCanonId", "$.result.pageContext.canonId", "$.pageContext.pageCanonId", "$.pageCanonId", "$.canonId", "$.page.pageCanonId", "$.page.canonId")
PATHNAME = ("$.result.pageContext.pathname", "$.result.pageContext.slug", "$.pageContext.pathname", "$.pathname", "$.path")
COLLECTIONS = {"componentsm3": "components", "stylesm3": "styles", "foundationsm3": "foundations", "developm3": "develop", "getstartedm3": "get-started", "blogm3": "blog"}

_ITEMS = "array<variant>"


def variant(json: Column) -> Column:
    return F.try_parse_json(json)


def text_at(v: Column, *paths: str) -> Column:
    """The first of these places that holds a non-blank text, as it is."""
    return F.coalesce(*(F.when(F.trim(F.try_variant_get(v, p, "string")) != "", F.try_variant_get(v, p, "string")) for p in paths))


def array_at(v: Column, *paths: str) -> Column:
    """The first of these places that holds an array, even an empty one."""
    return F.coalesce(*(F.try_variant_get(v, p, _ITEMS) for p in paths))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def no_items() -> Column:
    return F.array().cast(_ITEMS)


def page_metadata(json: Column) -> Column:
    v = variant(json)
    path = text_at(v, *PATHNAME)
    segment = text_at(v, "$.result.pageContext.collectionName", "$.pageContext.collectionName", "$.collectionName")
    mapped = reduce(lambda out, kv: out.when(F.lower(F.regexp_replace(segment, "[^A-Za-z0-9]", "")) == kv[0], kv[1]), COLLECTIONS.items(), F.when(F.lit(False), ""))
    return F.struct(text_at(v, *TITLE).alias("title"), text_at(v, *CANON).alias("canon_id"), path.alias("pathname"), mapped.alias("collection"))


def shown_section(s: Column) -> Column:
    """Whether a section isn't marked as hidden."""
    hidden = lambda name: F.coalesce(F.try_variant_get(s, f"$.{name}", "boolean") == F.lit(False), F.lit(False))
    return ~hidden("isVisible") & ~hidden("visible")


def section_rows(lists: DataFrame, key: str) -> DataFrame:
    """Visible sections of lists (key, items): key, section_pos, title, body."""
    found = lists.select(key, F.posexplode("items").alias("section_pos", "s"))
    shown = found.where(is_object(F.col("s")) & shown_section(F.col("s")))
    return shown.select(key, "section_pos", F.coalesce(text_at(F.col("s"), "$.name", "$.title", "$.heading"), F.lit("Section")).alias("title"), F.col("s").alias("body"))


def sections(rows: DataFrame, key: str, json: str) -> DataFrame:
    """Visible sections of content pages at the known places: key, section_pos, title, body."""
    v = rows.select(key, variant(F.col(json)).alias("v"))
    places = array_at(F.col("v"), "$.sections", "$.content.sections", "$.page.sections", "$.data.sections")
    return section_rows(v.select(key, F.coalesce(places, no_items()).alias("items")), key)


def blocks(found: DataFrame, key: str) -> DataFrame:
    """Blocks of sections() that aren't hidden: key, section_pos, block_pos, title, body."""
    rows = found.select(key, "section_pos", F.posexplode(F.coalesce(array_at(F.col("body"), "$.contentBlocks", "$.blocks", "$.content", "$.items"), no_items())).alias("block_pos", "b"))
    hidden = F.coalesce(F.try_variant_get("b", "$.isHidden", "boolean"), F.lit(False)) | F.coalesce(F.try_variant_get("b", "$.hidden", "boolean"), F.lit(False))
    return rows.where(is_object(F.col("b")) & ~hidden).select(key, "section_pos", "block_pos", text_at(F.col("b"), "$.title", "$.name", "$.heading").alias("title"), F.col("b").alias("body"))


def chunks(found: DataFrame, key: str) -> DataFrame:
    """Chunks of blocks() with their type: key, section_pos, block_pos, chunk_pos, kind, html, image, resource, body."""
    rows = found.select(key, "section_pos", "block_pos", F.posexplode(F.coalesce(array_at(F.col("body"), "$.contentChunks", "$.chunks", "$.content", "$.items"), no_items())).alias("chunk_pos", "c"))
    c = F.col("c")
    there = lambda *ps: reduce(lambda a, b: a | b, (F.try_variant_get(c, p, "variant").isNotNull() for p in ps))
    kind = F.coalesce(
        F.try_variant_get(c, "$.contentChunkType", "string"),
        F.try_variant_get(c, "$.type", "string"),
        F.try_variant_get(c, "$.kind", "string"),
        F.when(there("$.htmlValue", "$.html"), "TEXT").when(there("$.imageUrl", "$.src"), "IMAGE").when(there("$.videoUrl", "$.embedUrl"), "VIDEO").when(there("$.libraryModuleType", "$.resourceName", "$.resourcePath"), "RESOURCE").otherwise("UNKNOWN_CHUNK"),
    )
    return rows.where(is_object(c)).select(key, "section_pos", "block_pos", "chunk_pos", kind.alias("kind"), text_at(c, "$.htmlValue", "$.html", "$.value", "$.body").alias("html"), text_at(c, "$.imageUrl", "$.url", "$.src").alias("image"), resource_name(c).alias("resource"), requested_sets(c).alias("token_sets"), c.alias("body"))


def resource_name(chunk: Column) -> Column:
    """Name of a chunk's resource: five places, else any text in it that speaks of a token table."""
    deep = F.nullif(F.regexp_extract(F.to_json(chunk), r'"([^"]*TOKEN_TABLE[^"]*)"', 1), F.lit(""))
    return F.coalesce(text_at(chunk, "$.resourceName", "$.resourcePath", "$.resourceUrl", "$.moduleConfigurationOverrides.resourceName", "$.moduleConfiguration.resourceName"), deep)


def requested_sets(chunk: Column) -> Column:
    """Token sets that a chunk asks for: the first of three places with any non-blank name; else none."""
    found = [F.filter(F.transform(F.try_variant_get(chunk, p, _ITEMS), lambda x: F.try_variant_get(x, "$", "string")), lambda s: F.trim(s) != "") for p in ("$.moduleConfigurationOverrides.tokenSets", "$.moduleConfiguration.tokenSets", "$.tokenSets")]
    return F.coalesce(*(F.when(F.size(f) > 0, f) for f in found), F.array().cast("array<string>"))


def named_items(v: Column, path: str, fields: tuple[str, ...], need_name: bool = True) -> Column:
    """Items of an array as structs of texts ('' where missing); items without a name are dropped, siblings stay."""
    text = lambda x, f: F.coalesce(F.try_variant_get(x, f"$.{f}", "string"), F.lit(""))
    items = F.filter(F.coalesce(F.try_variant_get(v, path, _ITEMS), no_items()), is_object)
    shaped = F.transform(items, lambda x: F.struct(*(text(x, f).alias(f) for f in fields)))
    return F.filter(shaped, lambda s: F.trim(s["name"]) != "") if need_name else shaped


def token_system(rows: DataFrame, key: str, json: str) -> DataFrame:
    """Token systems: key, tokens, sets, tags and trees (map of token name to JSON); none without tokens and sets."""
    v = variant(F.col(json))
    system = F.coalesce(F.try_variant_get(v, "$.system", "variant"), v)
    out = rows.select(key, system.alias("v")).select(
        key,
        named_items(F.col("v"), "$.tokens", ("name", "tokenName", "displayName", "tokenValueType", "state")).alias("tokens"),
        named_items(F.col("v"), "$.tokenSets", ("name", "displayName", "tokenSetName")).alias("sets"),
        named_items(F.col("v"), "$.tags", ("name", "displayName", "tagName"), need_name=False).alias("tags"),
        F.coalesce(F.try_variant_get("v", "$.contextualReferenceTrees", "map<string, variant>"), F.create_map().cast("map<string, variant>")).alias("trees"),
    )
    return out.where((F.size("tokens") > 0) | (F.size("sets") > 0))


def context_entries(systems: DataFrame, key: str) -> DataFrame:
    """Context entries of token_system(): key, token, pos, tags, undefined, value (JSON), end of the alias chain."""
    trees = systems.select(key, F.explode("trees").alias("token", "tree"))
    rows = trees.select(key, "token", F.posexplode(F.coalesce(F.try_variant_get("tree", "$.contextualReferenceTree", _ITEMS), no_items())).alias("pos", "e"))
    value = F.try_variant_get("e", "$.resolvedValue", "variant")
    return rows.select(key, "token", "pos", F.try_variant_get("e", "$.contextTags", "array<string>").alias("tags"), F.coalesce(F.try_variant_get(value, "$.undefined", "boolean"), F.lit(False)).alias("undefined"), F.to_json(value).alias("value"), alias_end(F.col("e")).alias("alias"))


def alias_end(entry: Column) -> Column:
    """Name at the end of the first-child chain of a reference tree, however long; the last one that has a name."""

    @F.pandas_udf("string")
    def follow(trees: pd.Series) -> pd.Series:
        def end(tree: str | None) -> str | None:
            node, name = json_.loads(tree) if tree else None, None
            while isinstance(node, dict):
                own, below = node.get("tokenName"), node.get("childNodes")
                name = own if isinstance(own, str) else name
                node = below[0] if isinstance(below, list) and below else None
            return name

        return trees.map(end)

    return follow(F.to_json(F.try_variant_get(entry, "$.referenceTree", "variant")))


def status_label(status: Column) -> Column:
    return F.concat(F.substring(status, 1, 1), F.replace(F.lower(F.substring(status, 2, 1_000_000)), F.lit("_"), F.lit(" ")))


def status_table(json: Column) -> Column:
    """Struct (headers, rows) of a status table; null if nothing of it can be read.

    Connections become rows of platform and status in their own order, those without a
    place last; otherwise headers or columns and rows or statuses, here or in a payload.
    """
    v = variant(json)
    links = F.filter(F.coalesce(array_at(v, "$.connections", "$.payload.connections"), no_items()), lambda c: F.coalesce(F.try_variant_get(c, "$.displayName", "string") != "", F.lit(False)) & F.coalesce(F.try_variant_get(c, "$.status", "string") != "", F.lit(False)))
    order = lambda c: F.coalesce(F.try_variant_get(c, "$.orderInComponent", "double"), F.lit(9007199254740991.0))
    name = lambda c: F.try_variant_get(c, "$.displayName", "string")
    url = lambda c: F.try_variant_get(c, "$.resourceUrl", "string")
    label = lambda c: F.when(F.coalesce(url(c), F.lit("")) != "", F.concat(F.lit("["), name(c), F.lit("]("), url(c), F.lit(")"))).otherwise(name(c))
    ranked = F.transform(links, lambda c, i: F.struct(order(c).alias("o"), i.alias("i"), F.array(label(c), status_label(F.try_variant_get(c, "$.status", "string"))).alias("row")))
    linked = F.struct(F.array(F.lit("Platform"), F.lit("Status")).alias("headers"), F.transform(F.array_sort(ranked), lambda r: r["row"]).alias("rows"))
    cell = lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.to_json(x), F.lit("null"))
    heads = F.filter(F.transform(array_at(v, "$.headers", "$.columns", "$.payload.headers", "$.payload.columns"), lambda h: F.coalesce(F.when(F.schema_of_variant(h) == "STRING", F.try_variant_get(h, "$", "string")), F.try_variant_get(h, "$.label", "string"), F.lit(""))), lambda h: h != "")
    values = lambda r: F.coalesce(F.try_variant_get(r, "$", _ITEMS), F.map_values(F.try_variant_get(r, "$", "map<string, variant>")), F.array(r))
    body = F.filter(F.transform(array_at(v, "$.rows", "$.statuses", "$.payload.rows", "$.payload.statuses"), lambda r: F.transform(values(r), cell)), lambda r: F.exists(r, lambda x: x != ""))
    return F.when(F.size(links) > 0, linked).when((F.size(heads) > 0) & (F.size(body) > 0), F.struct(heads.alias("headers"), body.alias("rows")))

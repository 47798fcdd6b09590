"""Page nodes from raw content snapshots, and the public index.

A content snapshot is decoded with strict field names: sections that aren't hidden, their
blocks and chunks, each with the id it has or one made of its place. Titles that a page
shows become its headings, each once, in the order in which a reader meets them.
"""

from __future__ import annotations

import json as json_
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = "struct<pageContentChunkId:string,pageContentChunkCanonId:string,htmlValue:string,footer:string,imageUrl:string,altText:string,videoUrl:string,resourceName:string,libraryModuleType:string,contentChunkType:string>"
BLOCK = f"struct<pageContentBlockId:string,pageContentBlockCanonId:string,title:string,isHidden:boolean,contentChunks:array<{CHUNK}>>"
SECTION = f"struct<pageSectionId:string,pageSectionCanonId:string,name:string,position:double,isVisible:boolean,contentBlocks:array<{BLOCK}>>"
CARBON = f"struct<pageId:string,pageCanonId:string,title:string,slug:string,sections:array<{SECTION}>>"


def stable_id(own: Column, canon: Column, base: Column, place: Column) -> Column:
    """An item's id, else its canonical id, else one of its place below ``base``."""
    return F.coalesce(own, canon, F.concat(base, F.lit("-"), place.cast("string")))


def carbon_chunks(rows: DataFrame, route: str, json: str) -> DataFrame:
    """(route, page_id, page_title, section, block and chunk places and ids, section and block titles, kind, html, resource).

    One row for each chunk of rows (route, json); sections and blocks without chunks have one
    row with a null chunk. What is no JSON object gives no rows.
    """
    page = rows.select(F.col(route).alias("route"), F.from_json(json, CARBON).alias("p")).where("p is not null")
    page = page.select("route", F.coalesce("p.pageId", "p.pageCanonId", "route").alias("page_id"), F.col("p.title").alias("page_title"), F.filter(F.coalesce("p.sections", F.array().cast(f"array<{SECTION}>")), lambda s: s.isNotNull() & F.coalesce(s["isVisible"], F.lit(True))).alias("sections"))
    found = page.select("route", "page_id", "page_title", F.posexplode("sections").alias("section_pos", "s"))
    shown = F.filter(F.coalesce("s.contentBlocks", F.array().cast(f"array<{BLOCK}>")), lambda b: b.isNotNull() & ~F.coalesce(b["isHidden"], F.lit(False)))
    found = found.select("route", "page_id", "page_title", "section_pos", stable_id(F.col("s.pageSectionId"), F.col("s.pageSectionCanonId"), F.concat("route", F.lit(":section")), F.col("section_pos")).alias("section_id"), F.coalesce("s.name", F.lit("Section")).alias("section"), F.posexplode_outer(shown).alias("block_pos", "b"))
    found = found.select(*found.columns[:-1], stable_id(F.col("b.pageContentBlockId"), F.col("b.pageContentBlockCanonId"), F.concat("section_id", F.lit(":block")), F.col("block_pos")).alias("block_id"), F.col("b.title").alias("block"), F.posexplode_outer(F.filter("b.contentChunks", lambda c: c.isNotNull())).alias("chunk_pos", "c"))
    kind = F.when(F.coalesce(F.upper("c.contentChunkType"), F.lit("")).isin("", "TEXT"), "text").when(F.upper("c.contentChunkType") == "IMAGE", "image").when(F.upper("c.contentChunkType") == "VIDEO", "video").when(F.upper("c.contentChunkType") == "RESOURCE", "resource").otherwise("unsupported")
    resource = F.when(kind == "image", F.concat(F.lit("image:"), F.coalesce("c.imageUrl", F.concat_ws(":", "route", F.col("chunk_pos").cast("string"))))).when(kind == "video", F.concat(F.lit("video:"), "c.videoUrl")).when(kind == "resource", F.col("c.resourceName"))
    return found.select(*found.columns[:-1], stable_id(F.col("c.pageContentChunkId"), F.col("c.pageContentChunkCanonId"), F.concat("block_id", F.lit(":chunk")), F.col("chunk_pos")).alias("chunk_id"), F.when(F.col("chunk_pos").isNotNull(), kind).alias("kind"), F.col("c.htmlValue").alias("html"), resource.alias("resource"))


def html_headings(html: Column) -> Column:
    """Titles of h1 to h6 in order, without tags and runs of white space."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return F.filter(F.transform(found, lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, r"<[^>]+>", " "), r"\s+", " "))), lambda h: h != "")


def page_nodes(chunks: DataFrame) -> DataFrame:
    """A page for each route of carbon_chunks(): page_id, headings (ordered, distinct), section ids, chunk and resource counts."""
    place = [F.coalesce(F.col(c), F.lit(-1)) for c in ("section_pos", "block_pos", "chunk_pos")]
    heads = F.concat(F.array("section"), F.array("block"), F.coalesce(F.when(F.col("kind") == "text", html_headings(F.col("html"))), F.array().cast("array<string>")))
    rows = chunks.withColumn("heads", heads)
    listed = F.array_sort(F.collect_list(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(place)], "heads", "section_id")))  # the chunks of one page
    out = rows.groupBy("route", "page_id", "page_title").agg(listed.alias("all"), F.count("kind").alias("chunks"), F.count_if(F.col("kind") == "text").alias("texts"), F.count_if(F.col("kind") == "unsupported").alias("unsupported"), F.array_sort(F.collect_set("resource")).alias("resources"))
    first = F.coalesce("page_title", F.element_at(F.split("route", "/"), -1))
    headings = F.array_distinct(F.array_compact(F.concat(F.array(first), F.flatten(F.transform("all", lambda x: x["heads"])))))
    return out.select("route", "page_id", headings.alias("headings"), F.array_distinct(F.transform("all", lambda x: x["section_id"])).alias("sections"), "chunks", "texts", "unsupported", "resources")


def public_index(pages: DataFrame, captured_at: str) -> DataFrame:
    """Pages as the public index lists them: path, title, source_url, section, headings, captured_at, with defaults for what is missing."""
    path = F.coalesce("path", F.lit(""))
    return pages.select(path.alias("path"), F.coalesce("title", path).alias("title"), F.coalesce("source_url", "url", F.lit("")).alias("source_url"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("headings", F.array().cast("array<string>")).alias("headings"), F.coalesce("captured_at", F.lit(captured_at)).alias("captured_at"))


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines; readers of a folder see all of it or none."""
    rows.write.mode("overwrite").json(path)


def stable_json(json: Column) -> Column:
    """JSON with the keys of all objects in order and no spaces; null for what is no JSON."""
    return F.to_json(F.try_parse_json(json))


def deep_first(json: Column, names: Sequence[str]) -> Column:
    """The first text or number under one of these names, wherever it stands: objects are searched before their members, in order.

    Null where none is found and for what is no JSON; empty texts don't count.
    """
    wanted = tuple(names)

    @F.pandas_udf("string")
    def search(texts: pd.Series) -> pd.Series:
        def first(text: str | None) -> str | None:
            try:
                stack = [json_.loads(text)] if text else []
            except ValueError:
                return None
            while stack:
                value = stack.pop()
                if isinstance(value, dict):
                    for name in wanted:
                        own = value.get(name)
                        if isinstance(own, str) and own.strip():
                            return own.strip()
                        if isinstance(own, (int, float)) and not isinstance(own, bool):
                            return json_.dumps(own)
                    stack.extend(reversed(value.values()))
                elif isinstance(value, list):
                    stack.extend(reversed(value))
            return None

        return texts.map(first)

    return search(json)

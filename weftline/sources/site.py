"""Readers of a documentation site's raw files: site maps, route tables in scripts, artifacts.

Fetching is left to whoever fills the folder; these are tables of whole files. What
has to scan text with state (balanced braces, strings) is one Arrow UDF over files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUTE_ENTRY = "slug string, documentId string, collectionId string, exportedCarbonFileId string, pageCanonId string, carbonPath string, title string, alternateSlugs array<string>, tabs array<struct<label: string, slug: string, alternateSlugs: array<string>>>"
SITE_ROUTE = T.MapType(T.StringType(), T.StringType())
REQUIRED_FILES = ("index.json", "manifest.json", "routes.json", "pages.json", "sections.json", "resources.json", "token-tables.json", "provenance.json", "artifacts.json", "renderer-report.json")
PREVIEW_CHARS, FULL_BYTES = 2000, 200_000


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def artifacts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with the given base name: path, content, length."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines; a field of another type is null, a broken line a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def preview(files: DataFrame, full: bool = False, chars: int = PREVIEW_CHARS) -> DataFrame:
    """Start of each file's text; the whole of it if asked for and at most 200,000 bytes long."""
    text = F.decode("content", "UTF-8")
    whole = F.lit(full) & (F.col("length") <= FULL_BYTES)
    return files.select("path", "length", F.when(whole, text).otherwise(F.substring(text, 1, chars)).alias("text"), (~whole & (F.length(text) > chars)).alias("truncated"))


def bundle_urls(html: Column) -> Column:
    """Paths of main scripts that a page loads."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'src="(/static/angular/main\.[0-9a-f]+\.js)"'), F.lit(1)))


def sitemap_urls(xml: Column) -> Column:
    """Addresses in <loc>; without any, every web address in the text."""
    loc = F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return F.when(F.size(loc) > 0, loc).otherwise(F.regexp_extract_all(xml, F.lit(r"https?://[^\s<>\"']+"), F.lit(0)))


def carbon_version(script: Column) -> Column:
    return F.nullif(F.regexp_extract(script, r'carbonVersion"?:"([^"]+)"', 1), F.lit(""))


def is_transient(status: Column) -> Column:
    """Whether a failed attempt is worth another: no status (no connection), or one of these."""
    return status.isNull() | status.isin(408, 425, 429) | (status >= 500)


def first_readable(candidates: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """For each id the first of its candidate addresses (array ``urls``) that a file has and that parses."""
    named = candidates.select(key, F.posexplode("urls").alias("rank", "url"))
    good = files.where(F.try_parse_json("text").isNotNull()).select("url", "text")
    return named.join(good, "url").groupBy(key).agg(F.min_by(F.struct("url", "text"), "rank").alias("hit")).select(key, "hit.*")


def balanced(text: str, start: int) -> str | None:
    """The object that opens at ``start``; braces within strings don't count."""
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
        i += 1
    return None


def assigned_object(text: str, name: str) -> str | None:
    """The first complete object that is assigned to a variable of this name."""
    for found in re.finditer(rf"\b{re.escape(name)}\s*=\s*(?=\{{)", text):
        own = balanced(text, found.end())
        if own is not None:
            return own
    return None


@F.pandas_udf(T.StringType())
def site_meta_json(text: pd.Series) -> pd.Series:
    """The JSON text of ``site_meta = {…}`` in a script or page; null if there is none."""
    return text.map(lambda t: assigned_object(t, "site_meta") if isinstance(t, str) else None)


def site_routes(files: DataFrame) -> DataFrame:
    """(path, route, public, redirect, collection_id, document_id, repo_id, aliases) of each route in site_meta."""
    meta = files.select(F.from_json(site_meta_json("text"), "struct<routes: map<string, string>>").alias("m"))
    rows = meta.select(F.explode("m.routes").alias("route", "body")).withColumn("v", F.try_parse_json("body")).where(F.schema_of_variant("v").startswith("OBJECT"))
    text = lambda p: F.nullif(F.trim(F.try_variant_get("v", p, "string")), F.lit(""))
    return rows.select(
        "route",
        F.coalesce(F.try_variant_get("v", "$.public", "boolean"), F.lit(True)).alias("public"),
        text("$.redirect_external_url").alias("redirect"),
        *(text(f"$.reference.{c}").alias(c) for c in ("collection_id", "document_id", "repo_id")),
        F.coalesce(F.try_variant_get("v", "$.other_routes", "array<string>"), F.array().cast("array<string>")).alias("aliases"),
    )


def enclosing(text: str, at: int) -> str | None:
    """The smallest balanced object around a place, counting all braces alike."""
    depth = 0
    for i in range(at, -1, -1):
        if text[i] == "}":
            depth += 1
        elif text[i] == "{":
            if not depth:
                break
            depth -= 1
    else:
        return None
    depth = 0
    for j in range(i, len(text)):
        depth += (text[j] == "{") - (text[j] == "}")
        if not depth:
            return text[i : j + 1]
    return None


def _list_after(text: str, name: str) -> list | None:
    found = re.search(rf'"{name}":(?=\[)', text)
    if not found:
        return None
    try:
        return json.JSONDecoder().raw_decode(text, found.end())[0]
    except ValueError:
        return None


def route_entries(script: str) -> list[dict]:
    """Every object around a ``"slug":"…"``; what stands in no object reaches to the next slug."""
    marks = list(re.finditer(r'"slug":"([^"]*)"', script))
    out, tab_slugs = [], set()
    for n, mark in enumerate(marks):
        if mark.start() in tab_slugs:
            continue
        body = enclosing(script, mark.start()) or script[mark.start() : marks[n + 1].start() if n + 1 < len(marks) else len(script)]
        if not mark[1]:
            continue
        one = lambda name, body=body: (m[1] if (m := re.search(rf'"{name}":"([^"]*)"', body)) else None)
        tabs = _list_after(body, "tabs")
        entry = {"slug": mark[1], **{k: one(k) for k in ("documentId", "collectionId", "exportedCarbonFileId", "pageCanonId", "carbonPath", "title")}}
        entry["alternateSlugs"] = [x for x in (_list_after(body, "alternateSlugs") or []) if isinstance(x, str)] or None
        entry["tabs"] = [{"label": t.get("label"), "slug": t.get("slug"), "alternateSlugs": t.get("alternateSlugs")} for t in tabs if isinstance(t, dict) and t.get("label")] if tabs else None
        out.append(entry)
    return out


def route_table(files: DataFrame) -> DataFrame:
    """Entries of the route tables embedded in scripts (path, text), a row an entry with its place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": path, "seq": n, **entry} for path, text in zip(batch["path"], batch["text"], strict=True) if isinstance(text, str) for n, entry in enumerate(route_entries(text))]
            if rows:
                yield pd.DataFrame(rows)

    return files.select("path", "text").mapInPandas(run, f"path string, seq long, {ROUTE_ENTRY}")


def missing_files(files: DataFrame, required: tuple[str, ...] = REQUIRED_FILES) -> DataFrame:
    """Required base names that no file has."""
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct()
    return files.sparkSession.createDataFrame([(x,) for x in required], "name string").join(names, "name", "left_anti")

"""Sections of content pages that stand at none of the known places, found by walking the page's tree.

The first object, in the order in which a reader of the text meets objects, that has a
list of sections among its members gives the page's sections: the first such list. An item is like
a section if it is an object with a list of blocks or chunks. A list whose sections are all hidden is
passed over.

The tree is walked level by level in the JVM, each level a written table of the objects and lists
that are left. Members keep the order of the text: a level is parsed to its members' raw
text, and once more to variants, which say what each member is (a text that looks like an object
is none). A subtree whose text names no list of blocks or chunks is never entered, nor is
one below a list that has been found, so levels get small quickly; there are as many as the
deepest page has. A node's way from the root is its order: of all lists found, the one of the
least way is taken, and that combines in the tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Written
from .decode import array_at, is_object, no_items, section_rows, shown_section, variant

#: Lists that make an object like a section.
LISTS = ("contentBlocks", "blocks", "contentChunks", "chunks")
SECTIONS = ("$.sections", "$.content.sections", "$.page.sections", "$.data.sections")
_ITEMS = "array<variant>"


def is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def like_section(v: Column) -> Column:
    return is_object(v) & reduce(lambda a, b: a | b, (is_array(F.try_variant_get(v, f"$.{name}", "variant")) for name in LISTS))


def _named(text: Column) -> Column:
    """Whether a text can hold a list that a section is known by; most texts are ruled out."""
    return reduce(lambda a, b: a | b, (text.contains(f'"{name}"') for name in LISTS))


def _members(kind: str, text: Column) -> Column:
    """(raw, v) of each member of an object or item of a list, in the order of the text."""
    if kind == "object":
        raw, v = F.map_values(F.from_json(text, "map<string,string>")), F.map_values(F.from_json(text, "map<string,variant>"))
    else:
        raw, v = F.from_json(text, "array<string>"), F.from_json(text, "array<variant>")
    return F.arrays_zip(raw.alias("raw"), v.alias("v"))


def discovered(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, items): the list of sections found in each row's page; pages without one have no row."""
    written = Written(rows.sparkSession, "discover")
    whole = variant(F.col(json))
    level = rows.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("way"), F.col(json).alias("text"), is_object(whole).alias("object"), is_array(whole).alias("list"))
    level = level.where(_named(F.col("text")) & (F.col("object") | F.col("list"))).drop("list")
    found, depth = [], 0
    while True:
        level, n = written.counted(level, f"level-{depth}")
        if not n:
            break
        members = F.when(F.col("object"), _members("object", F.col("text"))).otherwise(_members("list", F.col("text")))
        own = level.select("key", "way", "object", members.alias("members"))
        lists = F.filter("members", lambda m: F.coalesce(F.exists(F.try_variant_get(m["v"], "$", _ITEMS), like_section), F.lit(False)))
        first = F.try_variant_get(F.get(lists, F.lit(0))["v"], "$", _ITEMS)
        own = own.withColumn("items", F.when(F.col("object"), first))
        own = own.withColumn("items", F.when(F.exists("items", lambda s: is_object(s) & shown_section(s)), F.col("items")))
        found.append(written.keep(own.where("items IS NOT NULL").select("key", "way", F.transform("items", lambda v: F.to_json(v)).alias("items")), f"found-{depth}"))
        below = own.where("items IS NULL").select("key", "way", F.posexplode("members").alias("place", "m"))
        below = below.where(_named(F.col("m.raw")) & (is_object(F.col("m.v")) | is_array(F.col("m.v"))))
        level = below.select("key", F.concat("way", F.array("place")).alias("way"), F.col("m.raw").alias("text"), is_object(F.col("m.v")).alias("object"))
        depth += 1
    if not found:
        return rows.select(key, F.lit(None).cast(_ITEMS).alias("items")).limit(0)
    best = reduce(DataFrame.union, found).groupBy("key").agg(F.min_by("items", "way").alias("items"))
    return best.select(F.col("key").alias(key), F.transform("items", lambda s: F.parse_json(s)).alias("items"))


def all_sections(rows: DataFrame, key: str, json: str) -> DataFrame:
    """Visible sections of content pages, at the known places or else found: key, section_pos, title, body.

    ``key`` is of one row each. What is no JSON, null or without sections gives no rows.
    """
    placed = rows.select(key, json, F.coalesce(array_at(variant(F.col(json)), *SECTIONS), no_items()).alias("items"))
    known = placed.where(F.size("items") > 0).select(key, "items")
    return section_rows(known.unionByName(discovered(placed.where(F.size("items") == 0), key, json)), key)


def content_page(json: Column) -> Column:
    """Title of a content page, and the HTML that stands for it where it has no sections."""
    from .decode import text_at

    v = variant(json)
    return F.struct(text_at(v, "$.title", "$.name").alias("title"), text_at(v, "$.htmlValue", "$.body", "$.description").alias("fallback_html"))

"""Column expressions for text: normalising, stripping, excerpts, headings, links, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"\s+", " "))


def match_text(text: Column) -> Column:
    """Lower case, '&' as 'and', other signs as spaces."""
    return collapsed(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " "))


def search_text(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def strip_html(html: Column) -> Column:
    """Text of an HTML fragment: scripts, styles and tags go, five entities are decoded."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->|<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return collapsed(text)


def strip_frontmatter(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"(?s)^---.*?---", "")


def strip_markdown(markdown: Column) -> Column:
    """Plain text: frontmatter, fences, links, emphasis and list marks go."""
    text = F.regexp_replace(strip_frontmatter(markdown), r"(?s)```.*?```", " ")
    text = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return collapsed(F.regexp_replace(text, r"[#>*_`|~-]+", " "))


def html_title(html: Column) -> Column:
    """The first h1's text, else the title's."""
    h1 = strip_html(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return F.when(h1 != "", h1).otherwise(strip_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_headings(html: Column) -> Column:
    """Texts of h1 to h4, in order, without empty ones."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-4][^>]*>(.*?)</h[1-4]>"), F.lit(1))
    return F.filter(F.transform(found, strip_html), lambda h: h != "")


def html_heading_levels(html: Column) -> Column:
    """Array of (level, text) of h1 to h6 whose end tag has the same level."""
    pattern = F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>")
    pairs = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("level"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("text"))
    return F.transform(pairs, lambda p: F.struct(p["level"].cast("int").alias("level"), strip_html(p["text"]).alias("text")))


def html_links(html: Column) -> Column:
    """href values, in double or single quotes, in order."""
    double = F.regexp_extract_all(html, F.lit(r"(?i)href=[\"']([^\"']+)[\"']"), F.lit(1))
    return double


def upscaled_image(url: Column) -> Column:
    """Image links that end in a width below 800 (or the original size) ask for 1600 instead."""
    width = F.regexp_extract(url, r"=w(\d+)$", 1)
    small = (width != "") & (F.length(width) <= 9) & (width.cast("int") < 800)
    return F.when(small | url.endswith("=s0"), F.regexp_replace(url, r"=(w\d+|s0)$", "=w1600")).otherwise(url)


def excerpt(body: Column, query: str) -> Column:
    """500 characters from 180 before the query's first word of over two letters."""
    word = next((w for w in query.lower().split() if len(w) > 2), None)
    at = F.instr(F.lower(body), word) - 1 if word else F.lit(-1)
    start = F.greatest(F.lit(0), at - 180)
    return collapsed(body.substr(start + 1, F.lit(500)))


def content_hash(markdown: Column) -> Column:
    return F.substring(F.sha2(collapsed(strip_frontmatter(markdown)), 256), 1, 16)


def duration(ms: Column) -> Column:
    """'12s', '3m', '3m4s', '2h', '2h5m'."""
    s = F.greatest(F.floor(ms / 1000 + 0.5), F.lit(0)).cast("long")
    m, h = F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long")
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    some = lambda n, unit: F.when(n > 0, text(n, unit)).otherwise(F.lit(""))
    return F.when(s < 60, text(s, "s")).when(s < 3600, F.concat(text(m, "m"), some(s % 60, "s"))).otherwise(F.concat(text(h, "h"), some(m % 60, "m")))


def compact_json(value: Column, most: int = 280) -> Column:
    return F.substring(F.to_json(value), 1, most)


def escaped_cell(text: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.replace(F.replace(F.regexp_replace(text, r"\s*\n\s*", " "), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))

"""HTML to Markdown: an Arrow UDF around a small converter, with tables, noise filter and large images."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines and patterns of viewer controls that are no content.
NOISE_LINES = frozenset(("close", "link", "pause", "search", "resources", "folderenabled", "keyboard_arrow_down", "visibilitygrid_viewexpand_all", "copy linklink copied", "on this page", "token"))
NOISE = re.compile(r"arrowdropdown|keyboardarrowdown|gridview|folderenabled|^visibility$|^expand_all$|^folder$", re.I)
NOISE_LENGTH = 80
SKIPPED = frozenset(("script", "style", "noscript", "template", "svg", "head"))
BLOCKS = frozenset(("p", "div", "section", "article", "main", "header", "footer", "ul", "ol", "blockquote", "figure", "nav", "aside", "form", "dl", "dt", "dd"))
VOID = frozenset(("br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "col", "embed", "base", "track", "param"))


def large_image(url: str) -> str:
    """An image link that asks for less than 800 pixels, or the original, asks for 1600."""
    found = re.search(r"=(?:w(\d+)|s0)$", url)
    return url[: found.start()] + "=w1600" if found and (found[1] is None or int(found[1]) < 800) else url


def cell(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("\n", "<br>")).strip().replace("\\", "\\\\").replace("|", "\\|")


def markdown_table(rows: list[list[str]]) -> str:
    """A table whose first row is the head; short rows are padded, empty heads numbered."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    padded = [row + [""] * (width - len(row)) for row in rows]
    head = [c or f"Column {n}" for n, c in enumerate(padded[0], 1)]
    return "\n".join(f"| {' | '.join(r)} |" for r in (head, ["---"] * width, *padded[1:]))


class Converter(HTMLParser):
    """Collects Markdown of what it is fed; unbalanced tags are tolerated."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[list[str]] = [[]]
        self.skip, self.lists, self.links, self.pre = 0, [], [], 0
        self.tables: list[list[list[str]]] = []

    def put(self, text: str) -> None:
        if not self.skip:
            self.out[-1].append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.put(f"\n\n{'#' * int(tag[1])} ")
        elif tag in ("strong", "b"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("_")
        elif tag == "pre":
            self.pre += 1
            self.put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag == "a":
            self.links.append(own.get("href") or "")
            self.put("[")
        elif tag == "img" and own.get("src"):
            self.put(f"![{(own.get('alt') or '').strip()}]({large_image(own['src'])})")
        elif tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag == "li":
            depth = max(len(self.lists) - 1, 0)
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            self.put("\n" + "  " * depth + (f"{self.lists[-1]}. " if self.lists and self.lists[-1] is not None else "- "))
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self.out.append([])
        if tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
            self.put("\n")
        elif tag in BLOCKS:
            self.put("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("strong", "b"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("_")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.put("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag == "a" and self.links:
            self.put(f"]({self.links.pop()})")
        elif tag in ("td", "th") and self.tables and len(self.out) > 1:
            text = cell("".join(self.out.pop()).strip())
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append(text)
        elif tag == "table" and self.tables:
            rows = [r for r in self.tables.pop() if any(r)]
            self.put(f"\n\n{markdown_table(rows)}\n\n" if rows else "")
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.put("\n")
        elif tag in BLOCKS or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.put("\n\n")

    def handle_data(self, data: str) -> None:
        if self.tables and len(self.out) == 1:
            return  # white space between cells
        self.put(data if self.pre else re.sub(r"\s+", " ", data))

    def text(self) -> str:
        return "".join("".join(part) for part in self.out)


def without_noise(markdown: str) -> str:
    """Markdown without control lines; fenced code stays as it is, blank lines don't pile up."""
    kept, fenced = [], False
    for line in markdown.split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
        elif not fenced:
            if bare.lower() in NOISE_LINES or (len(bare) < NOISE_LENGTH and NOISE.search(bare)):
                continue
            line = line.rstrip()
        kept.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def html_to_markdown(html: str | None) -> str | None:
    if html is None:
        return None
    own = Converter()
    own.feed(html)
    own.close()
    return without_noise(re.sub(r"[ \t]+\n", "\n", own.text()))


@F.pandas_udf(T.StringType())
def markdown(html: pd.Series) -> pd.Series:
    return html.map(html_to_markdown)


def table_markdown(headers: Column, rows: Column) -> Column:
    """Markdown of a table in columns (headers, rows), without leaving the JVM."""
    width = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    head = F.transform(pad(headers), lambda h, i: F.when(h == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(h))
    return F.array_join(F.concat(F.array(line(head), line(F.array_repeat(F.lit("---"), width))), F.transform(rows, lambda r: line(pad(r)))), "\n")


def frontmatter(title: Column, url: Column, section: Column, body: Column) -> Column:
    """A page file: a head of three quoted fields, then the Markdown."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(F.lit("---\ntitle: "), quoted(title), F.lit("\nurl: "), quoted(url), F.lit("\nsection: "), quoted(section), F.lit("\n---\n\n"), body, F.lit("\n"))


def page_files(pages: DataFrame) -> DataFrame:
    """(path, text) of the Markdown files of pages (path, title, url, section, html)."""
    return pages.select("path", frontmatter(F.col("title"), F.col("url"), F.col("section"), markdown("html")).alias("text"))

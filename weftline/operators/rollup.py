"""Totals of a run's diagnostics: of its routes, of its pages, and one row that combines the three summaries.

Every total is a sum or a count over one pass of the notes, given here as tables of
measures; all combine in the tasks, for one run or for many at once (``by``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import REASONS

#: Total -> the column and the word that it counts.
WORDS = {
    "through_json": ("final_method", "json"),
    "through_dom": ("final_method", "dom"),
    "from_direct_json": ("source_used", "direct-json"),
    "from_network_json": ("source_used", "network-json"),
    "from_dom": ("source_used", "dom-fallback"),
    "failed": ("source_used", "failed"),
}
#: Ways of extraction, each with columns ``…_attempted`` and ``…_succeeded``.
WAYS = ("direct_json", "network_json", "dom_fallback")
#: Lists whose items are counted, and for some the routes that have any.
LISTS = ("unknown_chunks", "unknown_resources", "missing_sets")
#: Counters that are added up, missing ones as zero.
COUNTERS = (
    "json_unknown", "tables_resolved", "tables_decoded", "tables_rendered", "tables_placeholder", "tables_unsupported", "tables_inline",
    "status_requested", "status_resolved", "status_decoded", "status_rendered", "status_placeholder", "status_unsupported",
    "chunks_requested", "chunks_resolved", "chunks_decoded", "chunks_rendered", "chunks_placeholder", "debug_files",
)
#: Markdown below so many letters is suspiciously short.
SHORT = 80


def _sum(value: Column, name: str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _items(name: str) -> Column:
    return F.coalesce(F.size(F.col(name)), F.lit(0))


def route_totals(notes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of route notes: final_method, source_used, WAYS, LISTS, COUNTERS, tables, tables_requested and contexts.

    ``contexts`` is an array of structs (fallback, several, unresolved), one for each token table that was shown.
    """
    contexts = F.coalesce("contexts", F.array().cast(notes.schema["contexts"].dataType))
    of = lambda test: F.size(F.filter(contexts, lambda x: F.coalesce(test(x), F.lit(False))))
    totals = [F.count("*").alias("routes")]
    totals += [F.count_if(F.col(column) == word).alias(name) for name, (column, word) in WORDS.items()]
    totals += [F.count_if(F.col(f"{way}_attempted") & ~F.coalesce(F.col(f"{way}_succeeded"), F.lit(False))).alias(f"{way}_failed") for way in WAYS]
    totals += [F.count_if(_items(name) > 0).alias(f"with_{name}") for name in LISTS[:2]]
    totals += [_sum(_items(name), name) for name in LISTS]
    totals += [_sum(_zero(name), name) for name in COUNTERS]
    totals += [
        F.count_if(F.col("tables") > 0).alias("with_tables"),
        _sum(F.coalesce("tables_requested", "tables", F.lit(0)), "tables_requested"),
        _sum(F.greatest(F.lit(0), _zero("tables") - _zero("tables_rendered")), "tables_not_rendered"),
        _sum(F.size(contexts), "contexts"),
        _sum(of(lambda x: x["fallback"]), "contexts_fallback"),
        _sum(of(lambda x: x["several"]), "contexts_several"),
        _sum(of(lambda x: x["unresolved"] > 0), "contexts_unresolved"),
    ]
    return notes.groupBy(*by).agg(*totals)


def content_totals(notes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of page notes (markdown_length, no_sections, no_headings, images, videos, unresolved)."""
    return notes.groupBy(*by).agg(
        F.count("*").alias("pages"), F.count_if(F.col("markdown_length") < SHORT).alias("short"), F.count_if("no_sections").alias("no_sections"), F.count_if("no_headings").alias("no_headings"),
        *[_sum(_zero(c), c) for c in ("images", "videos", "unresolved")],
    )


def spec_totals(pages: DataFrame) -> DataFrame:
    """One row of specification pages (component, tables): with and without token tables, and the same of components."""
    has, own = F.coalesce(F.col("tables") > 0, F.lit(False)), F.col("component")
    return pages.agg(
        F.count_if(has).alias("spec_with_tables"), F.count_if(~has).alias("spec_without_tables"),
        F.count_if(own).alias("component_specs"), F.count_if(own & has).alias("component_with_tables"), F.count_if(own & ~has).alias("component_without_tables"),
    )


def combined(token_totals: DataFrame, reasons: DataFrame, specs: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of the three summaries: tokens.resolution_totals() and resolution(), spec_totals(), routes.rejected_summary().

    Reasons become columns, zeros included. Each part is one row, or six.
    """
    by_reason = reasons.agg(*[_sum(F.when(F.col("reason") == r, F.col("cells")), f"reason_{r.replace('-', '_')}") for r in REASONS])
    tokens = token_totals.select(F.col("unresolved_rows").alias("unresolved_token_rows"), F.col("unresolved_cells").alias("unresolved_token_cells"))
    return tokens.crossJoin(by_reason).crossJoin(specs).crossJoin(rejected)  # one row each

"""Quality of extracted pages: duplicates, short pages, scores, fallback reasons, run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import fallback_reason
from ..functions.text import content_hash, match_text

SHORT, MINIMUM, ACCEPTED = 160, 80, 4


def _repeated(keyed: DataFrame, key: str) -> DataFrame:
    """(key, n, title of the first, path) of rows (key, seq, title, path) whose key occurs again: one row a member, no lists."""
    groups = keyed.groupBy(key).agg(F.count("*").alias("n"), F.min_by("title", "seq").alias("title")).where("n > 1")
    return keyed.select(key, "path").join(groups, key).select(key, "n", "title", "path")


def duplicate_content(pages: DataFrame) -> DataFrame:
    """Pages (seq, text, markdown, title, path) whose content others have too: hash, size of the group, title of its first, path."""
    return _repeated(pages.where(F.length("text") >= SHORT).select(content_hash(F.col("markdown")).alias("hash"), "seq", "title", "path"), "hash")


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """Pages (seq, title, path) whose normalised title others have too: key, size of the group, title of its first, path."""
    return _repeated(pages.select(match_text(F.col("title")).alias("key"), "seq", "title", "path").where("key <> ''"), "key")


def short_pages(pages: DataFrame, text: Column) -> DataFrame:
    return pages.where(F.length(text) < SHORT)


def summary(pages: DataFrame, short: Column) -> DataFrame:
    """Sizes of the quality lists, in one row."""
    content = pages.where(F.length("text") >= SHORT).groupBy(content_hash(F.col("markdown")).alias("hash")).count().where("count > 1")
    titles = pages.groupBy(match_text(F.col("title")).alias("key")).count().where("count > 1 and key <> ''")
    totals = pages.agg(F.count("*").alias("pages"), F.count_if(F.length("text") < short).alias("short_pages"))
    groups = content.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_pages"))
    return totals.crossJoin(groups).crossJoin(titles.agg(F.count("*").alias("duplicate_titles")))  # three rows of totals


def scored(facts: DataFrame) -> DataFrame:
    """Adds score, fallback reason and acceptance to rows of extraction facts."""
    points = lambda check, n: F.when(check, n).otherwise(0)
    c = F.col
    score = (
        points(c("has_title"), 2)
        + points(c("has_sections"), 2)
        + points(c("headings") > 0, 1)
        + points(c("text_length") >= MINIMUM, 2)
        + points(c("headings") >= 2, 1)
        + points(c("media") > 0, 1)
        + points((c("token_tables") == 0) | (c("token_tables_rendered") == c("token_tables")), 1)
        + points(c("status_tables") > 0, 1)
        - points(c("unknown_chunks") > 0, 1)
        - points(c("unknown_resources") > 0, 1)
        - c("unresolved")
        - c("missing_sets")
        - points(c("mismatch"), 1)
        - points(c("markdown_length") < MINIMUM, 1)
        - points(c("placeholders") >= 3, 2)
    )
    rows = facts.withColumn("score", score)
    reason = fallback_reason(
        (~c("has_title"), "json-title-missing"),
        (c("mismatch"), "json-route-mismatch"),
        (c("token_tables") > c("token_tables_rendered"), "json-missing-token-tables"),
        (~c("has_sections"), "json-no-sections"),
        (c("headings") == 0, "json-no-headings"),
        (c("markdown_length") < MINIMUM, "json-short-markdown"),
        (c("text_length") < MINIMUM, "json-suspicious-content"),
        (c("score") < ACCEPTED, "json-low-quality"),
    )
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def response_argmax(responses: DataFrame, key: str, order: str, checks: list[tuple[Column, int]]) -> DataFrame:
    """The best response of each key: the sum of the points of the checks that hold, ties to the first."""
    score = F.lit(0)
    for check, points in checks:
        score = score + F.when(check, points).otherwise(0)
    rows = responses.withColumn("score", score)
    best = F.max_by(F.struct(order, "score"), F.struct(F.col("score"), -F.col(order))).alias("best")
    return rows.groupBy(key).agg(best).select(key, f"best.{order}", "best.score")


def page_totals(pages: DataFrame) -> DataFrame:
    """Run totals of page diagnostics (saved, failed, skipped, text_length, tables, rendered, requested)."""
    c = F.col
    return pages.agg(
        F.count("*").alias("pages"),
        F.count_if(c("saved")).alias("saved"),
        F.count_if(c("failed")).alias("failed"),
        F.count_if(c("saved") & (c("text_length") < MINIMUM)).alias("short"),
        F.sum(F.coalesce(c("tables"), F.lit(0))).alias("tables"),
        F.sum(F.greatest(F.lit(0), F.coalesce(c("tables"), F.lit(0)) - F.coalesce(c("rendered"), F.lit(0)))).alias("not_rendered"),
        F.sum(F.coalesce(c("requested"), c("tables"), F.lit(0))).alias("requested"),
    )


def source_counters(attempts: DataFrame) -> DataFrame:
    """Source and virtual counters of (source, saved, failed, skipped): a source with any saved page succeeded."""
    per = attempts.where(~F.col("skipped")).groupBy("source").agg(F.count("*").alias("virtual"), F.count_if(F.col("saved")).alias("ok"), F.count_if(F.col("failed")).alias("bad"))
    return per.agg(
        F.count("*").alias("sources"),
        F.count_if(F.col("ok") > 0).alias("sources_saved"),
        F.count_if((F.col("ok") == 0) & (F.col("bad") > 0)).alias("sources_failed"),
        F.sum("virtual").alias("virtual_pages"),
        F.sum("ok").alias("virtual_saved"),
        F.sum("bad").alias("virtual_failed"),
    )


def failure_ratio(failed: Column, attempted: Column, least: int = 10, most: float = 0.2) -> Column:
    """Whether too many of enough attempts failed."""
    return (attempted >= least) & (failed / attempted > most)


def spec_pages(routes: DataFrame, spec: str) -> DataFrame:
    """Counts of routes (route, has_page) that are specification pages, with and without a page."""
    is_spec = F.col("route").rlike(spec)
    return routes.agg(
        F.count("*").alias("routes"),
        F.count_if(is_spec).alias("spec_routes"),
        F.count_if(is_spec & F.col("has_page")).alias("spec_with_page"),
        F.count_if(is_spec & ~F.col("has_page")).alias("spec_missing_page"),
        F.count_if(is_spec & F.col("route").startswith("/components/")).alias("component_spec_routes"),
    )


def response_type_counts(responses: DataFrame, kind: str = "type") -> DataFrame:
    """(type, n) of captured responses."""
    return responses.groupBy(F.col(kind).alias("type")).agg(F.count("*").alias("n"))


#: What a captured response scores for each property it has.
SCORES = {"payload_title": 2, "meta_title": 2, "meta_path": 2, "meta_canon": 2, "has_sections": 3, "url_has_route": 8, "url_has_token": 3, "path_is_route": 10, "canon_is_token": 8, "title_is_token": 2, "url_fits_kind": 1}


def response_score(properties: dict[str, Column]) -> Column:
    """Sum of SCORES of the properties that hold; null counts as no."""
    out = F.lit(0)
    for name, holds in properties.items():
        out = out + F.when(holds, SCORES[name]).otherwise(0)
    return out.cast("long")

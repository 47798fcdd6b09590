"""Expectations as rows (place, stage, passed, reasons): integrity, required rows, comparison with captures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_text


def expectation(place: int, stage: str, bad: DataFrame, reason: str, most: int = 10) -> DataFrame:
    """One row: passed if ``bad`` (column item) is empty; else how many, and the first ten."""
    first = bad.select(F.col("item").cast("string").alias("item")).orderBy("item").limit(most).agg(F.array_sort(F.collect_list("item")).alias("items"))
    total = bad.agg(F.count("*").alias("n"))
    reasons = F.when(F.col("n") == 0, F.array().cast("array<string>")).otherwise(F.transform("items", lambda x: F.concat(F.lit(f"{reason}: "), x)))
    return total.crossJoin(first).select(F.lit(place).alias("place"), F.lit(stage).alias("stage"), (F.col("n") == 0).alias("passed"), F.col("n").alias("bad"), reasons.alias("reasons"))  # one row each


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Required keys without a row (column item)."""
    return required.select(key).distinct().join(present.select(key).distinct(), key, "left_anti").select(F.col(key).alias("item"))


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Distinct keys that point to no parent (column item)."""
    keys = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("item")).distinct()
    return keys.join(parents.select(F.col(parent_key).alias("item")), "item", "left_anti")


def with_flag(rows: DataFrame, key: str, others: DataFrame, flag: str) -> DataFrame:
    """Rows with a flag that tells whether their key occurs in others."""
    there = others.select(key).distinct().withColumn(flag, F.lit(True))
    return rows.join(there, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def not_captured(captured: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Captured resources (id, keys) that share no key with any artifact (keys)."""
    have = artifacts.select(F.explode("keys").alias("key")).distinct()
    hit = captured.select("id", F.explode("keys").alias("key")).join(have, "key", "left_semi").select("id").distinct()
    return captured.join(hit, "id", "left_anti")


def url_keys(url: Column, local_path: Column) -> Column:
    """Keys by which a resource is known: URL, path, local path and the last segment of each."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/]*([^?#]*)", 1)
    last = lambda c: F.element_at(F.filter(F.split(c, "/"), lambda x: x != ""), -1)
    return F.array_distinct(F.array_compact(F.array(url, F.nullif(path, F.lit("")), local_path, last(path), last(local_path))))


def missing_headings(captured: Column, page: Column) -> Column:
    """Captured headings whose normalised text no heading of the page has."""
    return F.array_except(F.transform(captured, match_text), F.transform(page, match_text))


def missing_labels(labels: DataFrame, names: DataFrame) -> DataFrame:
    """Labels (page, label) that neither equal, contain nor lie within a name of the same page (page, name).

    Joined by page, so that only a page's own names meet its labels.
    """
    n = names.select("page", match_text(F.col("name")).alias("__name")).where("__name <> ''").distinct()
    own = labels.withColumn("__label", match_text(F.col("label")))
    return own.join(n, (own["page"] == n["page"]) & (F.col("__label").contains(F.col("__name")) | F.col("__name").contains(F.col("__label"))), "left_anti").drop("__label")


def run_all(checks: list[DataFrame]) -> DataFrame:
    """All checks, in order."""
    return reduce(DataFrame.unionByName, checks).orderBy("place")


def fail_fast(checks: list[DataFrame]) -> list[dict]:
    """Checks until the first that fails, which is the last of the list."""
    out = []
    for check in checks:
        row = check.first().asDict()
        out.append(row)
        if not row["passed"]:
            break
    return out


def health(statuses: DataFrame) -> DataFrame:
    """Whether all of a manifest's health values (name, value) are verified."""
    return statuses.agg(F.bool_and(F.col("value") == "verified").alias("passed"), F.array_sort(F.collect_list(F.when(F.col("value") != "verified", F.col("name")))).alias("reasons"))


def severity(route: Column, problem: Column, required: list[str]) -> Column:
    """error for required routes, warning for others, null without a problem."""
    return F.when(problem, F.when(route.isin(*required), "error").otherwise("warning"))

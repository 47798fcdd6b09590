"""Coverage of routes: status from path sets, shared groups, summaries, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("covered", "partial", "failed", "skipped", "unresolved", "policySkipped", "nonContent")
SETS = ("expected", "saved", "failed", "skipped")
STICKY = ("policySkipped", "nonContent")
GAP_LEAST, GAP_RATIO, KEEP_RATIO = 5, 0.2, 0.8


def status(expected: Column, saved: Column, failed: Column, skipped: Column, given: Column | None = None) -> Column:
    """Status of four path sets; a policy status that is given stays."""
    within = lambda s: F.size(F.array_except(expected, s)) == 0
    out = F.when(given.isin(*STICKY), given) if given is not None else None
    empty = F.size(expected) == 0
    out = out.when(empty, "unresolved") if out is not None else F.when(empty, "unresolved")
    return out.when(within(saved), "covered").when(F.size(saved) > 0, "partial").when(within(failed), "failed").when(within(skipped), "skipped").otherwise("unresolved")


def unions(rows: DataFrame, keys: list[str], sets: tuple[str, ...] = SETS) -> DataFrame:
    """Sorted unions of array columns by key: elements are made distinct before the shuffle.

    Set elements are exploded to (key, set, element), so a group of any size is
    aggregated with map-side combine and a group's rows never meet in one list.
    """

    def tagged(name: str) -> Column:
        return F.transform(name, lambda e: F.struct(F.lit(name).alias("s"), e.alias("e")))

    none = F.array(F.struct(F.lit("").alias("s"), F.lit(None).cast("string").alias("e")))  # keeps keys without any element
    named = rows.select(*keys, F.explode(F.concat(none, *map(tagged, sets))).alias("x"))
    one = named.select(*keys, "x.s", "x.e").distinct()
    return one.groupBy(*keys).agg(*(F.array_sort(F.collect_list(F.when(F.col("s") == s, F.col("e")))).alias(s) for s in sets))


def shared(entries: DataFrame, group: str) -> DataFrame:
    """Entries (source, status, reasons, four sets) with their group's united sets, status and reasons.

    Own sets stay as own_expected etc., so that what an entry was before is still known.
    """
    drop_alias = F.filter("reasons", lambda r: r != "alias-only-source-route")
    rows = entries.withColumn("reasons", drop_alias)
    united = unions(rows.select(group, *SETS, F.col("reasons")), [group], (*SETS, "reasons"))
    policy = rows.groupBy(group).agg(F.count("*").alias("members"), F.min(F.when(~F.col("status").isin(*STICKY), F.lit(0)).otherwise(F.lit(1))).alias("sticky"), F.min_by("status", "source").alias("first_status"))
    now = status(*(F.col(s) for s in SETS), given=F.when(F.col("sticky") == 1, F.col("first_status")))
    groups = united.join(policy, group).withColumn("status", now)
    groups = groups.withColumn("reasons", F.when(F.col("status") == "covered", F.array().cast("array<string>")).otherwise(F.col("reasons")))
    own = entries.select("source", group, *(F.col(s).alias(f"own_{s}") for s in SETS), F.col("status").alias("own_status"))
    return own.join(groups.drop("sticky", "first_status"), group)


def summary(entries: DataFrame) -> DataFrame:
    """Counts by status and total set sizes, in one row."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return entries.agg(F.count("*").alias("total"), *counts, *(F.sum(F.size(s)).alias(f"{s}_paths") for s in ("expected", "saved", "failed")))


def examples(entries: DataFrame, most: int = 5) -> DataFrame:
    """The first problem entries of each status: a report of so many rows a status."""
    order = Window.partitionBy("status").orderBy("source")  # Spark keeps `most` rows a group before the shuffle
    rows = entries.where(~F.col("status").isin("covered", *STICKY))
    ranked = rows.select("status", "source", F.row_number().over(order).alias("rank")).where(F.col("rank") <= most)
    return ranked.groupBy("status").agg(F.array_sort(F.collect_list("source")).alias("sources"))


def significant_gap(discovered: Column, accepted: Column) -> Column:
    missing = discovered - accepted
    return (discovered > 0) & (missing > 0) & (missing >= F.greatest(F.lit(GAP_LEAST), F.ceil(discovered * GAP_RATIO)))


def regression(current: Column, previous: Column) -> Column:
    return current < F.floor(previous * KEEP_RATIO)


def health(warnings: Column, failed: Column, unresolved: Column, partial: Column, verified: Column) -> Column:
    """verified, partial, unverified, failed or broken: the first branch that applies."""
    has = lambda prefix: F.exists(warnings, lambda w: w.startswith(prefix))
    limited = has("coverage-partial:max-pages-limited:")
    return (
        F.when(has("coverage-regression:"), "failed")
        .when(has("direct-json-failure:"), "broken")
        .when((failed > 0) | (unresolved > 0) | (partial > 0), "failed")
        .when(has("coverage-gap:") & ~limited, "failed")
        .when(verified, "verified")
        .when(limited, "partial")
        .otherwise("unverified")
    )


def uncrawled(discovered: DataFrame, accepted: DataFrame, skipped: DataFrame, route: str = "route") -> DataFrame:
    """Discovered routes that are neither accepted nor skipped by policy."""
    return discovered.select(route).distinct().join(accepted.select(route), route, "left_anti").join(skipped.select(route), route, "left_anti")


def covered_by_slug(routes: DataFrame, slugs: DataFrame) -> DataFrame:
    """Routes whose path, or whose parent path, is a known slug (column slug)."""
    bare = F.regexp_replace("route", r"^/+|/+$", "")
    parent = F.when(bare.contains("/"), F.regexp_replace(bare, r"/[^/]*$", ""))
    keys = routes.select("route", F.explode(F.array_compact(F.array(bare, parent))).alias("slug"))
    return routes.join(keys.join(slugs.select("slug").distinct(), "slug", "left_semi").select("route").distinct(), "route", "left_semi")


def uncrawled_counts(routes: DataFrame, aliases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Uncrawled routes by kind: alias, known, platform, legacy."""
    a = aliases.select("route").distinct().withColumn("is_alias", F.lit(True))
    c = candidates.select("route").distinct().withColumn("is_known", F.lit(True))
    kind = F.when(F.col("is_alias"), "alias").when(F.col("is_known"), "known").when(F.col("route").rlike(r"^/(android|ios|flutter|web)(/|$)"), "platform").otherwise("legacy")
    return routes.join(a, "route", "left").join(c, "route", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))

"""Routes: merging candidates, reconciling them with the route table, filtering, selecting within a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import singular_forms


def merge_candidates(rows: DataFrame, key: str, seq: str, first: list[str], last: list[str], sets: list[str]) -> DataFrame:
    """One row a key: the first non-empty value of some columns, the last non-null of others, united sets."""
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    aggs = [F.min_by(c, F.when(filled(c), F.col(seq))).alias(c) for c in first]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in last]
    aggs += [F.array_sort(F.collect_set(c)).alias(f"{c}_set") for c in sets]
    return rows.groupBy(key).agg(*aggs)


def merge_entries(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Entries of the route table by slug; fields that disagree are told in ``conflicts``."""
    aggs = [F.max(f).alias(f) for f in fields]
    differ = [F.when(F.min(f) != F.max(f), F.lit(f)) for f in fields]
    return rows.groupBy(key).agg(*aggs, F.array_compact(F.array(*differ)).alias("conflicts"))


def dedupe_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases (route, seq, alias): an alias belongs to the first route that names it; its own route is none."""
    real = aliases.where(F.col("alias") != F.col("route"))
    first = real.groupBy("alias").agg(F.min("seq").alias("first_seq"))
    return real.join(first, "alias").withColumn("kept", F.col("seq") == F.col("first_seq")).drop("first_seq")


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that holds; null: none."""
    return F.coalesce(*(F.when(check, F.lit(name)) for name, check in checks))


def reconcile(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates (route, document, collection, carbon) against entries (slug, alternates, document, collection, carbon).

    All rules' matches are united and the best rule of a candidate decides; a rule that
    must be unique and isn't makes the candidate ambiguous. Every rule is an equi-join.
    """
    c = candidates.select("route", "document", "collection", "carbon")
    component = lambda p: F.regexp_extract(p, r"^/?components/([^/]+)(?:/overview)?$", 1)

    def joined(rule: int, left: Column, right: Column, source: DataFrame, more: Column | None = None) -> DataFrame:
        e = source.select("slug", right.alias("__key"), F.col("document").alias("e_document"), F.col("collection").alias("e_collection")).where(F.col("__key").isNotNull() & (F.col("__key") != ""))
        rows = c.withColumn("__key", left).where(F.col("__key").isNotNull() & (F.col("__key") != "")).join(e, "__key")
        if more is not None:
            rows = rows.where(more)
        return rows.select("route", "slug", F.lit(rule).alias("rule"))

    slug = F.concat(F.lit("/"), F.regexp_replace("slug", r"^/+|/+$", ""))
    alternates = entries.withColumn("alternate", F.explode("alternates"))
    ids = lambda x: F.lower(F.col(x))
    forms_c = candidates.select("route", "document", "collection", "carbon", F.explode(singular_forms(component(F.col("route")))).alias("form")).where("form <> ''")
    forms_e = entries.select("slug", F.explode(singular_forms(component(F.col("slug")))).alias("form")).where("form <> ''")
    rules = [
        joined(1, F.col("route"), slug, entries),
        joined(2, F.col("route"), F.concat(F.lit("/"), F.regexp_replace("alternate", r"^/+|/+$", "")), alternates),
        joined(3, ids("carbon"), ids("carbon"), entries),
        joined(3, ids("document"), ids("document"), entries, F.lower("collection") == F.lower("e_collection")),
        forms_c.join(forms_e, "form").select("route", "slug", F.lit(4).alias("rule")),
    ]
    found = reduce(DataFrame.unionByName, rules).groupBy("route", "rule").agg(F.count_distinct("slug").alias("n"), F.min("slug").alias("slug"))
    best = found.groupBy("route").agg(F.min_by(F.struct("rule", "n", "slug"), "rule").alias("b"))
    names = F.when(F.col("b.rule") == 1, "exact").when(F.col("b.rule") == 2, "alternateSlug").when(F.col("b.n") > 1, "rejectedAmbiguous").when(F.col("b.rule") == 3, "contentIdentityMatch").when(F.col("b.rule") == 4, "normalizedSlugMatch").otherwise("rejectedStale")
    out = candidates.select("route").join(best, "route", "left")
    return out.select("route", names.alias("status"), F.when(names != "rejectedAmbiguous", F.col("b.slug")).alias("slug"))


def match_ranked(left: DataFrame, right: DataFrame, key: str, rules: list[tuple[str, str]]) -> DataFrame:
    """For each left row the match of the first rule that has one: rules are pairs of key columns within ``key``."""
    ids = left.columns
    found = []
    for rank, (a, b) in enumerate(rules, 1):
        r = right.select(F.col(key).alias("__k"), F.col(b).alias("__v"), "target")
        found.append(left.join(r, (F.col(key) == F.col("__k")) & (F.col(a) == F.col("__v"))).groupBy(*ids).agg(F.min("target").alias("target")).withColumn("rule", F.lit(rank)))
    best = reduce(DataFrame.unionByName, found).groupBy(*ids).agg(F.min_by(F.struct("rule", "target"), "rule").alias("b"))
    return best.select(*ids, "b.rule", "b.target")


def within_budget(routes: DataFrame, most: int, required: str, order: list) -> DataFrame:
    """Required routes always, and the best others up to ``most`` in all.

    The best are found by Spark's bounded top-k (each task keeps ``most`` rows), so
    there is no single-partition sort of the whole table.
    """
    must = routes.where(F.col(required))
    left = max(0, most - must.count())
    return must.unionByName(routes.where(~F.col(required)).orderBy(*order).limit(left))


def plan_summary(plan: DataFrame, by: str, most: int = 5) -> DataFrame:
    """Counts of plan entries by a column, with the first examples of each."""
    counts = plan.groupBy(by).agg(F.count("*").alias("n"))
    first = plan.select(by, "route", F.row_number().over(Window.partitionBy(by).orderBy("route")).alias("rank")).where(F.col("rank") <= most)
    return counts.join(first.groupBy(by).agg(F.array_sort(F.collect_list("route")).alias("examples")), by)


def buckets(plan: DataFrame) -> DataFrame:
    """Adds the bucket of a classified, reconciled candidate (status, class, public)."""
    bucket = (
        F.when((F.col("public") == False) | ~F.col("class").isin("public-docs"), "nonPublic")  # noqa: E712
        .when(F.col("status") == "rejectedAmbiguous", "ambiguous")
        .when(F.col("status") == "rejectedStale", "stale")
        .otherwise("accepted")
    )
    return plan.withColumn("bucket", bucket)


#: Sources of a route candidate, from the most trusted on.
SOURCES = ("site_meta", "nav_drawer", "sitemap", "rendered_nav")


def candidate_priority(sources: Column) -> Column:
    """Place of a candidate by the most trusted of the sources that name it."""
    out = F.when(F.lit(False), 0)
    for place, source in enumerate(SOURCES):
        out = out.when(F.array_contains(sources, source), place)
    return out.otherwise(len(SOURCES))


def candidate_order(sources: Column, route: Column) -> list[Column]:
    """The order in which candidates are tried: trusted sources, short routes, then by name."""
    return [candidate_priority(sources), F.length(route), route]


def site_meta_counts(entries: DataFrame) -> DataFrame:
    """One row of counts of site-map entries (route, public, redirect, aliases): public, private, redirect and alias.

    Private entries count as that alone, then those that redirect elsewhere; the rest is
    public, with its aliases but for its own route.
    """
    hidden = ~F.coalesce("public", F.lit(True))
    away = F.coalesce("redirect", F.lit("")) != ""
    others = F.size(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a != F.col("route")))
    open_ = ~hidden & ~away
    return entries.agg(F.count_if(open_).alias("public"), F.count_if(hidden).alias("private"), F.count_if(~hidden & away).alias("redirect"), F.coalesce(F.sum(F.when(open_, others)), F.lit(0)).cast("long").alias("alias"))


def rejected_summary(plan: DataFrame | None, coverage: DataFrame | None, graph: DataFrame | None, skipped: int = 0) -> DataFrame:
    """One row: stale public routes and where their list is from, routes skipped by policy, routes without content.

    plan and coverage: (route, stale, class), the plan preferred; graph: (route, status), which
    tells best what has no content.
    """
    source = "routePlanSummary" if plan is not None else "coverageDiagnostics.fullRoutePlanSummary" if coverage is not None else "unavailable"
    listed = plan if plan is not None else coverage
    some = next(x for x in (listed, graph) if x is not None)
    stale = F.count_if(F.col("stale") & (F.col("class") == "public-docs")) if listed is not None else F.lit(0).cast("long")
    empty = F.count_if(F.col("class") == "non-content-index") if listed is not None else F.lit(0).cast("long")
    one = some.agg(stale.alias("stale_public"), empty.alias("non_content"))
    if graph is not None:
        one = one.drop("non_content").crossJoin(graph.agg(F.count_if(F.col("status") == "nonContent").alias("non_content")))  # one row each
    return one.select("stale_public", F.lit(source).alias("source"), F.lit(skipped).cast("long").alias("policy_skipped"), "non_content")

"""The promotion gate over tables: facts of each run taken from what it wrote, and every check decided by them.

A run is a snapshot that may replace the one before it. Its facts are counts of its own tables by
run, which combine in the tasks, so the gate of one run or of thousands is one job; nothing
is decided on the driver. ``gate_rows`` says of each run which of the checks it passes, in
the order in which the first failure is reported.

Expected columns (further ones are ignored):

* runs: run, min_pages, page_count, full_run, include_blog, partial, warnings, resolvable, blog_routes,
  planned (null: a run without diagnostics), discovered, previous_discovered, previous_pages, previous_gap,
  force
* pages: run, path, content, suspicious
* notes: run, blog, bundle, direct, saved, rejected, virtual_saved, virtual_failed, token_tables, tokens_rendered
* coverage: run, path, status, accepted
* candidates: run, ambiguous, covered
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages that every full snapshot has, and the statuses of a route that isn't covered.
SAMPLES = ("components/buttons/specs", "components/lists/specs", "styles/color/roles", "foundations/design-tokens/overview")
UNCOVERED, NOT_SELECTED = ("unresolved", "failed", "partial"), "not-selected"
#: Share of failures or of loss that is too much, and from how many attempts on a share counts.
RATIO, ENOUGH, SLACK = 0.2, 10, 5
#: Checks in order; the first two are about the index alone and hold even if the gate is forced.
CHECKS = (
    "enough-pages", "page-count-matches", "no-direct-json-failure", "planned-accounted", "few-unattempted", "bundle-saved", "no-blog", "token-tables-rendered", "no-duplicate-content",
    "no-suspicious-pages", "no-unexplained-gap", "source-failures", "virtual-failures", "legacy-failures", "discovered-kept", "pages-kept", "samples-saved", "routes-covered", "no-ambiguity",
)


def run_facts(runs: DataFrame, pages: DataFrame, notes: DataFrame, coverage: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row for each run: its own columns and the counts of its tables; a run without rows has zeros."""
    sample = F.regexp_replace("path", r"\.md$", "").isin(*SAMPLES)
    listed = pages.groupBy("run").agg(F.count("*").alias("listed_pages"), F.count_if("suspicious").alias("suspicious_pages"))
    content = pages.groupBy("run", F.sha2("content", 256).alias("c")).agg(F.count("*").alias("n"))
    doubled = content.groupBy("run").agg(F.count_if((F.col("n") > 1) & F.col("c").isNotNull()).alias("duplicate_groups"))
    n = lambda cond, name: F.count_if(cond).alias(name)
    c = F.col
    noted = notes.groupBy("run").agg(
        F.count("*").alias("attempted"), n(~c("saved"), "failed_routes"), n(c("bundle") & c("direct"), "bundle_attempts"), n(c("bundle") & c("direct") & c("saved"), "bundle_saved"), n("blog", "blog_attempts"),
        F.sum("virtual_saved").alias("virtual_saved"), F.sum("virtual_failed").alias("virtual_failed"), F.sum("token_tables").alias("token_tables"), F.sum("tokens_rendered").alias("tokens_rendered"),
    )
    covered = coverage.groupBy("run").agg(n(c("accepted") & c("status").isin(*UNCOVERED), "uncovered_routes"))
    asked = candidates.groupBy("run").agg(n("ambiguous", "ambiguous_routes"), n(~c("covered"), "uncovered_candidates"))
    # a sample counts as saved if its page is there, or if the run didn't select its route
    found = pages.where(sample).select("run", "path").union(coverage.where(sample & (c("status") == NOT_SELECTED)).select("run", "path"))
    samples = found.groupBy("run").agg(F.count_distinct(F.regexp_replace("path", r"\.md$", "")).alias("samples"))
    out = reduce(lambda a, b: a.join(b, "run", "left"), (listed, doubled, noted, covered, asked, samples), runs)
    return out.na.fill(0, ["listed_pages", "suspicious_pages", "duplicate_groups", "attempted", "failed_routes", "bundle_attempts", "bundle_saved", "blog_attempts", "virtual_saved", "virtual_failed", "token_tables", "tokens_rendered", "uncovered_routes", "ambiguous_routes", "uncovered_candidates", "samples"])


def verdicts() -> list[Column]:
    """Whether each of CHECKS is passed, over the columns of run_facts()."""
    c = F.col
    many = lambda bad, of: (of >= ENOUGH) & (bad / of > RATIO)
    kept = lambda now, before: before.isNull() | (now >= F.ceil((1 - RATIO) * before))
    expected = F.when(c("include_blog"), c("resolvable")).otherwise(F.greatest(F.lit(0), c("resolvable") - F.coalesce("blog_routes", F.lit(0))))
    full, noted = c("full_run"), c("planned").isNotNull()
    return [
        c("page_count") >= c("min_pages"),
        c("listed_pages") == c("page_count"),
        ~F.exists("warnings", lambda w: w.startswith("direct-json-failure:")),
        ~noted | (c("planned") == c("virtual_saved") + c("virtual_failed")),
        ~full | c("resolvable").isNull() | (expected - c("attempted") < F.greatest(F.lit(SLACK), F.ceil(RATIO * expected))) | (expected <= c("attempted")),
        (c("bundle_attempts") == 0) | (c("bundle_saved") > 0),
        c("include_blog") | (c("blog_attempts") == 0),
        (c("token_tables") == 0) | (c("tokens_rendered") > 0),
        c("duplicate_groups") == 0,
        c("suspicious_pages") == 0,
        ~(full & c("previous_gap")),
        ~many(c("failed_routes"), c("attempted")),
        ~noted | ~many(c("virtual_failed"), c("planned")),
        noted | ~many(c("failed_routes"), c("attempted")),
        c("partial") | kept(c("discovered"), c("previous_discovered")),
        kept(c("page_count"), c("previous_pages")),
        c("samples") == len(SAMPLES),
        ~(full & (c("uncovered_routes") > 0)),
        ~(full & ((c("ambiguous_routes") > 0) | (c("uncovered_candidates") > 0))),
    ]


def gate_rows(facts: DataFrame) -> DataFrame:
    """(run, place, name, passed): every check of every run, in order; a forced run passes all but the first two."""
    passed = [F.coalesce(v, F.lit(False)) | ((F.col("force") if i > 1 else F.lit(False))) for i, v in enumerate(verdicts())]
    checks = F.posexplode(F.array(*[F.struct(F.lit(name).alias("name"), p.alias("passed")) for name, p in zip(CHECKS, passed, strict=True)])).alias("place", "c")
    return facts.select("run", checks).select("run", "place", "c.name", "c.passed")

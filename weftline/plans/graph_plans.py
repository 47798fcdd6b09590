"""Queries for coverage, routes, graph joins, tokens, upserts and checks, over the star-schema tables.

The tables stand in for a snapshot: orders for routes, lineitems for their output
paths, parts for resources, customers and suppliers for candidates and entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import checks, coverage, graph, quality, routes, snapshot, tokens
from ..sources.tables import table


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as coverage entries: a line is saved, failed or skipped by its flag; every third line of 'N' is neither."""
    path = F.concat(F.lit("p"), F.col("l_linenumber").cast("string"))
    flag = lambda f: F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == f, path)))
    waits = (F.col("l_returnflag") == "N") & (F.col("l_linenumber") % 3 != 0)
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("source")).agg(
        F.array_sort(F.collect_set(path)).alias("expected"), flag("A").alias("saved"), flag("R").alias("failed"), F.array_sort(F.collect_set(F.when(waits, path))).alias("skipped")
    )  # at most seven lines an order
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("grp"), F.when(F.col("o_orderpriority") == "5-LOW", "policySkipped").otherwise("unresolved").alias("given"))
    rows = orders.join(lines, "source", "left")
    empty = F.array().cast("array<string>")
    rows = rows.select("source", "grp", "given", *(F.coalesce(s, empty).alias(s) for s in coverage.SETS))
    own = coverage.status(*(F.col(s) for s in coverage.SETS), given=F.col("given"))
    reasons = F.when(F.size("failed") > 0, F.array(F.lit("alias-only-source-route"), F.concat(F.lit("failed-"), F.size("failed").cast("string")))).otherwise(empty)
    return rows.withColumn("status", own).withColumn("reasons", reasons)


_ENTRIES = """l AS (SELECT l_orderkey AS source, list_sort(list(DISTINCT 'p' || l_linenumber)) AS expected,
  coalesce(list_sort(list(DISTINCT 'p' || l_linenumber) FILTER (l_returnflag = 'A')), []) AS saved, coalesce(list_sort(list(DISTINCT 'p' || l_linenumber) FILTER (l_returnflag = 'R')), []) AS failed,
  coalesce(list_sort(list(DISTINCT 'p' || l_linenumber) FILTER (l_returnflag = 'N' AND l_linenumber % 3 <> 0)), []) AS skipped FROM lineitem GROUP BY 1),
e0 AS (SELECT o_orderkey AS source, o_custkey AS grp, CASE WHEN o_orderpriority = '5-LOW' THEN 'policySkipped' ELSE 'unresolved' END AS given,
  coalesce(expected, []) AS expected, coalesce(saved, []) AS saved, coalesce(failed, []) AS failed, coalesce(skipped, []) AS skipped FROM orders LEFT JOIN l ON o_orderkey = source),
e AS (SELECT *, CASE WHEN given = 'policySkipped' THEN given WHEN len(expected) = 0 THEN 'unresolved' WHEN list_has_all(saved, expected) THEN 'covered' WHEN len(saved) > 0 THEN 'partial'
  WHEN list_has_all(failed, expected) THEN 'failed' WHEN list_has_all(skipped, expected) THEN 'skipped' ELSE 'unresolved' END AS status FROM e0)"""


def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("source", "status", F.array_join("expected", ",").alias("expected"))


def shared_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coverage.shared(_entries(spark, sf_dir), "grp")
    return rows.select("source", "grp", "own_status", "status", "members", F.array_join("saved", ",").alias("saved"), F.array_join("reasons", ",").alias("reasons"))


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.summary(_entries(spark, sf_dir))


def coverage_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health by the hour of the day: an hour's events are accepted routes of those of the hour before."""
    hours = table(spark, sf_dir, "events").groupBy(F.hour("ts").cast("long").alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("ok"))
    before = hours.select((F.col("h") + 1).alias("h"), F.col("n").alias("was"))
    rows = hours.join(before, "h", "left")
    gap, lost = coverage.significant_gap(F.col("n"), F.col("ok")), F.coalesce(coverage.regression(F.col("n"), F.col("was")), F.lit(False))
    warnings = F.array_compact(F.array(F.when(gap, "coverage-gap:x"), F.when(lost, "coverage-regression:x"), F.when(F.col("h") % 4 == 0, "coverage-partial:max-pages-limited:x")))
    zero = F.lit(0)
    return rows.select("h", "n", "ok", gap.alias("gap"), lost.alias("regression"), coverage.health(warnings, zero, zero, zero, F.col("h") % 2 == 1).alias("health"))


def source_virtual_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return quality.source_counters(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), (flag == "A").alias("saved"), (flag == "R").alias("failed"), (F.col("l_linenumber") == 7).alias("skipped")))


def route_diag_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_returnflag") == "A").alias("saved"), (c("l_returnflag") == "R").alias("failed"), c("l_quantity").cast("int").alias("text_length"), c("l_linenumber").cast("long").alias("tables"), F.when(c("l_linestatus") == "O", c("l_quantity").cast("long")).alias("rendered"), F.when(c("l_linenumber") > 3, F.lit(2)).alias("requested"))
    return quality.page_totals(rows)


def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.col(c).cast("long").alias("key")
    one = table(spark, sf_dir, "customer").select(key("c_nationkey"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("kind"), F.lit("customer").alias("origin"))
    two = table(spark, sf_dir, "supplier").select(key("s_nationkey"), (F.col("s_suppkey") + 10**9).alias("seq"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("kind"), F.lit("supplier").alias("origin"))
    rows = one.unionByName(two).withColumn("last_origin", F.col("origin"))
    rows = routes.merge_candidates(rows, "key", "seq", ["title", "kind"], ["last_origin"], ["origin"])
    return rows.select("key", "title", "kind", "last_origin", F.array_join("origin_set", ",").alias("origins"))


def alias_dedupe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("route"), F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 40).cast("string").alias("alias"))
    return routes.dedupe_aliases(rows).agg(F.count("*").alias("aliases"), F.count_if(F.col("kept")).alias("kept"), F.count_if(~F.col("kept")).alias("deduplicated"))


def reconcile_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    mod, text_ = (n % 400), lambda c: c.cast("string")
    candidates = table(spark, sf_dir, "customer").select(F.concat(F.lit("/components/c"), text_(mod), F.when(n % 5 == 0, "s").otherwise("")).alias("route"), F.when(n % 3 == 0, F.concat(F.lit("D"), text_(n % 70))).alias("document"), F.lit("x").alias("collection"), F.when(n % 7 == 0, F.concat(F.lit("C"), text_(n % 90))).alias("carbon"), n.alias("id"))
    first = candidates.groupBy("route").agg(F.min_by(F.struct("document", "collection", "carbon"), "id").alias("r")).select("route", "r.*")
    s = F.col("s_suppkey")
    entries = table(spark, sf_dir, "supplier").select(F.concat(F.lit("components/c"), text_(s * 3)).alias("slug"), F.array(F.concat(F.lit("components/c"), text_(s * 7))).alias("alternates"), F.concat(F.lit("d"), text_(s % 60)).alias("document"), F.lit("X").alias("collection"), F.concat(F.lit("c"), text_(s)).alias("carbon"))
    return routes.reconcile(first, entries)


def tab_section_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's target: the first turn of the same conversation with the same opening word, else of the same role."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.nullif(F.regexp_extract(F.lower("text"), "[a-z0-9]+", 0), F.lit("")).alias("head"))
    targets = rows.where("turn % 2 = 1").select("conv_id", F.col("role"), F.col("head"), F.col("turn").alias("target"))
    left = rows.where("turn % 2 = 0").select("conv_id", "turn", "role", "head")
    return routes.match_ranked(left, targets, "conv_id", [("head", "head"), ("role", "role")]).select("conv_id", "turn", F.col("rule").cast("long").alias("rule"), "target")


def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    reason = routes.first_reason([("private", c("o_orderstatus") == "P"), ("redirect", c("o_orderpriority") == "1-URGENT"), ("blog", classify.is_blog(F.concat(F.lit("/"), F.date_format("o_orderdate", "yyyy"), F.lit("/x"))) & (c("o_totalprice") > 100000))])
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def budget_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection within a budget of 200 routes: the feature's own limit."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") > 450000).alias("required"))
    return routes.within_budget(rows, 200, "required", [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "required")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return snapshot.upsert_in_place(rows, "user_id", "event_id")


def upsert_append_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return snapshot.upsert_append(rows, "user_id", "event_id")


def best_context_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    tags = F.array_compact(F.array(F.when(c("l_returnflag") == "A", "light"), F.when(c("l_returnflag") == "R", "dark"), F.when(c("l_linestatus") == "F", "3p"), F.when(c("l_linenumber") == 2, "high.contrast"), F.when(c("l_linenumber") == 5, "web"), F.when(c("l_quantity") < 10, "standard.contrast")))
    rows = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("token"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("seq"), F.when(c("l_discount") > 0.08, F.lit(None)).otherwise(tags).alias("tags"), (c("l_tax") > 0.07).alias("undefined"))
    return tokens.best_entries(rows, ["token"], "seq").select("token", "seq", F.col("score").cast("long").alias("score"))


def prefix_token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit("/"), F.col("p_partkey").cast("string"))
    sets = part.select(F.lower(F.regexp_replace(F.replace("p_type", F.lit(" "), F.lit("/")), "/[^/]*$", "/")).alias("set_name")).distinct()
    toks = part.select(names.alias("token_name"), "p_retailprice")
    return tokens.prefix_join(sets, toks, "set_name", "token_name").groupBy("set_name").agg(F.count("*").alias("n"), F.min("token_name").alias("first_token"))


def token_value_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    size = (c("p_size") % 11) / 10.0
    red = F.when(c("p_partkey") % 4 != 0, size)
    alpha = F.when(c("p_partkey") % 3 == 0, F.lit(0.5))
    value = F.when(c("p_partkey") % 5 != 0, c("p_size").cast("double") / 2)
    of = F.when(c("p_size") % 3 == 0, "DIPS").when(c("p_size") % 3 == 1, "SP").otherwise("PERCENT")
    return table(spark, sf_dir, "part").select("p_partkey", tokens.colour(red, size, F.lit(None).cast("double"), alpha).alias("colour"), tokens.strict_colour(red, size, size, alpha).alias("strict_colour"), tokens.dimension(value, of).alias("dimension"), tokens.strict_dimension(value, of).alias("strict_dimension"))


def alias_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("top"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().join(rows, "conv_id")
    links = turns.select(F.struct("conv_id", "turn").alias("a"), F.when(F.col("turn") < F.col("top"), F.struct("conv_id", (F.col("turn") + 1).alias("turn"))).alias("b"))
    shown = lambda c: (F.col(f"{c}.conv_id") * 1000 + F.col(f"{c}.turn")).alias(c)
    return graph.follow_chain(links, "a", "b").select(shown("node"), shown("end"), "steps")


def section_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, their lines as sections in order, with the first word as label."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("lines"))
    flat = graph.flatten(rows, "lines")
    return flat.groupBy("conv_id", "turn").agg(F.count("*").alias("sections"), F.min_by("item", "pos").alias("first_section"), F.max("pos").cast("long").alias("last_pos"))


def status_table_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(f"status_{s.lower()}") for s in ("F", "O", "P")))


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("resource_id"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("seq"), c("l_returnflag").alias("route"), (c("l_suppkey") % 5).alias("page_id"), F.when(c("l_linestatus") == "F", "resolved").otherwise("unresolved").alias("status"), F.when(c("l_linenumber") == 1, c("l_orderkey")).alias("artifact_id"), F.when(c("l_linenumber") == 2, c("l_linestatus")).alias("name"))


def resource_upsert_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_resources(_uses(spark, sf_dir)).select("resource_id", "status", "artifact_id", "name", "uses", F.array_join("routes", ",").alias("routes"), F.array_join("pages", ",").alias("pages"))


def resource_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("resource_id"))
    chunks = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("resource_id"), (F.col("l_suppkey") % 7).cast("string").alias("page_id"))
    return graph.back_fill(parts, chunks).select("resource_id", F.array_join("page_ids", ",").alias("pages"))


def provenance_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name")]
    return graph.provenance([(t, table(spark, sf_dir, t), key, [F.col(name).alias("fact")]) for t, key, name in parts])


def anti_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    old = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("key"), F.col("c_name").alias("name"))
    return graph.prefer(new, old, "key")


def token_resolution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    cells = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("table"), c("l_partkey").alias("token"), (c("l_returnflag") == "N").alias("resolved"), F.when(c("l_linenumber") == 1, "other").when(c("l_returnflag") == "A", "missing-context-entry").when(c("l_linenumber") == 2, "upstream-empty").alias("reason"))
    return tokens.resolution(cells)


def component_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("component"), F.col("c_mktsegment").alias("kind"))
    return graph.component_overview(rows, "component", kinds)


def referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    pairs = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id")]
    return checks.run_all([checks.expectation(i, f"{a}.{k}", checks.orphans(t(a), k, t(b), p), "orphan") for i, (a, k, b, p) in enumerate(pairs)]).select(F.col("place").cast("long").alias("place"), "stage", "passed", "bad", F.array_join("reasons", ",").alias("reasons"))


def capture_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' names as labels against regions' names, within the page of a region key."""
    labels = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("page"), F.col("n_name").alias("label"))
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("page"), F.substring("r_name", 1, 2).alias("name"))
    return checks.missing_labels(labels, names)


def uncrawled_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = lambda c: F.concat(F.when(c % 3 == 0, "/android/").otherwise("/x/"), c.cast("string")).alias("route")
    found = table(spark, sf_dir, "customer").select(route(F.col("c_custkey")))
    accepted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(route(F.col("o_custkey")))
    policy = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(route(F.col("o_custkey")))
    rest = coverage.uncrawled(found, accepted, policy)
    alias = table(spark, sf_dir, "customer").where("c_custkey % 10 = 1").select(route(F.col("c_custkey")))
    known = table(spark, sf_dir, "customer").where("c_custkey % 10 = 2").select(route(F.col("c_custkey")))
    return coverage.uncrawled_counts(rest, alias, known)


def manifest_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
    return snapshot.manifest_counts({n: table(spark, sf_dir, n) for n in names})


def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate for each order: its checks as rows, in order; the first that fails decides."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("grp")).agg(F.count("*").alias("pages"), F.count_if(c("l_returnflag") == "R").alias("failed"), F.count_distinct("l_partkey").alias("distinct_pages"))
    rows = lines.join(table(spark, sf_dir, "orders").select(c("o_orderkey").alias("grp"), "o_orderstatus"), "grp")
    stack = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), ok.alias("passed")) for i, (n, ok) in enumerate([("enough-pages", c("pages") >= 3), ("source-failures", ~quality.failure_ratio(c("failed"), c("pages"), 4, 0.3)), ("no-duplicate-content", c("pages") == c("distinct_pages")), ("routes-covered", c("o_orderstatus") != "P")]))))
    return snapshot.decided(rows.select("grp", stack.alias("x")).select("grp", "x.*"))


def eta_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    done, ms = c("n"), c("ms")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.timestamp_diff("MILLISECOND", F.min("ts"), F.max("ts")).alias("ms"))
    enough = (done >= 3) & (ms >= 10000)
    left = F.greatest(F.lit(0), F.lit(50) - done)
    remaining = F.when(enough, F.floor(left * ms / done + 0.5).cast("long"))
    return rows.select("user_id", "n", "ms", remaining.alias("remaining_ms"), text.duration(F.col("ms")).alias("elapsed"))


def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.progress import throttled

    return throttled(table(spark, sf_dir, "events"), "ts", "1 hour", "event_id", ["event_type", "user_id"])


def stable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user that repeats the type of the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("before"))
    return rows.where("event_type = before").groupBy("user_id").agg(F.min("event_id").alias("stable_at"), F.count("*").alias("repeats"))


def blog_reuse_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders older than the year before the last year are reused; the rest is fetched again, by year."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    last = rows.agg(F.max("year").alias("last"))
    return rows.crossJoin(F.broadcast(last)).groupBy("year", (F.col("year") < F.col("last") - 1).alias("reused")).agg(F.count("*").alias("n"))  # last: one row


def debug_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("props").alias("name"))
    return snapshot.debug_names(rows, ["user_id"], "event_type", "name", "event_id").select("event_id", "file", "stable_id")


def response_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", c("l_linenumber").cast("long"))
    found = [(c("l_returnflag") == "A", 8), (c("l_linestatus") == "F", 10), (c("l_quantity") > 25, 2), (c("l_discount") > 0.05, 1)]
    return quality.response_argmax(rows, "l_orderkey", "seq", found).select("l_orderkey", "seq", c("score").cast("long").alias("score"))


def list_routes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of a status with a flag for their pages and the total, first hundred: the tool's own limit."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("key"))
    flagged = checks.with_flag(rows, "key", big, "has_page")
    total = rows.agg(F.count("*").alias("total_matched"))
    return flagged.orderBy("key").limit(100).crossJoin(F.broadcast(total)).select("key", "has_page", "total_matched")  # total: one row


_TAGS = "tags IS NULL OR NOT (list_contains(tags, 'web') OR list_contains(tags, 'dark') OR list_contains(tags, 'high.contrast'))"
QUERIES = {
    "coverage_status": (coverage_status, f"WITH {_ENTRIES} SELECT source, status, array_to_string(expected, ',') AS expected FROM e"),
    "shared_coverage": (shared_coverage, f"""WITH {_ENTRIES}, g AS (SELECT grp, count(*) AS members, bool_and(status = 'policySkipped') AS sticky,
  list_sort(list_distinct(flatten(list(expected)))) AS expected, list_sort(list_distinct(flatten(list(saved)))) AS saved, list_sort(list_distinct(flatten(list(failed)))) AS failed, list_sort(list_distinct(flatten(list(skipped)))) AS skipped,
  list_sort(list(DISTINCT 'failed-' || len(e.failed)) FILTER (len(e.failed) > 0)) AS reasons FROM e GROUP BY grp),
s AS (SELECT *, CASE WHEN sticky THEN 'policySkipped' WHEN len(expected) = 0 THEN 'unresolved' WHEN list_has_all(saved, expected) THEN 'covered' WHEN len(saved) > 0 THEN 'partial'
  WHEN list_has_all(failed, expected) THEN 'failed' WHEN list_has_all(skipped, expected) THEN 'skipped' ELSE 'unresolved' END AS status FROM g)
SELECT e.source, grp, e.status AS own_status, s.status, members, array_to_string(s.saved, ',') AS saved, CASE WHEN s.status = 'covered' THEN '' ELSE coalesce(array_to_string(reasons, ','), '') END AS reasons FROM e JOIN s USING (grp)"""),
    "coverage_summary": (coverage_summary, f"""WITH {_ENTRIES} SELECT count(*) AS total, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in coverage.STATUSES)},
  sum(len(e.expected))::BIGINT AS expected_paths, sum(len(e.saved))::BIGINT AS saved_paths, sum(len(e.failed))::BIGINT AS failed_paths FROM e"""),
    "coverage_health": (coverage_health, """WITH h AS (SELECT hour(ts)::BIGINT AS h, count(*) AS n, count(*) FILTER (value > 50) AS ok FROM events GROUP BY 1),
x AS (SELECT a.*, a.n > 0 AND a.n > a.ok AND a.n - a.ok >= greatest(5, ceil(a.n * 0.2)) AS gap, coalesce(a.n < floor(b.n * 0.8), false) AS regression FROM h a LEFT JOIN h b ON b.h = a.h - 1)
SELECT *, CASE WHEN regression THEN 'failed' WHEN gap AND h % 4 <> 0 THEN 'failed' WHEN h % 2 = 1 THEN 'verified' WHEN h % 4 = 0 THEN 'partial' ELSE 'unverified' END AS health FROM x"""),
    "source_virtual_counters": (source_virtual_counters, """WITH p AS (SELECT l_orderkey, count(*) AS v, count(*) FILTER (l_returnflag = 'A') AS ok, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1)
SELECT count(*) AS sources, count(*) FILTER (ok > 0) AS sources_saved, count(*) FILTER (ok = 0 AND bad > 0) AS sources_failed, sum(v)::BIGINT AS virtual_pages, sum(ok)::BIGINT AS virtual_saved, sum(bad)::BIGINT AS virtual_failed FROM p"""),
    "route_diag_rollup": (route_diag_rollup, """SELECT count(*) AS pages, count(*) FILTER (l_returnflag = 'A') AS saved, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'A' AND trunc(l_quantity) < 80) AS short,
  sum(l_linenumber)::BIGINT AS tables, sum(greatest(0, l_linenumber - CASE WHEN l_linestatus = 'O' THEN trunc(l_quantity)::BIGINT ELSE 0 END))::BIGINT AS not_rendered, sum(CASE WHEN l_linenumber > 3 THEN 2 ELSE l_linenumber END)::BIGINT AS requested FROM lineitem"""),
    "candidate_merge": (candidate_merge, """WITH u AS (SELECT c_nationkey::BIGINT AS key, c_custkey AS seq, c_name AS title, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS kind, 'customer' AS origin FROM customer
  UNION ALL SELECT s_nationkey, s_suppkey + 1000000000, s_name, NULL, 'supplier' FROM supplier)
SELECT key, arg_min(title, seq) AS title, arg_min(kind, seq) FILTER (kind IS NOT NULL) AS kind, arg_max(origin, seq) AS last_origin, array_to_string(list_sort(list(DISTINCT origin)), ',') AS origins FROM u GROUP BY key"""),
    "alias_dedupe_counts": (alias_dedupe_counts, """WITH a AS (SELECT c_custkey AS seq, c_custkey % 40 AS alias FROM customer WHERE c_custkey <> c_custkey % 40), r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY seq) = 1 AS kept FROM a)
SELECT count(*) AS aliases, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS deduplicated FROM r"""),
    "reconcile_cascade": (reconcile_cascade, r"""WITH c0 AS (SELECT c_custkey AS id, '/components/c' || (c_custkey % 400) || CASE WHEN c_custkey % 5 = 0 THEN 's' ELSE '' END AS route, CASE WHEN c_custkey % 3 = 0 THEN 'd' || (c_custkey % 70) END AS document, CASE WHEN c_custkey % 7 = 0 THEN 'c' || (c_custkey % 90) END AS carbon FROM customer),
c AS (SELECT route, first(document ORDER BY id) AS document, first(carbon ORDER BY id) AS carbon FROM c0 GROUP BY route),
e AS (SELECT 'components/c' || (s_suppkey * 3) AS slug, '/components/c' || (s_suppkey * 7) AS alt, 'd' || (s_suppkey % 60) AS document, 'c' || s_suppkey AS carbon FROM supplier),
f AS (SELECT route, unnest(list_distinct(CASE WHEN t LIKE '%es' AND length(t) > 3 THEN [t, substr(t, 1, length(t) - 2), substr(t, 1, length(t) - 1)] WHEN t LIKE '%s' AND length(t) > 2 THEN [t, substr(t, 1, length(t) - 1)] ELSE [t] END)) AS form FROM (SELECT route, substr(route, 13) AS t FROM c)),
m AS (SELECT route, slug, 1 AS rule FROM c JOIN e ON route = '/' || slug UNION ALL SELECT route, slug, 2 FROM c JOIN e ON route = alt UNION ALL SELECT route, slug, 3 FROM c JOIN e ON c.carbon = e.carbon OR c.document = e.document
  UNION ALL SELECT route, slug, 4 FROM f JOIN e ON form = substr(slug, 12)),
n AS (SELECT route, rule, count(DISTINCT slug) AS n, min(slug) AS slug FROM m GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY rule) AS r FROM n),
s AS (SELECT c.route, b.slug, CASE WHEN rule = 1 THEN 'exact' WHEN rule = 2 THEN 'alternateSlug' WHEN n > 1 THEN 'rejectedAmbiguous' WHEN rule = 3 THEN 'contentIdentityMatch' WHEN rule = 4 THEN 'normalizedSlugMatch' ELSE 'rejectedStale' END AS status FROM c LEFT JOIN b ON b.route = c.route AND r = 1)
SELECT route, status, CASE WHEN status <> 'rejectedAmbiguous' THEN slug END AS slug FROM s"""),
    "tab_section_match": (tab_section_match, """WITH t AS (SELECT conv_id, turn, role, nullif(regexp_extract(lower(text), '[a-z0-9]+'), '') AS head FROM conversations), m AS (
  SELECT a.conv_id, a.turn, 1 AS rule, min(b.turn) AS target FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.head = b.head AND b.turn % 2 = 1 WHERE a.turn % 2 = 0 GROUP BY 1, 2
  UNION ALL SELECT a.conv_id, a.turn, 2, min(b.turn) FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.role = b.role AND b.turn % 2 = 1 WHERE a.turn % 2 = 0 GROUP BY 1, 2)
SELECT conv_id, turn, min(rule)::BIGINT AS rule, arg_min(target, rule) AS target FROM m GROUP BY 1, 2"""),
    "filter_reasons": (filter_reasons, """SELECT CASE WHEN o_orderstatus = 'P' THEN 'private' WHEN o_orderpriority = '1-URGENT' THEN 'redirect' WHEN year(o_orderdate) BETWEEN 2000 AND 2099 AND o_totalprice > 100000 THEN 'blog' ELSE 'kept' END AS reason, count(*) AS n FROM orders GROUP BY 1"""),
    "budget_selection": (budget_selection, """WITH r AS (SELECT o_orderkey, o_totalprice > 450000 AS required, row_number() OVER (PARTITION BY o_totalprice > 450000 ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_orderkey, required FROM r WHERE required OR rn <= greatest(0, 200 - (SELECT count(*) FROM orders WHERE o_totalprice > 450000))"""),
    "upsert_latest": (upsert_latest, "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(event_id) AS position FROM events GROUP BY user_id"),
    "upsert_append_order": (upsert_append_order, "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS position FROM events GROUP BY user_id"),
    "best_context_entry": (best_context_entry, f"""WITH x AS (SELECT l_partkey AS token, l_orderkey * 8 + l_linenumber AS seq, l_tax > 0.07 AS undefined, CASE WHEN l_discount > 0.08 THEN NULL ELSE list_filter([CASE WHEN l_returnflag = 'A' THEN 'light' END, CASE WHEN l_returnflag = 'R' THEN 'dark' END,
  CASE WHEN l_linestatus = 'F' THEN '3p' END, CASE WHEN l_linenumber = 2 THEN 'high.contrast' END, CASE WHEN l_linenumber = 5 THEN 'web' END, CASE WHEN l_quantity < 10 THEN 'standard.contrast' END], lambda t: t IS NOT NULL) END AS tags FROM lineitem),
s AS (SELECT token, seq, CASE WHEN tags IS NULL THEN -1 ELSE CASE WHEN list_contains(tags, 'light') THEN 8 ELSE 0 END + CASE WHEN list_contains(tags, '3p') THEN 4 ELSE 0 END + CASE WHEN list_contains(tags, 'standard.contrast') THEN 1 ELSE 0 END END::BIGINT AS score
  FROM x WHERE NOT undefined AND ({_TAGS})), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, seq) AS rn FROM s) SELECT token, seq, score FROM r WHERE rn = 1"""),
    "prefix_token_join": (prefix_token_join, """WITH t AS (SELECT lower(replace(p_type, ' ', '/')) || '/' || p_partkey AS token_name FROM part), s AS (SELECT DISTINCT lower(regexp_replace(replace(p_type, ' ', '/'), '/[^/]*$', '/')) AS set_name FROM part)
SELECT set_name, count(*) AS n, min(token_name) AS first_token FROM s JOIN t ON starts_with(token_name, set_name) GROUP BY 1"""),
    "token_value_format": (token_value_format, r"""WITH x AS (SELECT p_partkey, (p_size % 11) / 10.0::DOUBLE AS s, CASE WHEN p_partkey % 4 <> 0 THEN (p_size % 11) / 10.0::DOUBLE END AS r, p_partkey % 3 = 0 AS half, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 2.0::DOUBLE END AS v,
  CASE p_size % 3 WHEN 0 THEN 'dp' WHEN 1 THEN 'sp' ELSE 'percent' END AS u FROM part),
y AS (SELECT *, floor(coalesce(r, 0) * 255 + 0.5)::BIGINT AS r8, floor(s * 255 + 0.5)::BIGINT AS s8, CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END AS vt FROM x)
SELECT p_partkey, CASE WHEN half THEN 'rgba(' || r8 || ', ' || s8 || ', 0, 0.50)' ELSE '#' || lpad(lower(to_hex(r8)), 2, '0') || lpad(lower(to_hex(s8)), 2, '0') || '00' END AS colour,
  CASE WHEN r IS NOT NULL THEN CASE WHEN half THEN 'rgba(' || r8 || ', ' || s8 || ', ' || s8 || ', 0.50)' ELSE '#' || lpad(lower(to_hex(r8)), 2, '0') || lpad(lower(to_hex(s8)), 2, '0') || lpad(lower(to_hex(s8)), 2, '0') END END AS strict_colour,
  coalesce(vt, '0') || u AS dimension, CASE WHEN v IS NULL THEN '' ELSE vt || u END AS strict_dimension FROM y"""),
    "alias_chain": (alias_chain, """WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), c AS (SELECT conv_id * 1000 + turn AS node, conv_id, turn AS cur, 0::BIGINT AS steps FROM t
  UNION ALL SELECT node, c.conv_id, cur + 1, steps + 1 FROM c JOIN t ON t.conv_id = c.conv_id AND t.turn = cur + 1)
SELECT node, conv_id * 1000 + max(cur) AS "end", max(steps) AS steps FROM c GROUP BY node, conv_id"""),
    "section_flatten": (section_flatten, r"""SELECT conv_id, turn, len(string_split(text, chr(10)))::BIGINT AS sections, string_split(text, chr(10))[1] AS first_section, (len(string_split(text, chr(10))) - 1)::BIGINT AS last_pos FROM conversations"""),
    "status_table_pivot": (status_table_pivot, "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS status_f, count(*) FILTER (o_orderstatus = 'O') AS status_o, count(*) FILTER (o_orderstatus = 'P') AS status_p FROM orders GROUP BY 1"),
    "resource_upsert_agg": (resource_upsert_agg, """SELECT l_partkey AS resource_id, CASE WHEN bool_or(l_linestatus = 'F') THEN 'resolved' ELSE 'unresolved' END AS status, arg_min(l_orderkey, l_orderkey * 8 + l_linenumber) FILTER (l_linenumber = 1) AS artifact_id,
  arg_min(l_linestatus, l_orderkey * 8 + l_linenumber) FILTER (l_linenumber = 2) AS name, count(*) AS uses, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS routes, array_to_string(list_sort(list(DISTINCT (l_suppkey % 5)::VARCHAR)), ',') AS pages FROM lineitem GROUP BY 1"""),
    "resource_backfill": (resource_backfill, """SELECT p_partkey AS resource_id, array_to_string(list_sort(list(DISTINCT (l_suppkey % 7)::VARCHAR) FILTER (l_suppkey IS NOT NULL)), ',') AS pages FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 25 GROUP BY 1"""),
    "provenance_union": (provenance_union, "SELECT 'region:' || r_regionkey AS subject, r_name AS fact FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer"),
    "anti_union_merge": (anti_union_merge, "SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey * 2, c_name FROM customer WHERE c_custkey * 2 NOT IN (SELECT s_suppkey FROM supplier)"),
    "token_resolution_summary": (token_resolution_summary, """WITH bad AS (SELECT l_suppkey AS t, l_partkey AS k, CASE WHEN l_linenumber <> 1 AND l_returnflag = 'A' THEN 'missing-context-entry' WHEN l_linenumber = 2 THEN 'upstream-empty' ELSE 'unclassified' END AS reason FROM lineitem WHERE l_returnflag <> 'N')
SELECT r.reason, count(k) AS cells, count(DISTINCT CASE WHEN k IS NOT NULL THEN (t, k) END) AS rows, count(DISTINCT t) AS tables
FROM (VALUES ('missing-alias-target'), ('missing-context-entry'), ('unsupported-value-type'), ('upstream-empty'), ('parser-bug'), ('unclassified')) AS r(reason) LEFT JOIN bad USING (reason) GROUP BY r.reason"""),
    "component_overview": (component_overview, f"""SELECT c_nationkey::BIGINT AS component, count(*) AS resources, {', '.join(f"count(*) FILTER (c_mktsegment = '{k}') AS {k}" for k in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))} FROM customer GROUP BY 1"""),
    "referential_integrity": (referential_integrity, " UNION ALL ".join(f"""SELECT {i}::BIGINT AS place, '{a}.{k}' AS stage, count(*) = 0 AS passed, count(*) AS bad, coalesce(array_to_string(list_sort((list('orphan: ' || item ORDER BY item))[1:10]), ','), '') AS reasons
  FROM (SELECT DISTINCT {k}::VARCHAR AS item FROM {a} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {p} FROM {b}))""" for i, (a, k, b, p) in enumerate([("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id")]))),
    "capture_compare": (capture_compare, """SELECT n_regionkey::BIGINT AS page, n_name AS label FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey
  AND (contains(trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')), lower(substr(r_name, 1, 2))) OR contains(lower(substr(r_name, 1, 2)), trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')))))"""),
    "uncrawled_difference": (uncrawled_difference, """WITH u AS (SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P')))
SELECT CASE WHEN k % 10 = 1 THEN 'alias' WHEN k % 10 = 2 THEN 'known' WHEN k % 3 = 0 THEN 'platform' ELSE 'legacy' END AS kind, count(*) AS n FROM u GROUP BY 1"""),
    "manifest_consistency": (manifest_consistency, " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"))),
    "promotion_gate": (promotion_gate, """WITH l AS (SELECT l_orderkey AS grp, count(*) AS p, count(*) FILTER (l_returnflag = 'R') AS f, count(DISTINCT l_partkey) AS d FROM lineitem GROUP BY 1),
x AS (SELECT grp, CASE WHEN p < 3 THEN 'enough-pages' WHEN p >= 4 AND f * 1.0 / p > 0.3 THEN 'source-failures' WHEN p <> d THEN 'no-duplicate-content' WHEN o_orderstatus = 'P' THEN 'routes-covered' END AS failed_check FROM l JOIN orders ON o_orderkey = grp)
SELECT grp, failed_check IS NULL AS passed, failed_check FROM x"""),
    "eta_progress": (eta_progress, """WITH x AS (SELECT user_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS ms FROM events GROUP BY 1), y AS (SELECT *, floor(ms / 1000.0 + 0.5)::BIGINT AS s FROM x)
SELECT user_id, n, ms, CASE WHEN n >= 3 AND ms >= 10000 THEN floor(greatest(0, 50 - n) * ms * 1.0::DOUBLE / n + 0.5)::BIGINT END AS remaining_ms,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN (s % 60) || 's' ELSE '' END ELSE (s // 3600) || 'h' || CASE WHEN (s // 60) % 60 > 0 THEN ((s // 60) % 60) || 'm' ELSE '' END END AS elapsed FROM y"""),
    "progress_throttle": (progress_throttle, """SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS n, arg_max(event_type, event_id) AS event_type, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1"""),
    "stable_runs": (stable_runs, """WITH r AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, min(event_id) AS stable_at, count(*) AS repeats FROM r WHERE event_type = b GROUP BY 1"""),
    "blog_reuse_incremental": (blog_reuse_incremental, "SELECT year(o_orderdate) AS year, year(o_orderdate) < (SELECT max(year(o_orderdate)) FROM orders) - 1 AS reused, count(*) AS n FROM orders GROUP BY 1, 2"),
    "debug_file_names": (debug_file_names, """SELECT event_id, event_type || '-' || lpad((row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id))::VARCHAR, 3, '0') || '.json' AS file, substr(sha1(event_type || '|' || user_id || '|' || props), 1, 12) AS stable_id FROM events"""),
    "response_argmax": (response_argmax, """WITH s AS (SELECT l_orderkey, l_linenumber::BIGINT AS seq, (CASE WHEN l_returnflag = 'A' THEN 8 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 10 ELSE 0 END + CASE WHEN l_quantity > 25 THEN 2 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, seq) AS rn FROM s) SELECT l_orderkey, seq, score FROM r WHERE rn = 1"""),
    "list_routes_page": (list_routes_page, """SELECT o_orderkey AS key, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AS has_page, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total_matched FROM orders WHERE o_orderstatus = 'O' ORDER BY key LIMIT 100"""),
}

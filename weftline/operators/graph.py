"""The documentation graph: routes, pages, sections, resources and what joins them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import resource_basename
from ..sources.tables import Written


def first_rows(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The first row of each key."""
    return _pick(rows, key, F.min_by, seq)


def last_rows(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key."""
    return _pick(rows, key, F.max_by, seq)


def _pick(rows: DataFrame, key: list[str], by, seq: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(by(F.struct(*rest), seq).alias("__row"))
    return picked.select(*key, "__row.*")


def with_coverage(plan: DataFrame, coverage: DataFrame, route: str, seq: str) -> DataFrame:
    """Route plan with its coverage: the first plan row and the last coverage row of each route."""
    return first_rows(plan, [route], seq).join(last_rows(coverage, [route], seq).drop(seq), route, "left")


def with_artifacts(routes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(route, artifacts): ids of artifacts (id, source_route) under any key of routes (route, keys), in key order, each once."""
    keys = routes.select("route", F.posexplode("keys").alias("ord", "key"))
    hits = keys.join(artifacts.select("id", F.col("source_route").alias("key")), "key").groupBy("route", "id").agg(F.min("ord").alias("ord"))
    lists = hits.groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("artifacts"))
    return routes.select("route").join(lists, "route", "left").withColumn("artifacts", F.coalesce("artifacts", F.array().cast("array<string>")))


def share_by_canonical(rows: DataFrame) -> DataFrame:
    """Rows (route, canonical, artifacts) whose artifacts are united over routes of one canonical route."""
    one = rows.where("canonical is not null").select("canonical", F.explode("artifacts").alias("a")).distinct()
    united = one.groupBy("canonical").agg(F.array_sort(F.collect_list("a")).alias("united"))
    return rows.join(united, "canonical", "left").withColumn("artifacts", F.coalesce("united", "artifacts")).drop("united")


def back_fill(resources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Resources with the sorted distinct pages whose chunks name them."""
    used = chunks.where("resource_id is not null").select("resource_id", "page_id").distinct()
    pages = used.groupBy("resource_id").agg(F.array_sort(F.collect_list("page_id")).alias("page_ids"))
    return resources.join(pages, "resource_id", "left")


def by_basename(resources: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Resources (resource_id, name) with the first artifact (id, local_path, seq) whose file has the resource's base name."""
    files = artifacts.select("id", "seq", F.regexp_replace(F.element_at(F.split("local_path", "/"), -1), r"\.json$", "").alias("base"))
    first = files.groupBy("base").agg(F.min_by("id", "seq").alias("artifact_id"))
    return resources.withColumn("base", resource_basename(F.col("name"))).join(first, "base", "left").drop("base")


def by_fallback_keys(rows: DataFrame, keys: list[str], entries: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows (id and key columns) with the entry of the first key that has one: a ranked union of equi-joins."""
    named = rows.select("id", F.posexplode(F.array(*(F.col(k).cast("string") for k in keys))).alias("rank", "__key")).where("__key is not null")
    first = first_rows(entries.withColumn("__key", F.col(key).cast("string")).drop(key), ["__key"], seq)
    rest = [c for c in first.columns if c not in ("__key", seq)]
    hits = named.join(first, "__key").groupBy("id").agg(F.min_by(F.struct(F.col("rank").alias("rank"), *rest), "rank").alias("hit"))
    return rows.join(hits.select("id", "hit.*"), "id", "left")


def prefer(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """All new rows, and the old ones whose key has no new row."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def provenance(parts: list[tuple[str, DataFrame, str, list[Column]]]) -> DataFrame:
    """(subject, facts…) rows of several node tables as one: (kind, rows, id column, fact columns)."""
    out = [rows.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("subject"), *facts) for kind, rows, key, facts in parts]
    return reduce(DataFrame.unionByName, out)


def merge_resources(uses: DataFrame) -> DataFrame:
    """One row a resource from its uses (resource_id, seq, route, page_id, status, artifact_id, name)."""
    sets = uses.select("resource_id", F.explode(F.array(F.struct(F.lit("route").alias("k"), F.col("route").alias("v")), F.struct(F.lit("page").alias("k"), F.col("page_id").cast("string").alias("v")))).alias("x")).select("resource_id", "x.k", "x.v").where("v is not null").distinct()
    lists = sets.groupBy("resource_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("v")))).alias(f"{k}s") for k in ("route", "page")))
    one = uses.groupBy("resource_id").agg(
        F.when(F.bool_or(F.col("status") == "resolved"), "resolved").otherwise("unresolved").alias("status"),
        F.min_by("artifact_id", F.when(F.col("artifact_id").isNotNull(), F.col("seq"))).alias("artifact_id"),
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"),
        F.count("*").alias("uses"),
    )
    return one.join(lists, "resource_id")


def flatten(rows: DataFrame, column: str, alias: str = "item") -> DataFrame:
    """One row an element of an array column, with its position."""
    return rows.select(*(c for c in rows.columns if c != column), F.posexplode(column).alias("pos", alias))


def follow_chain(links: DataFrame, start: str, following: str) -> DataFrame:
    """(node, end, steps): where following first children leads from every node, by pointer doubling.

    A chain of n links takes log2(n) joins, each written to the shared folder. What leads
    into a ring has no end: its end and steps are null.
    """
    written = Written(links.sparkSession, "chain")
    nodes = links.select(F.col(start).alias("node"), F.col(following).alias("end"), F.when(F.col(following).isNull(), 0).otherwise(1).cast("long").alias("steps"))
    nodes, n = written.counted(nodes.withColumn("end", F.coalesce("end", "node")), "0")
    done = 0
    while True:
        far = nodes.where("steps > 0").select(F.col("node").alias("__n"), F.col("end").alias("__e"), F.col("steps").alias("__s"))
        further = nodes.join(far, F.col("end") == F.col("__n"), "left").select("node", F.coalesce("__e", "end").alias("end"), (F.col("steps") + F.coalesce("__s", F.lit(0))).alias("steps"), F.col("__s").isNotNull().alias("moved"))
        nodes = written.keep(further, str(done + 1))
        written.drop(str(done))
        done += 1
        if nodes.where(F.col("moved") & (F.col("steps") < n)).isEmpty():
            return nodes.select("node", *(F.when(~F.col("moved"), F.col(c)).alias(c) for c in ("end", "steps")))


def component_overview(resources: DataFrame, component: str, kinds: list[str]) -> DataFrame:
    """Counts of a component's resources by kind, zeros included."""
    return resources.groupBy(component).agg(F.count("*").alias("resources"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def recommended(routes: DataFrame, component: str, rank: Column, most: int = 5) -> DataFrame:
    """The first routes of each component by rank: the feature's own limit of five."""
    order = Window.partitionBy(component).orderBy("rank", "route")
    return routes.withColumn("rank", rank).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)

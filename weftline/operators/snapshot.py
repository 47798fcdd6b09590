"""Snapshots: artifact records, upserts, staged publishing, manifests and the promotion gate."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def artifact_id(kind: Column, local_path: Column) -> Column:
    return F.concat(kind, F.lit(":"), local_path)


def artifact_records(files: DataFrame, kind: str) -> DataFrame:
    """Records of files (path, content, length) as Spark's binaryFile source reads them."""
    return files.select(artifact_id(F.lit(kind), F.col("path")).alias("id"), F.lit(kind).alias("kind"), F.col("path").alias("local_path"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def upsert_in_place(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key, at the place of its first (batch upsert)."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    one = rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("__row"), F.min(seq).alias("position"))
    return one.select(key, "__row.*", "position")


def upsert_append(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key, at its own place (single upsert: an update moves to the end)."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    one = rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("__row"), F.max(seq).alias("position"))
    return one.select(key, "__row.*", "position")


def debug_names(rows: DataFrame, keys: list[str], kind: str, name: str, seq: str) -> DataFrame:
    """File names with a counter within (keys, kind), and ids that don't depend on it."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(seq))
    stable = F.substring(F.sha1(F.concat_ws("|", F.col(kind), *(F.col(k).cast("string") for k in keys), F.col(name).cast("string"))), 1, 12)
    return rows.withColumn("n", n.cast("long")).withColumn("file", F.concat(F.col(kind), F.lit("-"), F.lpad(F.col("n").cast("string"), 3, "0"), F.lit(".json"))).withColumn("stable_id", stable)


def manifest_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def log_event(event: Column, most_text: int = 500, most_items: int = 30) -> Column:
    """A struct (message, items) as it is logged: text cut at 500 characters, arrays at 30 items."""
    return F.struct(F.substring(event["message"], 1, most_text).alias("message"), F.slice(event["items"], 1, most_items).alias("items"))


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Writes tables below root/version, then moves the pointer: readers see all of a version or none.

    An exception leaves the pointer, and so the published version, as it was.
    """
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    put_text(spark, f"{root}/CURRENT", version)
    return f"{root}/{version}"


def get_text(spark: SparkSession, file: str) -> str | None:
    """What a small file holds; None if there is none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the published version; None before the first."""
    version = get_text(spark, f"{root}/CURRENT")
    return None if version is None else f"{root}/{version}"


def put_text(spark: SparkSession, file: str, text: str) -> None:
    """Puts a small file in place of the one there: a reader sees the old one or the new one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path, staged = jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.hadoop.fs.Path(f"{file}.{uuid.uuid4().hex}")
    fs = path.getFileSystem(conf)
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    renames = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(renames, 1)
    options[0] = renames.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(path), options)


@dataclass
class Facts:
    """What the promotion gate looks at; totals of a run and of the snapshot before it."""

    min_pages: int = 10
    page_count: int = 0
    listed_pages: int = 0
    warnings: list[str] = field(default_factory=list)
    planned: int | None = None
    saved: int = 0
    failed: int = 0
    full_run: bool = True
    expected: int = 0
    unattempted: int = 0
    bundle_attempts: int = 0
    bundle_saved: int = 0
    blog_attempts: int = 0
    include_blog: bool = False
    token_tables_requested: int = 0
    token_tables_rendered: int = 0
    duplicate_groups: int = 0
    suspicious_pages: int = 0
    unexplained_gap: bool = False
    sources_attempted: int = 0
    sources_failed: int = 0
    legacy_attempted: int = 0
    legacy_failed: int = 0
    discovered: int = 0
    previous_discovered: int | None = None
    previous_pages: int | None = None
    intentional_partial: bool = False
    missing_samples: int = 0
    uncovered_routes: int = 0
    ambiguous_routes: int = 0
    uncovered_candidates: int = 0


#: How many checks the gate has.
CHECKS = 19


def gate(f: Facts, force: bool = False) -> list[tuple[int, str, bool]]:
    """All checks in order, as (place, name, passed); ``force`` passes all but the shape of the index."""
    up = lambda x: -int(-x // 1)
    many = lambda bad, of: of >= 10 and bad / of > 0.2
    full = f.full_run
    checks = [
        ("enough-pages", f.page_count >= f.min_pages),
        ("page-count-matches", f.listed_pages == f.page_count),
        ("no-direct-json-failure", not any(w.startswith("direct-json-failure:") for w in f.warnings)),
        ("planned-accounted", f.planned is None or f.planned == f.saved + f.failed),
        ("few-unattempted", not full or f.unattempted < max(5, up(0.2 * f.expected))),
        ("bundle-saved", not f.bundle_attempts or f.bundle_saved > 0),
        ("no-blog", f.include_blog or not f.blog_attempts),
        ("token-tables-rendered", not f.token_tables_requested or f.token_tables_rendered > 0),
        ("no-duplicate-content", not f.duplicate_groups),
        ("no-suspicious-pages", not f.suspicious_pages),
        ("no-unexplained-gap", not (full and f.unexplained_gap)),
        ("source-failures", not many(f.sources_failed, f.sources_attempted)),
        ("virtual-failures", f.planned is None or not many(f.failed, f.planned)),
        ("legacy-failures", f.planned is not None or not many(f.legacy_failed, f.legacy_attempted)),
        ("discovered-kept", f.previous_discovered is None or f.intentional_partial or f.discovered >= up(0.8 * f.previous_discovered)),
        ("pages-kept", f.previous_pages is None or f.page_count >= up(0.8 * f.previous_pages)),
        ("samples-saved", not f.missing_samples),
        ("routes-covered", not (full and f.uncovered_routes)),
        ("no-ambiguity", not (full and (f.ambiguous_routes or f.uncovered_candidates))),
    ]
    return [(n, name, passed or (force and n > 1)) for n, (name, passed) in enumerate(checks)]


def may_replace(previous_verified_full: bool, has_previous: bool, limited: bool, allow_partial: bool) -> bool:
    """A limited run replaces no verified full snapshot and is no first one, unless allowed."""
    return not limited or allow_partial or (has_previous and not previous_verified_full)


def decided(checks: DataFrame) -> DataFrame:
    """Of rows (grp, place, name, passed) each group's verdict: the first failed check, null if none."""
    return checks.groupBy("grp").agg(F.bool_and("passed").alias("passed"), F.min_by("name", F.when(~F.col("passed"), F.col("place"))).alias("failed_check"))

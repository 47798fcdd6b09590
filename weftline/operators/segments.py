"""A full-text index that grows: segments, tombstones and merging.

Each update looks which documents are new, changed or gone, by id and a fingerprint of their
fields. New and changed ones go to a segment of their own; ids of changed and gone ones are
written as tombstones of the segment that held them. Nothing that stays is written again, until
there are MOST_SEGMENTS segments: then what is alive is merged into one.

A state is one small file that names the segments and tombstone folders that belong together. It is put in
place last, so a reader sees all of an update or none; ``open_index`` reads it anew, so an
index that was updated is never searched by an old state. Counts of documents and lengths are
taken from the list of living documents, and how many documents have a term from the living postings
of the terms that are asked for: scores are those of an index made afresh.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Written
from . import search
from .snapshot import get_text, put_text

MOST_SEGMENTS = 16
#: Groups of ids by which documents are picked before their texts are shuffled; at most so many are broadcast.
GROUPS = 1 << 20
SCHEMAS = {
    "docs": "id long, fingerprint string, lengths map<string,bigint>",
    "postings": "term string, field string, id long, tf long, length long",
    "terms": "term string",
    "pieces": "term string, key string",
    "fresh": "id long, fingerprint string",
}
REACHED = "query_term string, term string, weight_milli long"
STONES = "segment string, id long"


class Segments:
    """The index below ``root``, as its state file says; ``segments`` and ``stones`` are folder names."""

    def __init__(self, spark: SparkSession, root: str, segments: Sequence[str] = (), stones: Sequence[str] = ()):
        self.spark, self.root, self.segments, self.stones = spark, root, tuple(segments), tuple(stones)

    def _all(self, name: str) -> DataFrame:
        """A table of all segments, with the segment of each row."""
        parts = [self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{s}/{name}").withColumn("segment", F.lit(s)) for s in self.segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SCHEMAS[name] + ", segment string")

    def living(self, name: str) -> DataFrame:
        """Rows of ``docs`` or ``postings`` whose document hasn't been replaced or removed."""
        return self._living(self._all(name))

    def _living(self, rows: DataFrame) -> DataFrame:
        if not self.stones:
            return rows
        dead = self.spark.read.schema(STONES).parquet(*[f"{self.root}/{s}" for s in self.stones])
        return rows.join(dead, ["segment", "id"], "left_anti")

    def search(self, query: list[str]) -> DataFrame:
        """(id, score, terms) as of search.ranked(): words are expanded on the terms, and only postings of reached terms are read on.

        The reached terms are written first: where they are few, as Spark then sees, postings are
        filtered as they are read and not shuffled. Tombstones meet what is left.
        """
        reached = search.expanded(self._all("terms").select("term").distinct(), query, self._all("pieces").select("term", "key").distinct())
        to = Written(self.spark, "reached").path("terms")
        reached.write.parquet(to)
        rows = self._living(self._all("postings").join(self.spark.read.schema(REACHED).parquet(to), "term"))
        dfs = rows.select("term", "field", "id").distinct().groupBy("term", "field").agg(F.count("*").alias("df"))
        lengths = self.living("docs").select(F.explode("lengths").alias("field", "length"))
        stats = lengths.groupBy("field").agg(F.count("*").alias("n"), (F.sum("length") / F.count("*")).alias("average"))
        return search.scored(rows.join(dfs, ["term", "field"]).join(F.broadcast(stats), "field"))  # stats: one row a field

    def _write(self, docs: DataFrame, fields: Sequence[str], name: str) -> None:
        """A segment of docs (id, fingerprint and the fields)."""
        to = f"{self.root}/{name}"
        sizes = F.map_from_entries(F.array(*[F.struct(F.lit(f), F.size(F.filter(F.split(search.search_text(F.coalesce(F.col(f), F.lit(""))), " "), lambda w: w != "")).cast("long")) for f in fields]))
        docs.select("id", "fingerprint", sizes.alias("lengths")).write.parquet(f"{to}/docs")
        self._postings(search.clustered(docs, fields), to)

    def _postings(self, postings: DataFrame, to: str) -> None:
        """Postings in the order of search.clustered(), and the tables made of them."""
        postings.write.parquet(f"{to}/postings")
        self.spark.read.schema(SCHEMAS["postings"]).parquet(f"{to}/postings").select("term").distinct().sortWithinPartitions("term").write.parquet(f"{to}/terms")
        search.pieces(self.spark.read.schema(SCHEMAS["terms"]).parquet(f"{to}/terms")).repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{to}/pieces")

    def _picked(self, docs: DataFrame, fresh: DataFrame) -> DataFrame:
        """Rows of docs whose id and fingerprint are among the fresh ones; texts of other groups of ids aren't shuffled."""
        group = lambda: F.pmod(F.xxhash64("id"), F.lit(GROUPS)).alias("__group")
        some = docs.withColumn("__group", group()).join(F.broadcast(fresh.select(group()).distinct()), "__group", "left_semi").drop("__group")  # GROUPS bounds it
        wanted = fresh.select(F.col("id").alias("__id"), F.col("fingerprint").alias("__fingerprint"))
        return some.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & F.col("fingerprint").eqNullSafe(F.col("__fingerprint")), "left_semi")

    def _publish(self, segments: Sequence[str], stones: Sequence[str]) -> Segments:
        put_text(self.spark, f"{self.root}/STATE", json.dumps({"segments": list(segments), "stones": list(stones)}))
        return Segments(self.spark, self.root, segments, stones)

    def update(self, docs: DataFrame, fields: Sequence[str]) -> Segments:
        """The index of docs (id, unique, and text fields), all that there are now; documents that didn't change aren't written."""
        now = docs.select("id", *fields, F.sha2(F.to_json(F.struct(*[F.col(f) for f in fields])), 256).alias("fingerprint"))
        new = f"segment-{uuid.uuid4().hex}"
        stones = list(self.stones)
        if self.segments:
            live, known = self.living("docs").select("id", "fingerprint", "segment"), now.select("id", "fingerprint")
            known.join(live, ["id", "fingerprint"], "left_anti").distinct().write.parquet(f"{self.root}/{new}/fresh")
            self._write(self._picked(now, self.spark.read.schema(SCHEMAS["fresh"]).parquet(f"{self.root}/{new}/fresh")), fields, new)
            stones.append(f"stones-{uuid.uuid4().hex}")
            live.join(known, ["id", "fingerprint"], "left_anti").select("segment", "id").write.parquet(f"{self.root}/{stones[-1]}")
        else:
            self._write(now, fields, new)  # all is new
        out = self._publish([*self.segments, new], stones)
        return out.merged() if len(out.segments) >= MOST_SEGMENTS else out

    def merged(self) -> Segments:
        """The same index in one segment without tombstones; its folders are new, so readers of the old state aren't disturbed."""
        new = f"segment-{uuid.uuid4().hex}"
        self.living("docs").drop("segment").write.parquet(f"{self.root}/{new}/docs")
        postings = self.living("postings").drop("segment").repartitionByRange("term", "field", "id").sortWithinPartitions("term", "field", "id")
        self._postings(postings, f"{self.root}/{new}")
        return self._publish([new], [])


def open_index(spark: SparkSession, root: str) -> Segments:
    """The index as it was published last; an empty one before that."""
    text = get_text(spark, f"{root}/STATE")
    state = json.loads(text) if text else {"segments": [], "stones": []}
    return Segments(spark, root, state["segments"], state["stones"])

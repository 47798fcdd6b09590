"""An event log that a stream writes exactly once, in the order of events.

A micro-batch becomes one folder named after its number, put there by an overwriting write: a
batch that is handed over again, because the run ended after the write and before its commit,
replaces itself. Within a folder events are sorted by their sequence number, so reading by
batch and sequence gives the order in which they were logged, whatever tasks wrote them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, DataType, StringType

#: Letters of a text and items of a list that are logged, and what marks a text that was cut.
TEXT, ITEMS, CUT = 500, 30, "…"


def _short(text: Column) -> Column:
    return F.when(F.length(text) > TEXT, F.concat(F.substring(text, 1, TEXT), F.lit(CUT))).otherwise(text)


def _logged(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return _short(value)
    if isinstance(kind, ArrayType):
        items = F.slice(value, 1, ITEMS)
        return F.transform(items, _short) if isinstance(kind.elementType, StringType) else items
    return value


def entries(events: DataFrame, run: str, command: str, seq: str = "seq", verbose: bool = False) -> DataFrame:
    """(seq, line) of events (seq, timestamp, level, event and more): a JSON object each, long texts and lists cut, nulls left out.

    Debug events are logged only if ``verbose``.
    """
    rest = [c for c in events.columns if c not in (seq, "timestamp", "level", "event")]
    kinds = {f.name: f.dataType for f in events.schema.fields}
    own = [F.col("timestamp"), F.col("level"), F.lit(run).alias("runId"), F.lit(command).alias("command"), F.col("event"), *(_logged(F.col(c), kinds[c]).alias(c) for c in rest)]
    rows = events if verbose else events.where(~F.col("level").eqNullSafe("debug"))
    return rows.select(F.col(seq).alias("seq"), F.to_json(F.struct(*own)).alias("line"))


class EventLog:
    """The log below ``root``: a folder of Parquet files (seq, line) for each micro-batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def put(self, rows: DataFrame, batch: int) -> None:
        """Writes a batch of entries(); the same batch again takes its own place."""
        rows.select("seq", "line").repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(f"{self.root}/batch={batch:010d}")

    def follow(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        """Logs a stream of entries() until its input is used up; a later call goes on where this one ended."""
        return rows.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        """(batch, seq, line), to be ordered by batch and seq; batches that are being written aren't seen."""
        return self.spark.read.schema("seq long, line string, batch long").option("basePath", self.root).parquet(self.root)

import json

import pytest

from weftline.streaming import log, progress

EVENT = "seq long, timestamp string, level string, event string, message string, items array<string>, n array<long>"


def events(spark, low, high):
    return spark.createDataFrame([(i, f"t{i}", "debug" if i % 10 == 3 else "info", "saved", "x" * (i * 100), [f"{'y' * 600}"] * 40, [1] * 40) for i in range(low, high)], EVENT)


def test_entries_are_cut_and_filtered(spark):
    rows = {r.seq: json.loads(r.line) for r in log.entries(events(spark, 0, 8), "r1", "update").collect()}
    assert set(rows) == {0, 1, 2, 4, 5, 6, 7}
    assert rows[5]["message"] == "x" * 500 and rows[6]["message"] == "x" * 500 + "…" and rows[6]["runId"] == "r1"
    assert len(rows[1]["items"]) == 30 and rows[1]["items"][0] == "y" * 500 + "…" and rows[1]["n"] == [1] * 30
    assert log.entries(events(spark, 0, 8), "r", "c", verbose=True).count() == 8


def test_a_replayed_batch_is_logged_once(spark, tmp_path):
    source, out, marks = tmp_path / "in", log.EventLog(spark, str(tmp_path / "log")), str(tmp_path / "check")
    schema = events(spark, 0, 1).schema
    stream = lambda: log.entries(progress.event_stream(spark, str(source), schema, "parquet"), "r", "update", verbose=True)
    events(spark, 0, 40).repartition(5).write.mode("append").parquet(str(source))
    put, calls = out.put, []

    def broken(rows, batch):
        put(rows, batch)
        calls.append(batch)
        raise RuntimeError("the run ends after the write")

    out.put = broken
    with pytest.raises(Exception, match="the run ends"):
        out.follow(stream(), marks).awaitTermination(120)
    out.put = put
    out.follow(stream(), marks).awaitTermination(120)
    assert calls == [0]
    events(spark, 40, 60).write.mode("append").parquet(str(source))
    out.follow(stream(), marks).awaitTermination(120)
    got = [(r.batch, r.seq) for r in out.read().orderBy("batch", "seq").collect()]
    assert got == [(0, i) for i in range(40)] + [(1, i) for i in range(40, 60)]

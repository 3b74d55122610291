from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lectern.streaming import items

S = 1_000_000
#: Microseconds of moment 0; a stream takes nothing from before its first watermark, the year 1970.
START = 1_700_000_000 * S
SCHEMA = "item long, at long, seq long, kind string, flag boolean, state string"


def facts_of(spark, rows):
    return spark.createDataFrame([(i, START + int(t * S), n, k, f, "own") for n, (i, t, k, f) in enumerate(rows)], SCHEMA)


def told(frame):
    return sorted((r.item, (r.at - START) / S, r.what, r.state, r.attempt) for r in frame.collect())


LIFE = [
    (1, 0, "found", None), (1, 1, "row", False), (1, 2, "row", True), (1, 3, "analysed", True), (1, 4, "cut", None), (1, 5, "music", None), (1, 6, "cut", None),
    (2, 0, "row", None), (2, 1, "row", True), (2, 2, "failed", True), (2, 10, "failed", True), (2, 14, "failed", True), (2, 30, "failed", True), (2, 60, "failed", True), (2, 99, "found", None),
    (3, 0, "row", True), (3, 5, "failed", False), (3, 6, "analysed", None), (3, 7, "row", False), (4, 0, "failed", True), (4, 2, "failed", True),
]
LIFE_LOG = [
    (1, 0, "state", "waits", 0), (1, 1, "state", "out", 0), (1, 2, "state", "queued", 0), (1, 3, "state", "done", 0), (1, 4, "state", "cut", 0), (1, 5, "state", "recut", 0), (1, 6, "state", "cut", 0),
    (2, 0, "state", "waits", 0), (2, 1, "state", "queued", 0), (2, 4, "retry", "queued", 1), (2, 22, "retry", "queued", 3), (2, 46, "retry", "queued", 4), (2, 60, "state", "error", 5), (2, 99, "state", "queued", 0),
    (3, 0, "state", "queued", 0), (3, 5, "state", "error", 1), (3, 6, "state", "unfit", 0), (4, 0, "state", "waits", 1), (4, 6, "retry", "waits", 2),
]


def test_life_of_items(spark):
    """Item 2's second failure is followed after exactly its pause of 4 s, item 4's first one after 2 s: no repetition."""
    facts = facts_of(spark, LIFE)
    assert told(items.item_log(facts)) == sorted(LIFE_LOG)


def test_odd_facts(spark):
    odd = [(None, 0, "found", None), (5, 0, "waved", None), (5, 1, None, True)]
    facts = facts_of(spark, odd).unionByName(spark.createDataFrame([(6, None, 0, "found", None, ""), (7, START, None, "found", None, "")], SCHEMA))
    assert told(items.item_log(facts)) == [(7, 0, "state", "waits", 0)]
    assert told(items.item_log(facts.limit(0))) == []
    twice = facts_of(spark, [(1, 0, "failed", True)])
    assert told(items.item_log(twice.union(twice))) == [(1, 0, "state", "waits", 1), (1, 2, "retry", "waits", 1)]


def test_stream_equals_table(spark, tmp_path):
    """Parts out of order within the lateness, a repeated part, each part a run of its own: the log is the table's."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    facts = facts_of(spark, LIFE)
    order = F.col("at") - START + F.when(F.col("item") == 2, 5 * S).otherwise(0)
    parts = [facts.filter(order < 4 * S), facts.filter(order < 4 * S).unionByName(facts.filter((order >= 4 * S) & (order < 30 * S))), facts.filter(order >= 30 * S), facts_of(spark, [(99, 999, "found", None)])]
    folder, out = str(tmp_path / "facts"), str(tmp_path / "out")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = items.streamed_log(spark.readStream.schema(SCHEMA).parquet(folder))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert told(spark.read.parquet(out)) == told(items.item_log(facts))


def test_coalesced_changes(spark):
    at = [0, 2, 4.5, 9, 12.5]
    changes = spark.createDataFrame([(1, datetime.fromtimestamp(t, UTC)) for t in at], "item long, ts timestamp")
    found = items.coalesced(changes, ["item"]).select(F.unix_micros("first_ts"), F.unix_micros("save_ts"), "n_changes")
    assert sorted(map(tuple, found.collect())) == [(0, int(7.5 * S), 3), (9 * S, 12 * S, 1), (int(12.5 * S), int(15.5 * S), 1)]


def test_repeating_action():
    waited, calls = [], []

    def action(fails, error):
        def act(batch, number):
            calls.append((batch, number))
            if len(calls) <= fails:
                raise error("no answer")

        return items.repeating(act, wait=waited.append)

    action(3, items.Transient)("batch", 7)
    assert waited == [2, 4, 8] and calls == [("batch", 7)] * 4
    waited.clear(), calls.clear()
    with pytest.raises(items.Transient):
        action(9, items.Transient)("batch", 7)
    assert waited == [2, 4, 8, 16] and len(calls) == 5
    waited.clear(), calls.clear()
    with pytest.raises(ValueError):
        action(9, ValueError)("batch", 7)
    assert waited == [] and len(calls) == 1

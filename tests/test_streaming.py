from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.streaming import watch

SCHEMA = "path string, size long, mtime timestamp, look long, complete boolean"


def test_ready_files(spark, tmp_path):
    t = datetime(2024, 1, 1)
    looks = [
        [("/w/a.m4a", 10, t, 0, False), ("/w/b.txt", 5, t, 0, True), ("/w/c.m4a", 7, t, 0, True)],
        [("/w/a.m4a", 20, t + timedelta(seconds=4), 1, True), ("/w/c.m4a", 7, t, 1, True)],
        [("/w/a.m4a", 20, t + timedelta(seconds=4), 2, True), ("/w/c.m4a", 7, t, 2, True)],
        [("/w/a.m4a", 20, t + timedelta(seconds=4), 3, True)],
    ]
    folder, done = str(tmp_path / "looks"), str(tmp_path / "checkpoint")

    def run(batch):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = watch.ready_files(watch.folder_looks(spark, folder, SCHEMA))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", done).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r.path for r in spark.read.schema("path string").parquet(str(tmp_path / "out")).collect())

    # every look is a run of its own: the state outlives restarts
    assert [run(batch) for batch in looks] == [[], ["/w/c.m4a"], ["/w/a.m4a", "/w/c.m4a"], ["/w/a.m4a", "/w/c.m4a"]]


def test_sessions_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    parts = str(tmp_path / "events")
    # ordered parts, then a late sentinel that closes the last sessions
    last = events.agg(F.max("ts").alias("m")).first().m
    events.orderBy("ts").coalesce(1).write.parquet(parts)
    spark.createDataFrame([(-1, last + timedelta(days=9))], "user_id long, ts timestamp").write.mode("append").parquet(parts)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    query = watch.sessions(stream, "6 hours", "1 day").writeStream.format("memory").queryName("found").outputMode("append").start()
    try:
        query.processAllAvailable()
        found = sorted((r.user_id, r.session_start, r.n_events) for r in spark.table("found").filter("user_id >= 0").collect())
    finally:
        query.stop()
    batch = sorted((r.user_id, r.session_start, r.n_events) for r in watch.sessions(events, "6 hours", "1 day").collect())
    assert found == batch

"""Streaming: files that have settled, exactly-once hand-over, sessions and item states (Y-01 to Y-09)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.catalog import path_key
from ..sources.media import is_media

READY = "path string, size long, mtime timestamp"
STATE = "size long, mtime double, handed boolean"


def ready_files(looks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Y-01, Y-03: from a stream of looks (path, size, mtime, look, complete) each file once, when it has settled.

    A file is ready when two looks in a row found the same size and time, the size is above 0 and it opens
    (``complete``). The state, one row per path, lives in the checkpoint, so a restart hands nothing over twice.
    """
    watched = looks.filter(is_media(F.col("path"))).withColumn("key", path_key(F.col("path")))
    if known is not None:
        watched = watched.join(known.select(path_key(F.col("path")).alias("key")).distinct(), "key", "left_anti")

    def settle(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("look")
        size, mtime, handed = state.get if state.exists else (-1, -1.0, False)
        out = []
        for row in rows.itertuples():
            stamp = row.mtime.timestamp()
            same = row.size == size and stamp == mtime
            size, mtime = row.size, stamp
            if same and not handed and row.size > 0 and row.complete:
                handed = True
                out.append((row.path, row.size, row.mtime))
        state.update((size, mtime, handed))
        yield pd.DataFrame(out, columns=["path", "size", "mtime"])

    return watched.groupBy("key").applyInPandasWithState(settle, READY, STATE, "append", GroupStateTimeout.NoTimeout)


def folder_looks(spark: SparkSession, folder: str, schema: str = "path string, size long, mtime timestamp, look long, complete boolean") -> DataFrame:
    """Looks that a lister appends to a folder as Parquet, a few files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def first_seen(stream: DataFrame, key: str = "path") -> DataFrame:
    """Y-03: every key once over the life of the query."""
    return stream.dropDuplicates([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Y-09: sessions per user with a watermark; works on a stream and on a table alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def route(stream: DataFrame, actions: dict[str, Callable[[DataFrame, int], None]], action: str, checkpoint: str, every: str = "4 seconds"):
    """Y-02, Y-04, Y-06, Y-08: hands each micro-batch to the action of the given name.

    A batch can come again after a failure with the same number; actions key their writes by it.
    """
    return stream.writeStream.foreachBatch(actions[action]).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def upsert_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Y-08, S-10: a sink that merges a batch into a table; merging the same batch again changes nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        write(merge(read(), batch), number)

    return sink


def with_rows(stream: DataFrame, matched: DataFrame) -> DataFrame:
    """Y-07: a stream of files with the latest known rows, which every micro-batch looks up anew."""
    return stream.join(matched.select("path", "row"), "path", "left")


def item_state(row_known: str = "row", inside: str = "inside"):
    """Y-05: what a waiting file does: waits for its row, is out of the chosen rows, or is queued."""
    return F.when(F.col(inside), "queued").when(F.col(row_known).isNull(), "waits for its row").otherwise("out of the chosen rows")

"""Sharding by longest-processing-time scheduling of groups that stay together.

Texts that are equal form a group. LPT takes groups from the largest down and gives each to the least
loaded shard, which a heap finds. A corpus has too many groups for one heap, so the sizes are first
brought down to a number that does not depend on the corpus:

* a *heavy* group holds at least 1/``HEAVY_PARTS`` of all bytes, so there are at most that many, and
  each is an item of its own;
* every other group falls by its hash into one of ``LEVELS * SLOTS`` bundles. Level ``l`` takes a
  share ``2**-(l+1)`` of the groups, so bundles run from large ones down to about 2e-7 of the
  bytes, and the last ones that LPT places level the shards out.

The heap runs on the driver over at most ``HEAVY_PARTS + LEVELS * SLOTS`` items. Row numbers inside a
shard come from counts of *cells*: a bundle, or a piece of a bundle that holds more than 1/256 of the
rows. Rows are dealt to pieces by a number that each got when it was written, so that equal rows part as well.
No task gets a whole shard or a whole heavy group.

Defined results: a null text counts as an empty one (size 1, checksum 0) and shares the group of empty
texts; repeated rows each get a slot; a null doc_id is a row like any other; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored

HEAVY_PARTS = 512
LEVELS, SLOTS = 13, 512
CELL_PARTS = 256


def longest_first(items: Iterable[tuple[str, int]], n_shards: int) -> dict[str, int]:
    """LPT: the largest item first, each to the least loaded shard; equal loads go to the lowest number."""
    heap = [(0, shard) for shard in range(n_shards)]
    placed = {}
    for key, size in sorted(items, key=lambda item: (-item[1], item[0])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _bundle(group: Column) -> Column:
    """The bundle of a group that is not heavy: a level with geometric odds, then a slot."""
    h = F.xxhash64(group)
    draw = (h.bitwiseAND(F.lit(2**30 - 1)) + 1) / F.lit(float(2**30))
    level = F.least(F.floor(-F.log2(draw)), F.lit(LEVELS - 1))
    slot = F.shiftrightunsigned(h, 40) % SLOTS
    return F.concat(F.lit("s"), level.cast("string"), F.lit("."), slot.cast("string"))


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; sizes of shards are near equal."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("group"),
            F.monotonically_increasing_id().alias("number"),
        )
    )
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total_bytes, total_rows = total["bytes"] or 0, total["rows"]
    heavy = (
        rows.groupBy("group")
        .agg(F.sum("size").alias("bytes"))
        .filter(F.col("bytes") >= max(1, math.ceil(total_bytes / HEAVY_PARTS)))
        .select("group")
        .collect()
    )
    heavy_schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("own", T.StringType())])
    own = spark.createDataFrame([(r["group"], f"h{r['group']}") for r in heavy], heavy_schema)
    rows = rows.join(F.broadcast(own), "group", "left").withColumn("bundle", F.coalesce("own", _bundle(F.col("group")))).drop("own", "group")

    bundles = rows.groupBy("bundle").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    shard_of = longest_first(((b["bundle"], b["bytes"]) for b in bundles), n_shards)
    cell_rows = max(1, math.ceil(total_rows / CELL_PARTS))
    plan_schema = "bundle string, shard int, pieces int"
    plan = spark.createDataFrame([(b["bundle"], shard_of[b["bundle"]], -(-b["rows"] // cell_rows)) for b in bundles], plan_schema)
    rows = rows.join(F.broadcast(plan), "bundle").withColumn("piece", F.pmod(F.xxhash64("number"), F.col("pieces")).cast("int"))

    cells = rows.groupBy("shard", "bundle", "piece").count().collect()
    first, offsets = dict.fromkeys(range(n_shards), 0), []
    for shard, bundle, piece, count in sorted(map(tuple, cells)):
        offsets.append((bundle, piece, first[shard]))
        first[shard] += count
    starts = spark.createDataFrame(offsets, "bundle string, piece int, first long")
    in_cell = Window.partitionBy("bundle", "piece").orderBy("doc_id", "text_crc32", "size", "number")
    return rows.join(F.broadcast(starts), ["bundle", "piece"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.row_number().over(in_cell) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

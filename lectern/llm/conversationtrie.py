"""The trie of conversations' common beginnings, by prefix doubling.

Turns are numbered per conversation, conversations are rebuilt (their first turns come from the first conversation of
their five), and every distinct prefix of a rebuilt conversation is a node.

Prefixes get their names by doubling, in log2 of the longest conversation rounds of joins:

1. A turn's name is a dense number of its (role, text). The name of a block of 2^(k+1) turns is a dense number of the
   names of its two halves, so after k rounds every aligned block of 2^k turns has a name.
2. A depth is the sum of its binary digits, so a prefix is a row of aligned blocks of falling size, and its name is the
   list of their names, at most log2 of its depth, composed by one shuffle.

Two prefixes of one depth have the same name if and only if their turns are equal. Then nodes are groups of (depth,
name). Sums over subtrees need no walk: a node's value is put on its smallest member, whose prefixes are its ancestors;
suffix sums along each conversation and one aggregation by node then give every subtree's sum, and its leaves likewise.

Nothing holds a whole conversation or node: turns are numbered by ranges written once with counts per range, suffix sums
go in chunks of 2^``CHUNK`` turns, aggregations combine before the shuffle, and the members that end at a node are joined
in blocks of 2^``CHUNK`` ids, whose text is hashed as a stream. Turns are told apart by the SHA-256 of role and text.

Defined results: null role or text is empty; turns of one number are ordered by role and text; rows without a conv_id
belong to no conversation and are left out; repeated turns count each; an empty table has no node, not even a root;
columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, stored

#: The fixed rule of rebuilding: the first crc32(conv_id) % HEADS turns come from conversation c - c % FAMILY.
HEADS, FAMILY = 9, 5
CHUNK = 12
#: Buckets in which distinct keys are numbered.
BUCKETS = 1024


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv, i (from 0), digest, bytes of every turn, numbered by ranges that are written once."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, said = text("role"), text("text")
    # the length of the role in front keeps (role, text) apart
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, said).cast("binary"), 256))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), said.alias("said"), digest.alias("digest"), F.octet_length(said).cast("long").alias("bytes")
    )
    # order by the text itself only among rows of one number
    begin = F.substring("said", 1, 64)
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.repartitionByRange(parts, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), begin)
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("part")))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("conv", "part").agg(F.count("*").alias("n")).select("conv", "part", F.coalesce(before, F.lit(0)).alias("offset")).filter("offset > 0")
    local = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "said"))
    at = ranged.withColumn("local", local).join(offsets, ["conv", "part"], "left")
    return at.select("conv", (F.coalesce("offset", F.lit(0)) + F.col("local") - 1).alias("i"), "digest", "bytes")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, i, digest, bytes) and lengths (conv, length) of the rebuilt conversations."""
    heads = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS))
    base = F.col("conv") - F.col("conv") % FAMILY
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    firsts = sizes.select(F.col("conv").alias("base"), "own")
    convs = sizes.select("conv", F.col("own").alias("mine"), heads.alias("h"), base.alias("base")).join(firsts, "base", "left")
    convs = stored(convs.select("conv", "base", "h", "mine", F.least("h", F.coalesce("own", F.lit(0))).alias("taken")))
    taken = convs.filter("taken > 0").select("conv", "base", "h").join(turns.filter((F.col("i") < HEADS - 1) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "base"), "base").filter("i < h")
    # h is a function of the id, so only the number taken needs a join
    own = turns.filter(F.col("i") >= heads).join(convs.select("conv", "h", "taken"), "conv")
    own = own.select("conv", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "digest", "bytes")
    lengths = convs.select("conv", (F.col("taken") + F.greatest(F.col("mine") - F.col("h"), F.lit(0))).alias("length"))
    return own.unionByName(taken.select("conv", "i", "digest", "bytes")), lengths


def dense_names(frame: DataFrame, *keys: str) -> DataFrame:
    """``frame`` with ``name``: a number for each distinct value of ``keys``, the same at every computation.

    It is the rank in its bucket times BUCKETS plus the bucket, so numbers are dense but for the buckets' unevenness
    and need no pass over all buckets.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys)) - 1
    named = frame.groupBy(*keys).agg(bucket.alias("bucket")).select(*keys, (rank * F.lit(BUCKETS).cast("long") + F.col("bucket")).alias("name"))
    return frame.join(named, list(keys))


def block_names(turns: DataFrame, longest: int) -> list[DataFrame]:
    """For k = 0, 1, 2 … the names (conv, i, name) of the aligned blocks of 2^k turns, i-th of the conversation."""
    blocks = [stored(dense_names(turns.select("conv", "i", "digest"), "digest").select("conv", "i", "name"))]
    while 1 << len(blocks) <= longest:
        side = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        halves = blocks[-1].groupBy("conv", F.shiftright("i", 1).alias("at")).agg(side(0).alias("left"), side(1).alias("right")).filter("right IS NOT NULL")
        blocks.append(stored(dense_names(halves, "left", "right").select("conv", F.col("at").alias("i"), "name")))
    return blocks


def prefix_names(blocks: list[DataFrame]) -> DataFrame:
    """conv, depth (from 1) and name: the names of the blocks that the depth's binary digits stand for, largest first.

    A block of 2^k turns at an even place is in the prefixes that end in it or behind it before the next such block.
    """
    parts: DataFrame | None = None
    for k, block in enumerate(blocks):
        size = F.lit(1 << k).cast("long")
        ends = F.explode(F.sequence((F.col("i") + 1) * size, (F.col("i") + 2) * size - 1))
        part = block.filter(F.col("i") % 2 == 0).select("conv", ends.alias("depth"), F.struct(F.lit(-k).alias("order"), "name").alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    # blocks in a row that the last ones are missing of would end beyond the conversation
    composed = parts.groupBy("conv", "depth").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    whole = F.size("parts") == F.bit_count("depth")
    return composed.filter(whole).select("conv", "depth", F.transform("parts", lambda x: x["name"]).alias("name"))


def _suffix_sums(values: DataFrame) -> DataFrame:
    """conv, depth, ``value`` summed over this and greater depths of the conversation."""
    chunks = values.withColumn("chunk", F.shiftright("depth", CHUNK))
    down = Window.partitionBy("conv", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = F.sum("all").over(Window.partitionBy("conv").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1))
    totals = chunks.groupBy("conv", "chunk").agg(F.sum("value").alias("all"))
    totals = totals.select("conv", "chunk", later.alias("later")).filter("later > 0")
    summed = chunks.withColumn("value", F.sum("value").over(down)).join(totals, ["conv", "chunk"], "left")
    return summed.select("conv", "depth", (F.col("value") + F.coalesce("later", F.lit(0))).alias("value"))


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node from its blocks of ids, which come in order."""
    at, running = None, None
    done: list[tuple[int, int, str]] = []
    for batch in batches:
        for depth, name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (depth, name) != at:
                if at is not None:
                    done.append((*at, running.hexdigest()))
                at, running = (depth, name), hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.as_py().encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["depth", "name", "ends"])
            done = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([running.hexdigest()])], names=["depth", "name", "ends"])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """depth, name, ends: the hash of the ids (conv) that end at each node, ascending."""
    block = F.shiftright("conv", CHUNK)
    joined = ends.groupBy("depth", "name", block.alias("block")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))
    ordered = joined.repartition("depth", "name").sortWithinPartitions("depth", "name", "block")
    return ordered.select("depth", "name", "ids").mapInArrow(_hash_streams, "depth long, name long, ends string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    number: Column = F.col("conv")
    with scratch(conversations.sparkSession):
        turns, lengths = rebuilt_turns(stored(numbered_turns(conversations)))
        turns = stored(turns)
        longest = lengths.agg(F.max("length")).first()[0] or 0
        names = prefix_names(block_names(turns, longest))
        names = stored(dense_names(names.withColumnRenamed("name", "blocks"), "depth", "blocks").select("conv", "depth", "name"))
        roots = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"))
        # each prefix with the bytes of its last turn and the name of its parent, by one shuffle
        no = F.lit(None).cast("long")
        own = names.unionByName(roots)
        beside = (
            own.select("conv", "depth", "name", no.alias("bytes"), no.alias("above"))
            .unionByName(turns.select("conv", (F.col("i") + 1).alias("depth"), no.alias("name"), "bytes", no.alias("above")))
            .unionByName(own.select("conv", (F.col("depth") + 1).alias("depth"), no.alias("name"), no.alias("bytes"), F.col("name").alias("above")))
        )
        prefixes = stored(beside.groupBy("conv", "depth").agg(F.max("name").alias("name"), F.max("bytes").alias("bytes"), F.max("above").alias("above")).filter("name IS NOT NULL"))
        nodes = stored(
            prefixes.groupBy("depth", "name").agg(F.min(number).alias("conv"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("above").alias("above"))
        )
        children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("name")).agg(F.count("*").alias("n_children"))
        above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("above"), F.col("conv").alias("parent"))
        wide = stored(nodes.join(children, ["depth", "name"], "left").join(above, ["depth", "above"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
        saved = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0)
        values = wide.select("conv", "depth", saved.alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
        # a node's values lie on its smallest member; a leaf counts at every depth of that member
        on = prefixes.select("conv", "depth", "name").join(values, ["conv", "depth"], "left")
        sums = _suffix_sums(on.select("conv", "depth", F.coalesce("saved", F.lit(0)).alias("value")))
        leaves = values.filter("leaf = 1").select("conv", "leaf")
        below = (
            prefixes.select("conv", "depth", "name").join(sums, ["conv", "depth"]).join(leaves, "conv", "left")
            .groupBy("depth", "name").agg(F.sum("value").alias("saved_tokens"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))
        )
        ends = _end_hashes(prefixes.join(lengths, "conv").filter("depth = length").select("conv", "depth", "name"))
        whole = wide.join(below, ["depth", "name"]).join(ends, ["depth", "name"], "left")
        return stored(
            whole.select(
                number.alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
            ),
            lasting=True,
        )

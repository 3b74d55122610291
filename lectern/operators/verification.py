"""Checks of cut results against their sources: J-13, A-14, O-08, O-10, S-02 to S-06."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.catalog import audio_extension, is_lossless
from ..session import keep
from .numbering import numbered


def parse_probe(json_text: Column) -> Column:
    """S-02: duration, format, video streams without cover pictures and audio streams of a probe's JSON."""
    stream = "struct<codec_type:string,codec_name:string,sample_rate:string,disposition:struct<attached_pic:int>>"
    d = F.from_json(json_text, f"struct<format:struct<duration:string,format_name:string>,streams:array<{stream}>>")
    streams = F.coalesce(d["streams"], F.array().cast(f"array<{stream}>"))
    pictured = lambda s: F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) != 0
    return F.struct(
        F.coalesce(d["format"]["duration"].try_cast("double"), F.lit(0.0)).alias("duration"),
        F.coalesce(d["format"]["format_name"], F.lit("")).alias("format"),
        F.filter(streams, lambda s: (s["codec_type"] == "video") & ~pictured(s)).alias("video"),
        F.filter(streams, lambda s: s["codec_type"] == "audio").alias("audio"),
    )


def parse_tags(json_text: Column) -> Column:
    """S-07: the text tags of a container, names in lower case; empty for broken JSON."""
    tags = F.from_json(json_text, "struct<format:struct<tags:map<string,string>>>")["format"]["tags"]
    lowered = F.transform_keys(tags, lambda k, v: F.lower(k))
    return F.coalesce(lowered, F.create_map().cast("map<string,string>"))


def keyframes(packets: DataFrame) -> DataFrame:
    """S-03: distinct times of packets (file, pts, flags) flagged as key frames."""
    return packets.filter(F.col("flags").contains("K") & F.col("pts").isNotNull()).select("file", "pts").distinct()


def parse_packet(line: Column) -> Column:
    """S-05: time (NaN if it cannot be read) and checksum of a packet line; null without a checksum."""
    check = F.nullif(F.regexp_extract(line, r"(?:^|,)(CRC32:[^,]*)", 1), F.lit(""))
    pts = F.coalesce(F.split_part(line, F.lit(","), F.lit(1)).try_cast("double"), F.lit(float("nan")))
    return F.when(check.isNotNull(), F.struct(pts.alias("pts"), check.alias("hash")))


def packet_starts(packets: DataFrame) -> DataFrame:
    """S-04: the start times of packets with a readable time."""
    return packets.filter(F.col("pts").isNotNull() & ~F.isnan("pts")).select("file", "pts")


#: Result packets that are walked over in one piece of work, and how many places of a hash are few.
CHUNK, FEW = 1 << 14, 16
MAP = "file string, chunk long, upto long, first long, end long, matched long, jumps long"


def chunk_map(hashes: Sequence[int], places: dict[int, Sequence[int]], low: int = 0, high: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """What the walk over a chunk of result packets does from every place in the source that it can begin at.

    ``places``: ascending places of each hash in the source. Rows (upto, first, end, matched, jumps), ascending: from a
    place up to ``upto``, and beyond that of the row before, the first match is at ``first``, the walk goes on at
    ``end``, and so many packets matched, so many of them not at the next place (the first one not counted). From
    beyond the last row nothing matches. The walk is known to begin at ``low`` to ``high``; without ``high`` anywhere.

    All beginnings walk together. Those that match at the same place are one from then on, so a packet moves few.
    """
    reach = lambda found: None if high is None else bisect_left(found, high) + 1
    spots = sorted(p for found in places.values() for p in found[bisect_left(found, low) : reach(found)])
    spots = spots[bisect_left(spots, low) : None if high is None else bisect_left(spots, high) + 1]
    n = len(spots)
    # where the walks are: twice the place, and one more for those that have not matched yet, up to a spot
    keys, walks = [2 * s + 1 for s in spots], list(range(n))
    parent, matched, jumps, first = list(range(n)), [0] * n, [0] * n, [0] * n
    for h in hashes:
        found = places.get(h)
        rest = bisect_right(keys, 2 * found[-1] + 1) if found else 0
        while rest:
            # the last walk that is left, and all that match where it does
            k = bisect_left(found, keys[rest - 1] >> 1)
            p, b = found[k], rest
            rest = a = bisect_left(keys, 2 * (found[k - 1] + 1), 0, b) if k else 0
            for at in range(a, b):
                walk = walks[at]
                matched[walk] += 1
                if keys[at] & 1:
                    first[walk] = p
                elif keys[at] != 2 * p:
                    jumps[walk] += 1
            if b < len(keys) and keys[b] == 2 * p + 2:
                b += 1  # one that stands there already
            if b - a == 1:
                keys[a] = 2 * p + 2
                continue
            for at in range(a, b):
                parent[walks[at]] = len(parent)
            keys[a:b], walks[a:b] = [2 * p + 2], [len(parent)]
            parent.append(len(parent))
            matched.append(0)
            jumps.append(0)
            first.append(0)
    end = {walk: key // 2 for key, walk in zip(keys, walks, strict=True)}
    for walk in range(len(parent) - 1, -1, -1):
        if parent[walk] != walk:
            up = parent[walk]
            matched[walk] += matched[up]
            jumps[walk] += jumps[up]
            end[walk] = end[up]
    return [(spots[i], first[i], end[i], matched[i], jumps[i]) for i in range(n)]


def _places(hashes: np.ndarray, places: np.ndarray) -> dict[int, array]:
    """The ascending places of each hash, eight bytes each."""
    order = np.lexsort((places, hashes))
    hashes, places = hashes[order], places[order]
    begins = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.array([], dtype=int)
    ends = np.r_[begins[1:], len(hashes)].astype(int)
    return {int(hashes[i]): array("q", places[i:j].tobytes()) for i, j in zip(begins.tolist(), ends.tolist(), strict=False)}


def _chunk_maps(key: tuple, result: pa.Table, source: pa.Table) -> pa.Table:
    s_h, s_place = source["s_h"].to_numpy(), source["s_place"].to_numpy()
    bounds = int(np.flatnonzero(s_place < 0)[0])
    low, high = -1 - int(s_place[bounds]), int(s_h[bounds])
    r_h, r_first = result["r_h"].to_numpy(), result["r_first"].to_numpy()
    single, first_of = np.unique(r_h[r_first >= 0], return_index=True)
    others = s_place >= 0
    places = _places(np.r_[s_h[others], single], np.r_[s_place[others], r_first[r_first >= 0][first_of]])
    hashes = array("q", r_h[np.argsort(result["r_no"].to_numpy(), kind="stable")].tobytes())
    rows = chunk_map(hashes, places, low, high)
    names = [c.split()[0] for c in MAP.split(", ")]
    columns = [pa.array([key[0].as_py()] * len(rows), pa.string()), pa.array([key[1].as_py()] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))]
    return pa.table(dict(zip(names, columns, strict=True)))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The walk of each file through its chunks' maps, which come in order: one row per file."""
    file, chunk, at, matched, jumps = None, -1, 0, 0, 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([matched], pa.int64()), pa.array([jumps], pa.int64())], names=["file", "identical", "jumps"])

    for batch in batches:
        for own, number, upto, first, end, n, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != file:
                if file is not None:
                    yield made()
                file, chunk, at, matched, jumps = own, -1, 0, 0, 0
            if number != chunk and upto >= at:
                jumps += more + (first != at)
                chunk, at, matched = number, end, matched + n
    if file is not None:
        yield made()


def match_packets(source: DataFrame, result: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """J-13, A-14: per file how many result packets are copies of source packets, taken in order.

    Both: file, seq, hash. Each packet goes to its hash's next place in the source; one without such a place is passed
    over. What that walk does in a chunk of ``chunk`` result packets is a map from where it begins, made from the places
    of the chunk's hashes alone. Chunks of one file are mapped in many tasks; following the maps from chunk to chunk
    is one pass over their sorted rows, which holds one place.

    A packet leaves the walk behind the first place of its hash, and matches at the last one or before. So the greatest
    first and last places of the chunks before bound where a chunk's walk begins: hashes with one place leave one
    beginning. Places of hashes that have many come to every chunk with the hash; where a file has more of those than
    ``chunk``, its chunks have as many packets, so no more places than packets are sent. Such a file's places are
    held in one task.
    """
    light = lambda df: df.select("file", "seq", "hash").filter(F.col("file").isNotNull())
    h = F.xxhash64("hash")
    # own names on either side: both may stem from one table
    src = numbered(light(source), ["seq", "hash"], ["file"]).select(F.col("file").alias("s_file"), h.alias("s_h"), (F.col("no") - 1).alias("s_place"))
    known = keep(src.groupBy("s_file", "s_h").agg(F.count("*").alias("n"), F.min("s_place").alias("first"), F.max("s_place").alias("last")))
    longer = keep(known.filter(F.col("n") > FEW).groupBy("s_file").agg(F.sum("n").alias("length")).filter(F.col("length") > chunk).select(F.col("s_file").alias("l_file"), "length"))
    longer = F.broadcast(longer) if longer.count() <= FEW * CHUNK else longer
    told = known.select(F.col("s_file").alias("r_file"), F.col("s_h").alias("r_h"), F.col("n").alias("r_n"), F.col("first").alias("r_first"), F.col("last").alias("r_last"))
    dst = numbered(light(result), ["seq", "hash"], ["file"]).select(F.col("file").alias("r_file"), h.alias("r_h"), F.col("no").alias("r_no"))
    dst = dst.join(told, ["r_file", "r_h"]).join(longer, F.col("r_file") == F.col("l_file"), "left")
    length = F.coalesce("length", F.lit(chunk))
    dst = keep(dst.select("r_file", F.floor((F.col("r_no") - 1) / length).alias("r_chunk"), "r_h", "r_no", "r_n", "r_first", "r_last"))
    before = Window.partitionBy("s_file").orderBy("s_chunk").rowsBetween(Window.unboundedPreceding, -1)
    reached = lambda c: F.coalesce(F.max(c).over(before) + 1, F.lit(0))
    chunks = dst.groupBy(F.col("r_file").alias("s_file"), F.col("r_chunk").alias("s_chunk")).agg(F.max("r_first").alias("first"), F.max("r_last").alias("last"))
    bounds = keep(chunks.select("s_file", "s_chunk", reached("first").alias("s_place"), reached("last").alias("s_high")))
    # the row of a chunk's bounds is known by a place below 0
    near = bounds.select("s_file", "s_chunk", F.col("s_high").alias("s_h"), (-1 - F.col("s_place")).alias("s_place"))
    # hashes with one place have it in the packet's row
    if not known.filter(F.col("n") > 1).isEmpty():
        wanted = dst.filter(F.col("r_n") > 1).select(F.col("r_file").alias("s_file"), F.col("r_h").alias("s_h"), F.col("r_chunk").alias("s_chunk")).distinct()
        wanted = wanted.join(bounds.select("s_file", "s_chunk", F.col("s_place").alias("low")), ["s_file", "s_chunk"])
        again = src.join(wanted, ["s_file", "s_h"]).filter(F.col("s_place") >= F.col("low"))
        near = near.unionByName(again.select("s_file", "s_chunk", "s_h", "s_place"))
    packets = dst.select("r_file", "r_chunk", "r_h", "r_no", F.when(F.col("r_n") == 1, F.col("r_first")).otherwise(F.lit(-1)).alias("r_first"))
    maps = packets.groupBy("r_file", "r_chunk").cogroup(near.groupBy("s_file", "s_chunk")).applyInArrow(_chunk_maps, MAP)
    walked = maps.repartition("file").sortWithinPartitions("file", "chunk", "upto").mapInArrow(_followed, "file string, identical long, jumps long")
    sizes = light(result).groupBy("file").agg(F.count("*").alias("packets"))
    files = known.select(F.col("s_file").alias("file")).distinct().join(sizes, "file", "full_outer").join(walked, "file", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return files.select("file", none("packets").alias("packets"), none("identical").alias("identical"), (none("jumps") + 1).alias("pieces"))


def verify(counts: DataFrame) -> DataFrame:
    """O-10: a result is lossless when it has packets and all are copies."""
    return counts.withColumn("lossless", (F.col("packets") > 0) & (F.col("packets") == F.col("identical")))


def verify_samples(source: DataFrame, result: DataFrame) -> DataFrame:
    """S-06, O-10: (file, pcm binary) on both sides; equal SHA-256 of the samples."""
    hashed = lambda df, name: df.select("file", F.sha2("pcm", 256).alias(name))
    return hashed(source, "a").join(hashed(result, "b"), "file", "left").select("file", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("lossless"))


def cut_plan(media: DataFrame, kept: DataFrame, mode: str = "auto") -> DataFrame:
    """O-08: per file the mode, method, ending and whether anything is left.

    ``media``: file, ext, codec (of the first audio stream or null), has_video; ``kept``: file and ranges.
    """
    total = kept.groupBy("file").agg(F.count("*").alias("pieces"), F.sum(F.col("end_s") - F.col("start_s")).alias("kept_s"))
    video = F.lit(mode != "audio") & F.col("has_video")
    chosen = F.when(video, "video").otherwise("audio")
    method = F.when(~video & F.coalesce(is_lossless(F.col("codec")), F.lit(False)), "lossless").otherwise("copy")
    ext = F.lower("ext")
    error = F.when(F.col("codec").isNull() & ~F.col("has_video"), "no sound and no picture").when(~video & F.col("codec").isNull(), "no sound track").when(F.col("pieces").isNull(), "nothing left")
    return media.join(total, "file", "left").select(
        "file", chosen.alias("mode"), method.alias("method"), F.when(video, ext).otherwise(audio_extension(F.col("codec"), ext, F.col("has_video"))).alias("ext"), F.coalesce("pieces", F.lit(0)).cast("long").alias("pieces"), F.coalesce("kept_s", F.lit(0.0)).alias("kept_s"), error.alias("error")
    )

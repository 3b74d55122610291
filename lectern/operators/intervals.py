"""Interval algebra over long tables: one row per range, a key column (``rec_id``), ``start_s`` and ``end_s``.

Every operator partitions by the recording, so windows hold the ranges of one recording at most; joins with
``recordings`` (rec_id, duration_s) are equi-joins on the recording. Cuts carry ``reasons``, an array of text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timecodes import cut_list_struct, format_cuts, half_even
from ..settings import DEFAULTS, LEFTOVER, NO_SPEECH, Settings

KEY = "rec_id"


def in_order(*more: str) -> Window:
    return Window.partitionBy(KEY).orderBy("start_s", "end_s", *more)


def islands(ranges: DataFrame, joins: Callable[[Column], Column], key: str = KEY) -> DataFrame:
    """Numbers groups of ranges: a range joins those before it if ``joins(gap to their latest end)``.

    Adds ``island`` and ``gap`` (null for the first range).
    """
    order = Window.partitionBy(key).orderBy("start_s", "end_s")
    before = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = ranges.withColumn("gap", F.col("start_s") - before)
    return numbered.withColumn("island", F.sum(F.when(joins(F.col("gap")), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def coalesce_segments(segments: DataFrame, gap: float = 0.3) -> DataFrame:
    """I-10: segments closer than ``gap`` are one; numbered from 0."""
    merged = islands(segments, lambda g: g < gap).groupBy(KEY, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return merged.select(KEY, (F.row_number().over(in_order()) - 1).alias("seg_no"), "start_s", "end_s")


def merge_touching(ranges: DataFrame) -> DataFrame:
    """I-04: overlapping or touching ranges become one."""
    return islands(ranges, lambda g: g <= 0).groupBy(KEY, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("island")


def drop_blips(segments: DataFrame, recordings: DataFrame, st: Settings = DEFAULTS) -> DataFrame:
    """P-01: without short segments that stand alone; neighbours are those of the given list."""
    left = F.col("start_s") - F.lag("end_s", 1, 0.0).over(in_order())
    right = F.coalesce(F.lead("start_s").over(in_order()), F.col("duration_s")) - F.col("end_s")
    blip = (F.col("end_s") - F.col("start_s") < st.blip_max) & (F.least("left", "right") >= 1.5) & (F.col("left") + F.col("right") >= st.blip_isolation)
    return segments.join(recordings, KEY).withColumns({"left": left, "right": right}).filter(~blip).select(segments.columns)


def gaps(segments: DataFrame, recordings: DataFrame, least: float = 0.5) -> DataFrame:
    """I-02: what lies between segments, as (start_s, end_s, place); a recording without segments is one gap."""
    placed = recordings.join(segments.select(KEY, "start_s", "end_s"), KEY, "left")
    first = F.lag("end_s").over(in_order()).isNull()
    last = F.lead("start_s").over(in_order()).isNull()
    before = F.struct(
        F.coalesce(F.lag("end_s").over(in_order()), F.lit(0.0)).alias("start_s"), F.col("start_s").alias("end_s"), F.when(first, "intro").otherwise("inside").alias("place")
    )
    after = F.when(last, F.struct(F.col("end_s").alias("start_s"), F.col("duration_s").alias("end_s"), F.lit("outro").alias("place")))
    whole = F.struct(F.lit(0.0).alias("start_s"), F.col("duration_s").alias("end_s"), F.lit("all").alias("place"))
    found = F.when(F.col("start_s").isNull(), F.array(whole)).otherwise(F.array_compact(F.array(before, after)))
    rows = placed.withColumn("found", found).select(KEY, "duration_s", F.explode("found").alias("g")).select(KEY, "duration_s", "g.*")
    return rows.filter((F.col("end_s") - F.col("start_s") >= least) | (F.col("place") == "all"))


def cut_gaps(events: DataFrame, st: Settings = DEFAULTS) -> DataFrame:
    """I-09: the gaps that are cut, with ``kind`` (null where sounds were not classified) as their reason."""
    from ..settings import MUSIC, OTHER

    length = F.col("end_s") - F.col("start_s")
    kind = F.coalesce(F.col("kind"), F.lit(""))
    edge = F.col("place").isin("intro", "outro", "all") & (length >= st.edge_min)
    inner = (length > st.max_gap) | ((kind == MUSIC) & (length >= st.music_min))
    if st.other_min > 0:
        inner = inner | ((kind == OTHER) & (length >= st.other_min))
    reason = F.when(F.col("place") == "all", F.lit(NO_SPEECH)).otherwise(F.coalesce(F.col("kind"), F.col("place")))
    return events.filter(edge | ((F.col("place") == "inside") & inner)).select(KEY, "start_s", "end_s", F.array(reason).alias("reasons"))


def _union_of_reasons() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons"))))


def merge_cuts(cuts: DataFrame, recordings: DataFrame | None = None, st: Settings = DEFAULTS) -> DataFrame:
    """I-05 and I-06: cuts closer than merge_gap, or with less than min_keep between them, become one.

    Where a gap of more than merge_gap was joined, the reasons name the leftover. With recordings, ends are
    clipped to the duration and empty cuts dropped.
    """
    joined = islands(cuts, lambda g: (g <= st.merge_gap) | (g < st.min_keep))
    first = F.row_number().over(Window.partitionBy(KEY, "island").orderBy("start_s", "end_s")) == 1
    joined = joined.withColumn("leftover", ~first & (F.col("gap") > st.merge_gap))
    merged = joined.groupBy(KEY, "island").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), _union_of_reasons().alias("reasons"), F.max("leftover").alias("leftover")
    )
    reasons = F.when(F.col("leftover"), F.array_sort(F.array_union("reasons", F.array(F.lit(LEFTOVER))))).otherwise(F.col("reasons"))
    merged = merged.select(KEY, "start_s", "end_s", reasons.alias("reasons"))
    if recordings is None:
        return merged
    return merged.join(recordings, KEY).withColumn("end_s", F.least("end_s", "duration_s")).filter("end_s > start_s").select(KEY, "start_s", "end_s", "reasons")


def round_cuts(cuts: DataFrame, recordings: DataFrame) -> DataFrame:
    """I-07: whole seconds; starts within a second of 0 and ends within a second of the duration snap to them."""
    start = F.when(F.col("start_s") <= 1, F.lit(0.0)).otherwise(F.bround("start_s", 0))
    end = F.when(F.col("end_s") >= F.col("duration_s") - 1, F.col("duration_s")).otherwise(F.floor("end_s").cast("double"))
    out = cuts.join(recordings, KEY).withColumns({"start_s": start, "end_s": end}).filter("end_s > start_s")
    return out.select(KEY, "start_s", "end_s", "reasons")


def cut_list(events: DataFrame, recordings: DataFrame, extra: DataFrame | None = None, st: Settings = DEFAULTS) -> DataFrame:
    """I-09, I-05 and I-07: the base cuts of each recording from its classified gaps and other rules' ranges."""
    bad = cut_gaps(events, st)
    if extra is not None:
        bad = bad.unionByName(extra)
    return round_cuts(merge_cuts(bad, st=st), recordings)


def layered_cuts(base: DataFrame, extra: DataFrame, recordings: DataFrame, st: Settings = DEFAULTS) -> DataFrame:
    """I-19: base cuts with another layer merged in; a recording without a layer keeps its base cuts as they are."""
    touched = extra.select(KEY).distinct()
    merged = merge_cuts(base.join(touched, KEY, "left_semi").unionByName(extra), recordings, st)
    return base.join(touched, KEY, "left_anti").unionByName(merged)


def keep_ranges(cuts: DataFrame, recordings: DataFrame, least: float = 0.05) -> DataFrame:
    """I-03: the complement of the cuts in each recording, pieces longer than ``least``."""
    placed = recordings.join(cuts.select(KEY, "start_s", "end_s"), KEY, "left")
    reached = F.max("end_s").over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    whole_reach = F.max("end_s").over(Window.partitionBy(KEY))
    last = F.lead(F.lit(1)).over(in_order()).isNull()
    start_of = F.greatest(F.coalesce(reached, F.lit(0.0)), F.lit(0.0))
    before = F.struct(start_of.alias("start_s"), F.coalesce("start_s", "duration_s").alias("end_s"))
    tail = F.when(last & F.col("start_s").isNotNull(), F.struct(F.greatest(whole_reach, F.lit(0.0)).alias("start_s"), F.col("duration_s").alias("end_s")))
    rows = placed.withColumn("kept", F.array_compact(F.array(before, tail))).select(KEY, F.explode("kept").alias("k")).select(KEY, "k.*")
    return rows.filter(F.col("end_s") - F.col("start_s") > least)


def timecodes(cuts: DataFrame, recordings: DataFrame) -> DataFrame:
    """F-04 per recording: its cut list as text, ``good`` where nothing is cut."""
    listed = cuts.groupBy(KEY).agg(F.array_sort(F.collect_list(cut_list_struct())).alias("cuts"))
    text = format_cuts(F.coalesce("cuts", F.array().cast("array<struct<start_s:double,end_s:double>>")), F.col("duration_s"))
    return recordings.join(listed, KEY, "left").select(KEY, text.alias("timecodes"))


def hints(events: DataFrame, cuts: DataFrame, st: Settings = DEFAULTS) -> DataFrame:
    """I-08, J-12: inner gaps of short_gap to max_gap that lie in no cut."""
    length = F.col("e.end_s") - F.col("e.start_s")
    pauses = events.alias("e").filter((F.col("e.place") == "inside") & length.between(st.short_gap, st.max_gap))
    inside = (F.col("c.rec_id") == F.col("e.rec_id")) & (F.col("c.start_s") <= F.col("e.start_s")) & (F.col("e.end_s") <= F.col("c.end_s"))
    return pauses.join(cuts.alias("c"), inside, "left_anti").select("e.rec_id", "e.start_s", "e.end_s")


def speech_ratio(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """A-07: the share of each recording that its segments fill, 3 decimals."""
    spoken = segments.groupBy(KEY).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("spoken_s"))
    ratio = F.coalesce("spoken_s", F.lit(0.0)) / F.greatest("duration_s", F.lit(1e-9))
    return recordings.join(spoken, KEY, "left").select(KEY, half_even(ratio, 3).alias("ratio"))


def coverage(cuts: DataFrame, ranges: DataFrame) -> DataFrame:
    """I-20: the share of each range (rec_id, a_s, b_s) that the cuts cover."""
    overlap = F.greatest(F.lit(0.0), F.least("end_s", "b_s") - F.greatest("start_s", "a_s"))
    return (
        ranges.join(cuts.select(KEY, "start_s", "end_s"), KEY, "left")
        .groupBy(KEY, "a_s", "b_s")
        .agg((F.coalesce(F.sum(overlap), F.lit(0.0)) / (F.col("b_s") - F.col("a_s"))).alias("covered"))
    )


def chop(segments: DataFrame, max_len: float = 8.0, min_len: float = 3.0) -> DataFrame:
    """I-11 without the music test: windows of max_len; a short rest joins the last one up to 1.5 times max_len.

    A rest shorter than min_len of a longer piece ends the segment.
    """
    steps = F.sequence(F.lit(0), F.floor((F.col("end_s") - F.col("start_s")) / max_len).cast("int"))
    rows = segments.select(KEY, "start_s", "end_s", F.explode(steps).alias("k"))
    t = F.col("start_s") + F.col("k") * max_len
    rest = F.col("end_s") - t
    end = F.least(t + max_len, F.col("end_s"))
    end = F.when((F.col("end_s") - end < min_len) & (rest <= max_len * 1.5), F.col("end_s")).otherwise(end)
    return rows.filter(rest >= min_len).select(KEY, t.alias("start_s"), end.alias("end_s"))


def speaker_windows(segments: DataFrame, st: Settings = DEFAULTS, min_len: float = 0.8) -> DataFrame:
    """I-15: pieces of speaker_win seconds; a segment with no full piece is one of its own."""
    length = F.col("end_s") - F.col("start_s")
    full = F.floor((length + 0.25) / st.speaker_win).cast("int")
    rows = segments.filter(length >= min_len).select(KEY, "start_s", "end_s", full.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(full - 1, F.lit(0)))).alias("k"))
    start = F.col("start_s") + F.col("k") * st.speaker_win
    end = F.when(F.col("n") == 0, F.col("end_s")).otherwise(F.least(start + st.speaker_win, F.col("end_s")))
    return rows.select(KEY, start.alias("start_s"), end.alias("end_s"))


def pack_for_transcription(segments: DataFrame, max_len: float = 28.0, join_gap: float = 1.5, least: float = 0.3) -> DataFrame:
    """I-14: segments split at max_len, then joined in order while gap and total allow it."""
    piece = F.struct("start_s", "end_s")
    full = F.greatest(F.ceil((F.col("end_s") - F.col("start_s")) / max_len).cast("int") - 1, F.lit(0))
    pieces = F.transform(
        F.sequence(F.lit(0), full),
        lambda k: F.struct(
            (F.col("start_s") + k * max_len).alias("start_s"), F.when(k < full, F.col("start_s") + (k + 1) * max_len).otherwise(F.col("end_s")).alias("end_s"), (k < full).alias("whole")
        ),
    )
    listed = segments.groupBy(KEY).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(piece.alias("p"), pieces.alias("parts")))), lambda s: s["parts"])).alias("parts"))
    kind = "array<struct<start_s:double,end_s:double>>"

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        fits = (F.size(out) > 0) & ~x["whole"] & (x["start_s"] - last["end_s"] <= join_gap) & (x["end_s"] - last["start_s"] <= max_len)
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["start_s"].alias("start_s"), x["end_s"].alias("end_s"))))
        return F.when(fits, longer).otherwise(F.concat(out, F.array(F.struct(x["start_s"].alias("start_s"), x["end_s"].alias("end_s")))))

    packed = F.aggregate("parts", F.array().cast(kind), step)
    return listed.select(KEY, F.posexplode(packed).alias("piece", "p")).select(KEY, "piece", "p.*").filter(F.col("end_s") - F.col("start_s") >= least)


def chain_same_label(labelled: DataFrame, label: str = "label", gap: float = 15.0) -> DataFrame:
    """I-16: neighbours of one label with at most ``gap`` between them become (start_s, end_s, n)."""
    order = in_order()
    same = (F.lag(label).over(order) == F.col(label)) & (F.col("start_s") - F.lag("end_s").over(order) <= gap)
    chained = labelled.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy(KEY, "chain", label).agg(F.min("start_s").alias("start_s"), F.max_by("end_s", F.struct("start_s", "end_s")).alias("end_s"), F.count("*").alias("n")).drop("chain")


def runs(series: DataFrame, mask: Column, at: str = "sec", least: int = 1, more: list[Column] | None = None) -> DataFrame:
    """I-01: [start, end) of the runs of positions where ``mask`` holds, of at least ``least`` positions.

    ``more``: aggregates of each run's rows besides.
    """
    order, more = Window.partitionBy(KEY).orderBy(at), more or []
    held = series.filter(mask).select(*(series.columns if more else (KEY, at)), (F.col(at) - F.row_number().over(order)).alias("island"))
    found = held.groupBy(KEY, "island").agg(F.min(at).alias("run_start"), (F.max(at) + 1).alias("run_end"), *more)
    return found.filter(F.col("run_end") - F.col("run_start") >= least).drop("island")


def _neighbour(ranges: DataFrame, marks: DataFrame, at: str, side: str, slack: float) -> DataFrame:
    """As-of join by one sorted window: per range the next mark from ``at`` - slack on, or the last up to ``at`` + slack.

    ``ranges`` need a unique ``piece`` per recording; adds ``found`` (null without such a mark).
    """
    bound = F.col(at) + (slack if side == "last" else -slack)
    both = ranges.select(KEY, "piece", bound.alias("t"), F.lit(1 if side == "last" else 0).alias("o"), F.lit(None).cast("double").alias("mark")).unionByName(
        marks.select(KEY, F.lit(None).cast("int").alias("piece"), F.col("pts").alias("t"), F.lit(0 if side == "last" else 1).alias("o"), F.col("pts").alias("mark"))
    )
    order = Window.partitionBy(KEY).orderBy("t", "o")
    if side == "last":
        found = F.last("mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    else:
        found = F.first("mark", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("found", found).filter(F.col("piece").isNotNull()).select(KEY, "piece", "found")


def snap_to_packets(keep: DataFrame, packets: DataFrame, recordings: DataFrame, least: float = 0.05) -> DataFrame:
    """I-12: both ends move to the first packet start at or after them, else to the duration.

    Recordings with fewer than two packets stay as they are. ``packets``: rec_id, pts.
    """
    packets = packets.filter("pts >= 0").select(KEY, "pts").distinct()
    enough = packets.groupBy(KEY).agg(F.count("*").alias("n"))
    pieces = keep.withColumn("piece", F.row_number().over(in_order()))
    a = _neighbour(pieces, packets, "start_s", "first", 1e-6).withColumnRenamed("found", "a2")
    b = _neighbour(pieces, packets, "end_s", "first", 1e-6).withColumnRenamed("found", "b2")
    moved = pieces.join(a, [KEY, "piece"]).join(b, [KEY, "piece"]).join(recordings, KEY).join(enough, KEY, "left").withColumn("usable", F.coalesce(F.col("n") >= 2, F.lit(False)))
    start = F.when(F.col("usable"), F.coalesce("a2", "duration_s")).otherwise(F.col("start_s"))
    end = F.when(F.col("usable"), F.coalesce("b2", "duration_s")).otherwise(F.col("end_s"))
    out = moved.select(KEY, "usable", start.alias("start_s"), end.alias("end_s"))
    return out.filter(~F.col("usable") | (F.col("end_s") - F.col("start_s") > least)).drop("usable")


def widen_to_keyframes(keep: DataFrame, keyframes: DataFrame, recordings: DataFrame) -> DataFrame:
    """I-13: starts go back to a key frame (else 0), ends on to the next (else the duration); overlaps merge."""
    keyframes = keyframes.select(KEY, "pts").distinct()
    known = keyframes.select(KEY).distinct()
    pieces = keep.join(known, KEY, "left_semi").withColumn("piece", F.row_number().over(in_order()))
    a = _neighbour(pieces, keyframes, "start_s", "last", 1e-3).withColumnRenamed("found", "a2")
    b = _neighbour(pieces, keyframes, "end_s", "first", 1e-3).withColumnRenamed("found", "b2")
    wide = pieces.join(a, [KEY, "piece"]).join(b, [KEY, "piece"]).join(recordings, KEY)
    wide = wide.select(KEY, F.coalesce("a2", F.lit(0.0)).alias("start_s"), F.coalesce("b2", "duration_s").alias("end_s"))
    return merge_touching(wide).unionByName(keep.join(known, KEY, "left_anti").select(KEY, "start_s", "end_s"))


def trim_plan(keep: DataFrame, rates: DataFrame) -> DataFrame:
    """I-21: kept ranges in samples (rec_id, sample_rate); a rate that is not above 0 is an error."""
    rate = F.when(F.col("sample_rate") > 0, F.col("sample_rate")).otherwise(F.raise_error(F.lit("unknown sample rate")).cast("int"))
    return keep.join(rates, KEY).select(KEY, F.bround(F.col("start_s") * rate, 0).cast("long").alias("start_sample"), F.bround(F.col("end_s") * rate, 0).cast("long").alias("end_sample"))

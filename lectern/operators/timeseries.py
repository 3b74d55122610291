"""Time series per recording: music per second (rec_id, sec, prob) and frame levels (rec_id, t_s, db, power)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timecodes import half_even
from ..session import keep
from ..settings import BACKGROUND_MUSIC, DEFAULTS, MUSIC, MUSIC_UNDER, OTHER, QUIET_SOUNDS, QUIET_SPEECH, SILENCE, Settings
from .intervals import KEY, gaps, in_order, runs

def by_second() -> Window:
    return Window.partitionBy(KEY).orderBy("sec")


def decibels(power: Column) -> Column:
    """F-22: the level of a mean square."""
    return 20 * F.log10(F.sqrt(power) + 1e-9)


def frame_levels(samples: DataFrame, frame: int = 160) -> DataFrame:
    """W-01: (rec_id, pos, value) to one level per whole frame; a recording shorter than a frame has one."""
    n = F.max("pos").over(Window.partitionBy(KEY)) + 1
    numbered = samples.withColumn("n", n).withColumn("frame_no", F.floor(F.col("pos") / frame).cast("int"))
    whole = numbered.filter((F.col("n") < frame) | (F.col("frame_no") < F.floor(F.col("n") / frame)))
    power = whole.groupBy(KEY, "frame_no").agg(F.avg(F.col("value") * F.col("value")).alias("power"))
    return power.select(KEY, "frame_no", decibels(F.col("power")).alias("db"), "power")


def assign_points(points: DataFrame, ranges: DataFrame, at: str = "t_s") -> DataFrame:
    """J-10: the points inside disjoint ranges (half open), each with its range's start and end.

    One sort per recording instead of comparing every point with every range.
    """
    fields = [c for c in points.columns if c != KEY]
    marks = ranges.select(KEY, F.col("start_s").alias("at"), F.lit(0).alias("o"), F.struct("start_s", "end_s").alias("r"), *[F.lit(None).cast(dict(points.dtypes)[c]).alias(c) for c in fields])
    rows = points.select(KEY, F.col(at).cast("double").alias("at"), F.lit(1).alias("o"), F.lit(None).cast("struct<start_s:double,end_s:double>").alias("r"), *fields)
    order = Window.partitionBy(KEY).orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).withColumn("r", F.last("r", ignorenulls=True).over(order))
    return both.filter((F.col("o") == 1) & (F.col("at") < F.col("r.end_s"))).select(KEY, *fields, "r.start_s", "r.end_s")


def seconds_in(series: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    """J-11: the series (rec_id, sec, ...) with a flag for the whole seconds that ranges touch.

    A second is touched if a range that begins in it or before reaches it, so one sort per recording tells.
    """
    last = F.ceil("end_s").cast("int") - 1
    kinds = dict(series.dtypes)
    rows = series.select(*series.columns, F.lit(1).alias("o"), F.lit(None).cast("int").alias("until"))
    marks = ranges.filter(last >= F.floor("start_s")).select(
        KEY, F.floor("start_s").cast("int").alias("sec"), *[F.lit(None).cast(kinds[c]).alias(c) for c in series.columns if c not in (KEY, "sec")], F.lit(0).alias("o"), last.alias("until")
    )
    order = Window.partitionBy(KEY).orderBy("sec", "o").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).withColumn(name, F.coalesce(F.max("until").over(order) >= F.col("sec"), F.lit(False)))
    return both.filter("o = 1").select(*series.columns, name)


def with_speech(music: DataFrame, segments: DataFrame) -> DataFrame:
    """The music series with a flag for seconds that speech touches."""
    return seconds_in(music, segments, "speech")


def share_of_seconds(ranges: DataFrame, music: DataFrame, least: float) -> DataFrame:
    """(rec_id, start_s, share): of the known seconds that a range touches the share with a probability of ``least`` or more.

    Counts up to the range's end less those up to its start, by one sort per recording.
    """
    first, known = F.floor("start_s").cast("int"), F.col("prob").isNotNull()
    after = F.greatest(F.ceil("end_s").cast("int"), first + 1)
    ends = F.array(F.struct(first.alias("sec"), F.lit(-1).alias("sign")), F.struct(after.alias("sec"), F.lit(1).alias("sign")))
    edges = ranges.select(KEY, "start_s", F.inline(ends)).withColumns({"o": F.lit(0), "n": F.lit(0), "hit": F.lit(0)})
    rows = music.filter(known).select(
        KEY, F.lit(None).cast("double").alias("start_s"), "sec", F.lit(None).cast("int").alias("sign"), F.lit(1).alias("o"), F.lit(1).alias("n"), (F.col("prob") >= least).cast("int").alias("hit")
    )
    order = Window.partitionBy(KEY).orderBy("sec", "o").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.unionByName(edges).withColumns({"n": F.sum("n").over(order), "hit": F.sum("hit").over(order)}).filter("o = 0")
    counted = summed.groupBy(KEY, "start_s").agg(F.sum(F.col("sign") * F.col("n")).alias("n"), F.sum(F.col("sign") * F.col("hit")).alias("hit"))
    return counted.filter("n > 0").select(KEY, "start_s", (F.col("hit") / F.col("n")).alias("share"))


def _percentile(q: float, value: str = "db", place: str = "k", size: str = "n") -> Column:
    """The percentile of a group whose rows have their ``place`` among ``size`` values; as ``percentile`` interpolates."""
    at = (F.max(size) - 1) * F.lit(q)
    low, high = F.max(F.when(F.col(place) == F.floor((F.col(size) - 1) * q) + 1, F.col(value))), F.max(F.when(F.col(place) == F.ceil((F.col(size) - 1) * q) + 1, F.col(value)))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def stretches(frames: DataFrame, segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """A-06, W-09: every segment (``place`` speech) and every stretch between segments, with the levels of its frames.

    rec_id, start_s, end_s, place, rms, peak, and the recording's speech_db and background_db. All is told by one pass over
    the frames: one sort by time finds the stretch of each, one by level within stretches the percentiles. A segment of
    no length begins where the stretch after it begins and has no frames.
    """
    between = gaps(segments, recordings, least=0.0).filter("end_s > start_s OR place = 'all'").select(KEY, "start_s", "end_s", "place")
    ranges = between.unionByName(segments.select(KEY, "start_s", "end_s", F.lit("speech").alias("place")))
    nothing = lambda **kinds: [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
    marks = ranges.select(KEY, F.col("start_s").alias("at"), F.lit(0).alias("o"), "start_s", "end_s", "place", *nothing(db="double", power="double"))
    rows = frames.select(KEY, F.col("t_s").cast("double").alias("at"), F.lit(1).alias("o"), *nothing(start_s="double", end_s="double", place="string"), "db", "power")
    order = Window.partitionBy(KEY).orderBy("at", "o", "end_s").rowsBetween(Window.unboundedPreceding, 0)
    lasts = {c: F.last(c, ignorenulls=True).over(order) for c in ("start_s", "end_s", "place")}
    both = rows.unionByName(marks).withColumns(lasts | {"p10": F.percentile("db", 0.1).over(Window.partitionBy(KEY))})
    inside = (F.col("o") == 0) | (F.col("at") < F.col("end_s"))
    placed = both.select(KEY, "p10", "db", "power", *[F.when(inside, F.col(c)).alias(c) for c in ("start_s", "end_s", "place")])
    by_level = Window.partitionBy(KEY, "start_s", "end_s").orderBy(F.asc_nulls_last("db"))
    n = F.count("db").over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = placed.withColumns({"k": F.row_number().over(by_level), "n": n}).groupBy(KEY, "start_s", "end_s").agg(
        F.max("place").alias("place"), decibels(F.avg("power")).alias("rms"), _percentile(0.5).alias("middle"), _percentile(0.95).alias("peak"), F.max("p10").alias("p10")
    )
    own = Window.partitionBy(KEY)
    pause = (F.col("place") == "inside") & (F.col("end_s") - F.col("start_s") >= 0.3)
    speech_db = F.coalesce(F.median(F.when(F.col("place") == "speech", F.col("rms"))).over(own), F.lit(-30.0))
    background_db = F.coalesce(F.median(F.when(pause, F.col("middle"))).over(own), F.max("p10").over(own))
    return found.withColumns({"speech_db": speech_db, "background_db": background_db}).filter("place IS NOT NULL").drop("middle", "p10")


def levels(frames: DataFrame, segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """A-06, W-09: per recording the speech level and the background level."""
    heard = stretches(frames, segments, recordings).groupBy(KEY).agg(F.max("speech_db").alias("speech_db"), F.max("background_db").alias("background_db"))
    return recordings.select(KEY).join(heard, KEY, "left").select(KEY, F.coalesce("speech_db", F.lit(-30.0)).alias("speech_db"), "background_db")


def hear_gaps(frames: DataFrame, music: DataFrame, segments: DataFrame, recordings: DataFrame, st: Settings = DEFAULTS, least: float = 0.5) -> DataFrame:
    """I-02 with W-02: the gaps between segments with ``kind``, by the music in them and the levels of their frames."""
    length = F.col("end_s") - F.col("start_s")
    events = stretches(frames, segments, recordings).filter((F.col("place") != "speech") & ((length >= least) | (F.col("place") == "all")))
    share = share_of_seconds(gaps(segments, recordings, least), music, st.music_thr)
    peak, rms = F.coalesce("peak", F.lit(-120.0)), F.coalesce("rms", F.lit(-120.0))
    kind = (
        F.when(F.coalesce("share", F.lit(0.0)) >= 0.5, MUSIC)
        .when((peak < -50) | (peak < F.col("background_db") + st.event_db), SILENCE)
        .when(rms < F.col("speech_db") - st.prominent_db, QUIET_SOUNDS)
        .otherwise(OTHER)
    )
    return events.join(share, [KEY, "start_s"], "left").select(KEY, "start_s", "end_s", "place", kind.alias("kind"))


def music_under_speech(music: DataFrame, segments: DataFrame, events: DataFrame, recordings: DataFrame, st: Settings = DEFAULTS) -> DataFrame:
    """W-03: runs of clear music in speech seconds, unless short and beside a music gap (``events`` with kind)."""
    near = by_second().rowsBetween(-2, 2)
    raw = (F.col("prob") >= st.music_thr).cast("int")
    series = with_speech(music, segments).withColumn("raw", raw).withColumn("core", F.min("raw").over(near)).withColumn("opened", F.max("core").over(near) * F.col("raw"))
    series = series.withColumn("m", (F.col("opened") == 1) & F.col("speech"))
    series = series.withColumn("m", F.col("m") | (F.lag("m", 1, False).over(by_second()) & F.lead("m", 1, False).over(by_second())))
    found = runs(series, F.col("m"), least=int(st.music_min)).join(recordings, KEY)
    found = found.select(KEY, F.col("run_start").cast("double").alias("start_s"), F.least(F.col("run_end").cast("double"), "duration_s").alias("end_s"))
    heard = events.filter(F.col("kind") == MUSIC).select(F.col(KEY).alias("g_rec"), F.col("start_s").alias("g_start"), F.col("end_s").alias("g_end"))
    beside = (F.abs(F.col("start_s") - F.col("g_end")) <= 1) | (F.abs(F.col("g_start") - F.col("end_s")) <= 1)
    dropped = (F.col(KEY) == F.col("g_rec")) & beside & (F.col("end_s") - F.col("start_s") <= 4)
    return found.join(heard, dropped, "left_anti").withColumn("reasons", F.array(F.lit(MUSIC_UNDER)))


def background_music(music: DataFrame, segments: DataFrame, recordings: DataFrame, st: Settings = DEFAULTS) -> DataFrame:
    """W-06: cuts (rec_id, start_s, end_s, reasons) where the averaged music probability stays up in speech."""
    half = st.bg_window // 2
    mean = F.sum("prob").over(by_second().rowsBetween(-half, half)) / F.lit(float(st.bg_window))
    series = with_speech(music, segments).withColumn("mean", mean).withColumn("loud", (F.col("prob") >= st.bg_music_thr / 2).cast("int"))
    back = fore = F.lit(0)
    behind = ahead = F.lit(1)
    for k in range(1, half + 1):
        behind = behind * F.lag("loud", k, 0).over(by_second())
        ahead = ahead * F.lead("loud", k - 1, 0).over(by_second())
        back, fore = back + behind, fore + ahead
    series = series.withColumns({"back": back, "fore": fore})
    follows = F.lead("sec").over(by_second()) == F.col("sec") + 1
    series = series.withColumn("next_fore", F.when(follows, F.lead("fore").over(by_second())))
    ends = [F.min_by("back", "sec").alias("back"), F.max_by("next_fore", "sec").alias("fore")]
    found = runs(series, (F.col("mean") >= st.bg_music_thr) & F.col("speech"), least=st.bg_min_run, more=ends)
    grown = found.join(recordings, KEY)
    end = F.col("run_end") + F.coalesce("fore", F.lit(0))
    return grown.select(
        KEY, (F.col("run_start") - F.col("back")).cast("double").alias("start_s"), F.least(end.cast("double"), "duration_s").alias("end_s"), F.array(F.lit(BACKGROUND_MUSIC)).alias("reasons")
    )


def music_share(music: DataFrame, segments: DataFrame, found: DataFrame, base_cuts: DataFrame) -> DataFrame:
    """W-06: the share of speech seconds under background music or under base cuts for music, 3 decimals."""
    covered = found.select(KEY, "start_s", "end_s").unionByName(base_cuts.filter(F.array_contains("reasons", MUSIC_UNDER)).select(KEY, "start_s", "end_s"))
    series = seconds_in(with_speech(music, segments), covered, "under").filter("speech")
    return series.groupBy(KEY).agg(half_even(F.count_if("under") / F.count("*"), 3).alias("share"))


def speech_chunks(segments: DataFrame, music: DataFrame, st: Settings = DEFAULTS, most: float = 0.3) -> DataFrame:
    """I-11: windows of speech in which less than ``most`` of the known seconds pass music_thr."""
    from .intervals import chop

    windows = chop(segments)
    share = share_of_seconds(windows, music, st.music_thr)
    return windows.join(share, [KEY, "start_s"], "left").filter(F.coalesce("share", F.lit(0.0)) < most).select(KEY, "start_s", "end_s")


def sliding_windows(recordings: DataFrame, length: float = 6.0, hop: float = 1.0) -> DataFrame:
    """W-04: (rec_id, sec, a_s, b_s): the window around every second that a tagger hears; it is padded beyond the ends."""
    last = F.greatest(F.ceil(F.col("duration_s") / hop).cast("int") - 1, F.lit(0))
    seconds = recordings.select(KEY, F.explode(F.sequence(F.lit(0), last)).alias("sec"))
    middle = (F.col("sec") + 0.5) * hop
    return seconds.select(KEY, "sec", (middle - length / 2).alias("a_s"), (middle + length / 2).alias("b_s"))


def polarity(blocks: DataFrame, block_s: float = 0.5) -> DataFrame:
    """A-13: ranges of blocks (rec_id, block, mid, side, n) whose right channel is inverted, in seconds."""
    inverted = (F.col("side") > 4 * F.col("mid")) & (F.col("side") / F.greatest("n", F.lit(1)) > 1e-7)
    found = runs(blocks, inverted, at="block")
    return found.select(KEY, (F.col("run_start") * block_s).alias("start_s"), (F.col("run_end") * block_s).alias("end_s"))


def _speech_bins(frames: DataFrame, segments: DataFrame, step: float, st: Settings) -> DataFrame:
    """(rec_id, start_s, lowest, highest, n, dbs): the frames of a segment that lie in the same centred windows, the slots lowest to highest."""
    half = st.quiet_win / 2
    lowest, highest = F.floor((F.col("t_s") - half) / step).cast("int") + 1, F.floor((F.col("t_s") + half) / step).cast("int")
    return assign_points(frames, segments).groupBy(KEY, "start_s", lowest.alias("lowest"), highest.alias("highest")).agg(F.count("*").alias("n"), F.collect_list("db").alias("dbs"))


def _percentile_of(values: Column, q: float) -> Column:
    """The percentile of a sorted array; as ``percentile`` interpolates."""
    at = (F.size(values) - 1) * F.lit(q)
    low, high = F.try_element_at(values, F.floor(at).cast("int") + 1), F.try_element_at(values, F.ceil(at).cast("int") + 1)
    return F.when(F.size(values) > 0, F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))


def _slot_levels(bins: DataFrame, recordings: DataFrame, frame_s: float, step: float, st: Settings) -> DataFrame:
    """(rec_id, slot, level): a slot's frames are gathered from the bins around it, so that no frame is written once per slot."""
    slots = recordings.filter("duration_s > 0").select(KEY, F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration_s") / step).cast("int") - 1)).alias("at"))
    both = slots.select(KEY, "at", F.lit(True).alias("slot"), F.lit(None).cast("int").alias("highest"), F.lit(None).cast("long").alias("n"), F.array().cast("array<double>").alias("dbs")).unionByName(
        bins.select(KEY, F.col("lowest").alias("at"), F.lit(False).alias("slot"), "highest", "n", F.col("dbs").cast("array<double>").alias("dbs"))
    )
    # a window's slots are as many as its steps, one more where rounding has it
    near = Window.partitionBy(KEY).orderBy("at").rangeBetween(-(int(st.quiet_win / step) + 1), 0)
    gathered = both.withColumn("bins", F.collect_list(F.when(~F.col("slot"), F.struct("highest", "n", "dbs"))).over(near)).filter("slot")
    inside = gathered.select(KEY, F.col("at").alias("slot"), F.filter("bins", lambda b: b["highest"] >= F.col("at")).alias("bins"))
    enough = F.aggregate("bins", F.lit(0).cast("long"), lambda n, b: n + b["n"]) * frame_s >= st.quiet_win * 0.25
    heard = inside.filter((F.size("bins") > 0) & enough).select(KEY, "slot", F.sort_array(F.flatten("bins.dbs")).alias("dbs"))
    return heard.select(KEY, "slot", _percentile_of(F.col("dbs"), 0.9).alias("level"))


def quiet_levels(frames: DataFrame, segments: DataFrame, recordings: DataFrame, frame_s: float = 0.03, step: float = 5.0, st: Settings = DEFAULTS) -> DataFrame:
    """W-05, first part: (rec_id, slot, level) of the centred windows that hold enough speech."""
    return _slot_levels(_speech_bins(frames, segments, step, st), recordings, frame_s, step, st)


def quiet_speech(frames: DataFrame, segments: DataFrame, recordings: DataFrame, frame_s: float = 0.03, step: float = 5.0, st: Settings = DEFAULTS) -> DataFrame:
    """W-05: stretches of much quieter speech as whole segments.

    A run of quiet windows starts from the segments it overlaps. On either side it takes in the stretch of low
    segments next to it; where there is none it draws back to the nearest low segment inside. All of it is windows
    over the numbered segments of a recording. What is read more than once is kept. ``level`` is the median of the
    run's windows, ``ref`` the level that they were compared with.
    """
    bins = keep(_speech_bins(frames, segments, step, st))
    level = keep(_slot_levels(bins, recordings, frame_s, step, st))
    reference = level.groupBy(KEY).agg(F.percentile("level", 0.8).alias("ref"))
    low = level.join(reference, KEY).withColumn("quiet", (F.col("level") < st.quiet_abs) & (F.col("level") - F.col("ref") < st.quiet_rel))
    found = runs(low, F.col("quiet"), at="slot", more=[F.median("level").alias("level"), F.max("ref").alias("ref")]).join(recordings, KEY)
    found = found.select(KEY, (F.col("run_start") * step).alias("a"), F.least(F.col("run_end") * step, "duration_s").alias("b"), "level", "ref")

    own = bins.groupBy(KEY, "start_s").agg(F.sort_array(F.flatten(F.collect_list("dbs"))).alias("dbs")).select(KEY, "start_s", _percentile_of(F.col("dbs"), 0.9).alias("level"))
    numbered = segments.select(KEY, "start_s", "end_s", (F.row_number().over(in_order()) - 1).alias("no"))
    loudness = F.when(F.col("end_s") - F.col("start_s") > 0.1, F.coalesce("level", F.lit(-120.0))).otherwise(-120.0)
    threshold = F.least(F.lit(st.quiet_abs), F.col("ref") + st.quiet_rel) + 3
    marked = numbered.join(own, [KEY, "start_s"], "left").join(reference, KEY).withColumn("low", loudness < threshold)
    order = Window.partitionBy(KEY).orderBy("no")
    so_far, from_here = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    low_no, loud_no = F.when(F.col("low"), F.col("no")), F.when(~F.col("low"), F.col("no"))
    marked = marked.withColumns(
        {
            "low_before": F.max(low_no).over(so_far),
            "low_after": F.min(low_no).over(from_here),
            "stretch_first": F.coalesce(F.max(loud_no).over(so_far), F.lit(-1)) + 1,
            "stretch_last": F.coalesce(F.min(loud_no).over(from_here) - 1, F.max("no").over(Window.partitionBy(KEY))),
        }
    )
    marked = marked.withColumns({"grown_first": F.when(F.lag("low").over(order), F.lag("stretch_first").over(order)), "grown_last": F.when(F.lead("low").over(order), F.lead("stretch_last").over(order))})
    marked = keep(marked.join(found.select(KEY), KEY, "left_semi"))
    touched = found.join(marked.select(KEY, "no", "start_s", "end_s"), KEY).filter((F.col("end_s") > F.col("a")) & (F.col("start_s") < F.col("b")))
    spans = touched.groupBy(KEY, "a", "level", "ref").agg(F.min("no").alias("i"), F.max("no").alias("j"))
    spans = spans.join(marked.select(KEY, F.col("no").alias("i"), "grown_first", "low_after"), [KEY, "i"]).join(marked.select(KEY, F.col("no").alias("j"), "grown_last", "low_before"), [KEY, "j"])
    spans = spans.withColumn("reach", F.coalesce("grown_last", "j"))
    spans = spans.withColumn("first", F.coalesce("grown_first", F.least(F.coalesce("low_after", "reach"), "reach")))
    spans = spans.withColumn("last", F.coalesce("grown_last", F.greatest(F.coalesce("low_before", "first"), "first")))
    begin = marked.select(KEY, F.col("no").alias("first"), "start_s")
    finish = marked.select(KEY, F.col("no").alias("last"), "end_s")
    whole = spans.select(KEY, "first", "last", "level", "ref").join(begin, [KEY, "first"]).join(finish, [KEY, "last"])
    return whole.filter(F.col("end_s") - F.col("start_s") >= st.quiet_min).select(KEY, "start_s", "end_s", F.array(F.lit(QUIET_SPEECH)).alias("reasons"), "level", "ref")


#: Of so many rows or fewer all distances are held at once; of more, groups are known by their means.
MATRIX_ROWS = 1500


def ward_two(vectors: np.ndarray) -> np.ndarray:
    """Labels 1 and 2 of Ward's clustering cut at two groups, by nearest-neighbour chains; needs two or more rows.

    Beyond MATRIX_ROWS the memory grows with the rows; the time always with their square.
    """
    n = len(vectors)
    size = np.ones(n, dtype=float)
    if n > MATRIX_ROWS:
        return _two_groups(*_merges_of_means(vectors.astype(float), size), n)
    dist = ((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(-1) if n * n * vectors.shape[1] < 5e7 else (
        np.maximum((vectors**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :] - 2 * vectors @ vectors.T, 0)
    )
    np.fill_diagonal(dist, np.inf)
    alive = np.ones(n, dtype=bool)

    def row_of(a: int) -> np.ndarray:
        return np.where(alive, dist[a], np.inf)

    def merge(a: int, b: int) -> None:
        height, na, nb = dist[a, b], size[a], size[b]
        moved = ((na + size) * dist[a] + (nb + size) * dist[b] - size * height) / (na + nb + size)
        size[a], alive[b] = na + nb, False
        dist[a, :] = dist[:, a] = moved
        dist[a, a] = np.inf
        dist[b, :] = dist[:, b] = np.inf

    return _two_groups(row_of, merge, alive, n)


def _merges_of_means(means: np.ndarray, size: np.ndarray):
    """The distances of one group to all, and a merge of two, from the groups' means and sizes."""
    alive = np.ones(len(means), dtype=bool)

    def row_of(a: int) -> np.ndarray:
        row = ((means - means[a]) ** 2).sum(-1) * (2 * size * size[a] / (size + size[a]))
        row[~alive] = row[a] = np.inf
        return row

    def merge(a: int, b: int) -> None:
        means[a] = (size[a] * means[a] + size[b] * means[b]) / (size[a] + size[b])
        size[a], alive[b] = size[a] + size[b], False

    return row_of, merge, alive


def _two_groups(row_of: Callable[[int], np.ndarray], merge: Callable[[int, int], None], alive: np.ndarray, n: int) -> np.ndarray:
    members, top, chain = {i: [i] for i in range(n)}, (-np.inf, [], []), []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            row = row_of(a)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = chain.pop(), chain.pop()
        if not top[1] or row[b] > top[0]:
            top = (row[b], members[a], members[b])
        members[a] = members[a] + members.pop(b)
        merge(a, b)
    _, left, right = top
    labels = np.ones(n, dtype=int)
    other = right if 0 in left else left if 0 in right else (right if min(left) < min(right) else left)
    labels[other] = 2
    return labels

"""Plans over whole recordings: O-01 analysis, O-02 and O-03 recomputation from kept intermediates."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import suitability as U
from ..operators import text as X
from ..operators import timeseries as W
from ..operators import voting as A
from ..operators import words as V
from ..operators.intervals import KEY
from ..session import keep, keep_by
from ..settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Inputs:
    """What models give; any but segments and recordings may be None.

    Speech segments, music per second, frame levels, words, labelled chunks (chunk, label, grp) and voices of pieces.
    """

    segments: DataFrame
    recordings: DataFrame
    music: DataFrame | None = None
    frames: DataFrame | None = None
    words: DataFrame | None = None
    accents: DataFrame | None = None
    voice: DataFrame | None = None

    def by_recording(self, dealt: tuple[str, ...] = ()) -> Inputs:
        """Each table dealt once by recording, so that the layers, which are all per recording, share that exchange.

        ``dealt``: the tables that are so already.
        """
        return replace(self, **{f.name: keep_by(getattr(self, f.name), KEY) for f in fields(self) if getattr(self, f.name) is not None and f.name not in dealt})

    def only(self, **recordings: DataFrame | None) -> Inputs:
        """The named tables without the recordings that the table given for them lacks, None for those given as None."""
        own = {name: None if wanted is None or getattr(self, name) is None else getattr(self, name).join(wanted.select(KEY), KEY, "left_semi") for name, wanted in recordings.items()}
        return replace(self, **own)


@dataclass(frozen=True)
class Analysis:
    """The results that are kept: speech without blips, classified gaps, base cuts, final cuts and cut lists."""

    speech: DataFrame
    events: DataFrame
    base_cuts: DataFrame
    cuts: DataFrame
    hints: DataFrame
    timecodes: DataFrame


def base_analysis(inputs: Inputs, st: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Speech, classified gaps and the cuts of the sound rules.

    The three are kept, as later steps and recomputations read them more than once.
    """
    speech = keep_by(I.drop_blips(inputs.segments, inputs.recordings, st), KEY)
    if inputs.frames is not None and inputs.music is not None:
        events = W.hear_gaps(inputs.frames, inputs.music, speech, inputs.recordings, st)
    else:
        events = I.gaps(speech, inputs.recordings).drop("duration_s").withColumn("kind", F.lit(None).cast("string"))
    events = keep_by(events, KEY)
    extra = None
    if inputs.music is not None:
        extra = W.music_under_speech(inputs.music, speech, events, inputs.recordings, st)
    if inputs.frames is not None and st.quiet_enabled:
        quiet = W.quiet_speech(inputs.frames, speech, inputs.recordings, st=st).drop("level", "ref")
        extra = quiet if extra is None else extra.unionByName(quiet)
    return speech, events, keep_by(I.cut_list(events, inputs.recordings, extra, st), KEY)


def layers(inputs: Inputs, speech: DataFrame, st: Settings = DEFAULTS) -> DataFrame | None:
    """The cuts added over the base: quiet background music and phrases with listed words."""
    found = None
    if inputs.music is not None and st.bg_music:
        found = W.background_music(inputs.music, speech, inputs.recordings, st)
    entries = V.word_list(st.words)
    if inputs.words is not None and entries:
        phrases = V.phrase_cuts(inputs.words, entries, inputs.recordings, st, st.words_phrase).select(KEY, "start_s", "end_s", "reasons")
        found = phrases if found is None else found.unionByName(phrases)
    return found


def finish(base: DataFrame, extra: DataFrame | None, events: DataFrame, recordings: DataFrame, st: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Final cuts, hints outside them, and cut lists."""
    cuts = base if extra is None else I.layered_cuts(base, extra, recordings, st)
    return cuts, I.hints(events, cuts, st), I.timecodes(cuts, recordings)


def analyze(inputs: Inputs, st: Settings = DEFAULTS) -> Analysis:
    """O-01: everything from model outputs to cut lists as one plan."""
    speech, events, base = base_analysis(inputs, st)
    cuts, hints, timecodes = finish(base, layers(inputs, speech, st), events, inputs.recordings, st)
    return Analysis(speech, events, base, cuts, hints, timecodes)


def recompute(kept: DataFrame, base: DataFrame, inputs: Inputs, speech: DataFrame, events: DataFrame, st: Settings) -> DataFrame:
    """O-02, O-03: cut lists again after a change of settings, from kept intermediates.

    ``kept``: rec_id, timecodes, settings (a fingerprint), cut_timecodes (null if not cut yet). Only recordings of
    other settings are computed; ``changed`` marks new cut lists and ``recut`` cut files whose list changed.
    """
    stale = kept.filter(F.col("settings") != st.fingerprint())
    only = lambda df: df.join(stale.select(KEY), KEY, "left_semi") if df is not None else None
    own = Inputs(only(inputs.segments), only(inputs.recordings), only(inputs.music), only(inputs.frames), only(inputs.words))
    _, _, lists = finish(only(base), layers(own, only(speech), st), only(events), own.recordings, st)
    fresh = lists.withColumnRenamed("timecodes", "new")
    joined = kept.join(fresh, KEY, "left")
    now = F.coalesce("new", "timecodes")
    return joined.select(
        KEY,
        now.alias("timecodes"),
        F.lit(st.fingerprint()).alias("settings"),
        "cut_timecodes",
        (now != F.col("timecodes")).alias("changed"),
        F.coalesce(F.col("new").isNotNull() & (now != F.col("cut_timecodes")), F.lit(False)).alias("recut"),
    )


def transcripts(inputs: Inputs) -> DataFrame:
    """The excerpts that topic and phrases of an encounter are judged by: rec_id, text, title."""
    return V.excerpts(inputs.words, inputs.recordings).withColumn("title", F.lit(""))


def whole_talks(inputs: Inputs) -> DataFrame:
    """All that is said in a recording, in the form of ``transcripts``."""
    said = F.array_sort(F.collect_list(F.struct("word_no", F.trim("word").alias("t"))))
    return inputs.words.join(inputs.recordings.select(KEY), KEY, "left_semi").groupBy(KEY).agg(F.array_join(F.transform(said, lambda w: w["t"]), " ").alias("text")).withColumn("title", F.lit(""))


def results(inputs: Inputs, timecodes: DataFrame, base_cuts: DataFrame, speech: DataFrame, vocabulary: tuple[str, ...] = (), st: Settings = DEFAULTS, sampled: bool = False) -> DataFrame:
    """O-01: one row per recording with all that is found out besides the cuts, and why it does not fit (``why``).

    Accents are told by the votes of all chunks, topic and encounter by all words; ``sampled``: by the evenly spaced chunks
    of A-04 and the excerpts of W-11.

    rec_id, timecodes, speech_ratio, speech_db, music_share, accent_n, accent_top, accent_share, conversation, words, hits,
    medical, encounter, lecture, why. What is not asked for by the settings or has no input is null.
    """
    found = inputs.recordings.select(KEY).join(timecodes, KEY, "left")
    found = found.join(I.speech_ratio(inputs.segments, inputs.recordings).withColumnRenamed("ratio", "speech_ratio"), KEY, "left")
    nothing = lambda **kinds: found.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items()})
    if inputs.frames is not None:
        levels = W.levels(inputs.frames, speech, inputs.recordings)
        found = found.join(levels.select(KEY, F.bround("speech_db", 1).alias("speech_db")), KEY, "left")
    else:
        found = nothing(speech_db="double")
    if inputs.music is not None:
        background = W.background_music(inputs.music, speech, inputs.recordings, st) if st.bg_music else base_cuts.limit(0)
        found = found.join(W.music_share(inputs.music, speech, background, base_cuts).withColumnRenamed("share", "music_share"), KEY, "left")
    else:
        found = nothing(music_share="double")
    if inputs.accents is not None and st.accent:
        votes = A.vote(A.evenly_spaced(inputs.accents, "chunk") if sampled else inputs.accents, F.col("grp"))
        found = found.join(votes.select(KEY, F.col("n").alias("accent_n"), F.col("top").alias("accent_top"), F.try_element_at("groups", F.col("top")).alias("accent_share")), KEY, "left")
    else:
        found = nothing(accent_n="long", accent_top="string", accent_share="double")
    if inputs.voice is not None and st.dialogue:
        found = found.join(A.dialogue_structure(inputs.voice, st).select(KEY, "conversation", F.lit(True).alias("dialogue_done")), KEY, "left")
    else:
        found = nothing(conversation="boolean", dialogue_done="boolean")
    if inputs.words is not None and st.topic:
        texts = keep(transcripts(inputs) if sampled else whole_talks(inputs))
        topic = X.topic_score(texts, vocabulary).select(KEY, "words", "hits", "medical", F.lit(True).alias("topic_done"))
        found = found.join(topic, KEY, "left").join(X.encounter_score(texts).select(KEY, "encounter", "lecture"), KEY, "left")
    else:
        found = nothing(words="long", hits="long", medical="boolean", topic_done="boolean", encounter="double", lecture="double")
    return found.withColumn("why", U.suitability(st.dialogue, st=st)).drop("dialogue_done", "topic_done")


#: The settings that each layer of cuts depends on; background music also depends on what counts as speech.
LAYERS = {
    "base": ("max_gap edge_min music_min music_thr min_keep quiet_enabled quiet_abs quiet_rel quiet_win quiet_min blip_max blip_isolation event_db prominent_db other_min short_gap merge_gap").split(),
    "music": "bg_music bg_music_thr bg_window bg_min_run blip_max blip_isolation".split(),
    "words": "words words_phrase phrase_pause clause_pause phrase_max".split(),
}
#: The inputs that each layer reads.
READS = {"base": ("segments", "recordings", "music", "frames"), "music": ("segments", "recordings", "music"), "words": ("words", "recordings")}


@dataclass(frozen=True)
class Kept:
    """What a recomputation starts from: each layer's rows, the marks of what they were made from, and the cut lists.

    ``marks``: rec_id, layer, mark; ``extra``: rec_id, layer, start_s, end_s, reasons; ``lists``: rec_id, timecodes.
    """

    marks: DataFrame
    speech: DataFrame
    events: DataFrame
    base_cuts: DataFrame
    extra: DataFrame
    lists: DataFrame


def _digests(table: DataFrame, name: str) -> DataFrame:
    """rec_id and a number that tells apart what a table holds of a recording, whatever the order of its rows."""
    row = F.xxhash64(*[F.col(c) for c in sorted(table.columns) if c != KEY])
    return table.groupBy(KEY).agg(F.xxhash64(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).alias(name))


def layer_marks(inputs: Inputs, st: Settings = DEFAULTS) -> DataFrame:
    """rec_id, layer, mark: what each layer of each recording is made from, settings and rows."""
    settings = asdict(st)
    found = inputs.recordings.select(KEY)
    have = [name for name in dict.fromkeys(n for names in READS.values() for n in names) if getattr(inputs, name) is not None]
    for name in have:
        found = found.join(_digests(getattr(inputs, name), name), KEY, "left")

    def mark(layer: str) -> Column:
        own = hashlib.sha1(json.dumps({c: settings[c] for c in LAYERS[layer]}, sort_keys=True).encode()).hexdigest()[:16]
        return F.concat_ws(":", F.lit(own), *[F.coalesce(F.col(n).cast("string"), F.lit("-")) if n in have else F.lit("-") for n in READS[layer]])

    return found.select(KEY, F.inline(F.array(*[F.struct(F.lit(layer).alias("layer"), mark(layer).alias("mark")) for layer in LAYERS])))


def _extra(inputs: Inputs, speech: DataFrame, layer: str, st: Settings) -> DataFrame | None:
    own = replace(inputs, words=None) if layer == "music" else replace(inputs, music=None)
    found = layers(own, speech, st)
    return None if found is None else found.select(KEY, F.lit(layer).alias("layer"), "start_s", "end_s", "reasons")


def _together(parts: list[DataFrame | None]) -> DataFrame | None:
    found = None
    for part in parts:
        found = part if found is None else found if part is None else found.unionByName(part)
    return found


def first_analysis(inputs: Inputs, st: Settings = DEFAULTS) -> Kept:
    """A full analysis with all that later recomputations start from."""
    speech, events, base = base_analysis(inputs, st)
    extra = _together([_extra(inputs, speech, layer, st) for layer in ("music", "words")])
    none = base.select(KEY, F.lit("").alias("layer"), "start_s", "end_s", "reasons").limit(0)
    extra = keep(none if extra is None else extra)
    _, _, lists = finish(base, extra.drop("layer"), events, inputs.recordings, st)
    return Kept(keep(layer_marks(inputs, st)), speech, events, base, extra, keep(lists))


def refresh(kept: Kept, inputs: Inputs, st: Settings = DEFAULTS) -> tuple[Kept, DataFrame]:
    """O-02, O-03: the state after changes of settings or inputs, and rec_id, changed (null: new) of its cut lists.

    Layers whose mark is still the same are taken as they are, recording by recording; only the others are computed.
    Recordings that are no longer among the inputs go.
    """
    marks = keep(layer_marks(inputs, st))
    stale = keep(marks.join(kept.marks, [KEY, "layer", "mark"], "left_anti").select(KEY, "layer"))
    of = {layer: stale.filter(F.col("layer") == layer).select(KEY) for layer in LAYERS}
    here = inputs.recordings.select(KEY)

    def still(rows: DataFrame, layer: str) -> DataFrame:
        return rows.join(here, KEY, "left_semi").join(of[layer], KEY, "left_anti")

    rebuilt = base_analysis(inputs.only(segments=of["base"], recordings=of["base"], music=of["base"], frames=of["base"], words=None), st)
    speech, events, base = (keep(still(old, "base").unionByName(new)) for old, new in zip((kept.speech, kept.events, kept.base_cuts), rebuilt, strict=True))
    parts: list[DataFrame | None] = []
    for layer in ("music", "words"):
        own = inputs.only(segments=of[layer], recordings=of[layer], music=of[layer], words=of[layer])
        parts += [still(kept.extra.filter(F.col("layer") == layer), layer), _extra(own, speech.join(of[layer], KEY, "left_semi"), layer, st)]
    extra = keep(_together(parts))
    touched = stale.select(KEY).distinct()
    only = lambda rows: rows.join(touched, KEY, "left_semi")
    _, _, fresh = finish(only(base), only(extra).drop("layer"), only(events), only(inputs.recordings), st)
    same = kept.lists.join(here, KEY, "left_semi").join(touched, KEY, "left_anti")
    lists = keep(same.unionByName(fresh))
    before = kept.lists.withColumnRenamed("timecodes", "before")
    changes = lists.join(before, KEY, "left").select(KEY, "timecodes", (F.col("timecodes") != F.col("before")).alias("changed"))
    return Kept(marks, speech, events, base, extra, lists), changes

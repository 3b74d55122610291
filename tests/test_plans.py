from dataclasses import replace

from pyspark.sql import functions as F

from lectern.operators.intervals import KEY
from lectern.plans import recording as R
from lectern.settings import DEFAULTS
from lectern.sources import adapters as S

SF = "/root/testdata/sf0.001"


def test_recompute_equals_full_analysis(spark):
    segs = S.segments(spark, SF)
    inputs = R.Inputs(segs.select(KEY, "start_s", "end_s"), S.recordings(segs), S.music(spark, SF))
    old = replace(DEFAULTS, bg_music_thr=0.16)
    first, full = R.analyze(inputs, old), R.analyze(inputs, DEFAULTS)
    kept = first.timecodes.select(KEY, "timecodes", F.when(F.col(KEY) % 2 == 0, old.fingerprint()).otherwise(DEFAULTS.fingerprint()).alias("settings"), F.col("timecodes").alias("cut_timecodes"))
    before = {r.rec_id: r.timecodes for r in first.timecodes.collect()}
    target = {r.rec_id: r.timecodes for r in full.timecodes.collect()}
    found = {r.rec_id: r for r in R.recompute(kept, first.base_cuts, inputs, first.speech, first.events, DEFAULTS).collect()}
    assert set(found) == set(before)
    for rec, r in found.items():
        expected = target[rec] if rec % 2 == 0 else before[rec]
        assert r.timecodes == expected and r.changed == (expected != before[rec]) == r.recut
    assert any(before[rec] != target[rec] for rec in before)


def test_refresh_equals_a_first_analysis(spark):
    """Changes of gaps, music, words and of the inputs themselves; recordings that go and that come."""
    segs = S.segments(spark, SF)
    listed = replace(DEFAULTS, words="thing, on the")
    whole = R.Inputs(segs.select(KEY, "start_s", "end_s"), S.recordings(segs), S.music(spark, SF), S.frames(spark, SF), S.words(spark, SF)).by_recording()
    least = whole.recordings.agg(F.min(KEY)).first()[0]
    part = whole.only(recordings=whole.recordings.filter(F.col(KEY) != least), segments=whole.recordings.filter(F.col(KEY) != least))
    lists = lambda kept: {r.rec_id: r.timecodes for r in kept.lists.collect()}
    first = R.first_analysis(part, listed)
    # a recording comes, another loses its words, and the words of a third change
    said = F.when(F.col(KEY) == least + 2, F.lit("thing")).otherwise(F.col("word"))
    changed = replace(whole, words=whole.words.filter(F.col(KEY) != least + 1).withColumn("word", said))
    for inputs, st in ((changed, listed), (changed, replace(listed, max_gap=5.0, words="on the", bg_music_thr=0.2)), (part, replace(listed, bg_music=False, words=""))):
        state, changes = R.refresh(first, inputs, st)
        again = R.first_analysis(inputs, st)
        assert lists(state) == lists(again)
        for name in ("marks", "base_cuts", "extra"):
            rows = [sorted((tuple(map(str, r)) for r in getattr(s, name).select(*sorted(getattr(again, name).columns)).collect())) for s in (state, again)]
            assert rows[0] == rows[1], name
        before = lists(first)
        assert {r.rec_id: r.changed for r in changes.collect()} == {rec: None if rec not in before else now != before[rec] for rec, now in lists(state).items()}
        first = state


def test_only_layers_whose_marks_changed_are_stale(spark):
    segs = S.segments(spark, SF)
    inputs = R.Inputs(segs.select(KEY, "start_s", "end_s"), S.recordings(segs), S.music(spark, SF), None, S.words(spark, SF))
    marks = lambda i, st: {(r.rec_id, r.layer): r.mark for r in R.layer_marks(i, st).collect()}
    old = marks(inputs, DEFAULTS)
    stale = lambda new: {layer for (rec, layer), mark in new.items() if old[rec, layer] != mark}
    assert stale(marks(inputs, replace(DEFAULTS, bg_window=7))) == {"music"}
    assert stale(marks(inputs, replace(DEFAULTS, phrase_max=9.0))) == {"words"}
    assert stale(marks(inputs, replace(DEFAULTS, blip_max=1.0))) == {"base", "music"}
    assert stale(marks(inputs, replace(DEFAULTS, separation=0.5, threads=3))) == set()
    shuffled = replace(inputs, words=inputs.words.orderBy(F.rand(1)), segments=inputs.segments.orderBy(F.desc("start_s")))
    assert stale(marks(shuffled, DEFAULTS)) == set()
    twice = replace(inputs, words=inputs.words.unionByName(inputs.words.filter(F.col(KEY) == 3).limit(2)))
    assert {k for k, mark in marks(twice, DEFAULTS).items() if mark != old[k]} == {(3, "words")}


def test_verdicts_agree_with_their_own_queries(spark):
    from lectern.plans.queries import QUERIES

    found = {r.rec_id: r for r in QUERIES["full_verdicts"](spark, SF).collect()}
    votes = {r.rec_id: (r.n, r.top, r.share) for r in QUERIES["accent_vote"](spark, SF).collect()}
    talks = {r.rec_id: r.conversation for r in QUERIES["dialogue_structure"](spark, SF).collect()}
    for rec, r in found.items():
        assert (r.accent_n, r.accent_top, r.accent_share) == votes.get(rec, (None, None, None)) and r.conversation == talks.get(rec)
        assert (r.why is None) == (rec not in talks)


def test_verdicts_count_all_chunks_and_words(spark):
    """The places that a sample would take say something else."""
    spots = {round(i * 239 / 79) for i in range(80)}
    accents = spark.createDataFrame([(1, k, "x" if k in spots else "y", "x" if k in spots else "y") for k in range(240)], "rec_id long, chunk int, label string, grp string")
    words = spark.createDataFrame([(1, k, k * 0.4, k * 0.4 + 0.3, "heat" if k % 3 == 0 else "of") for k in range(2000)], "rec_id long, word_no int, start_s double, end_s double, word string")
    segs = spark.createDataFrame([(1, 0.0, 800.0)], "rec_id long, start_s double, end_s double")
    recs = spark.createDataFrame([(1, 900.0)], "rec_id long, duration_s double")
    inputs = R.Inputs(segs, recs, None, None, words, accents)
    lists = recs.select(KEY, F.lit("good").alias("timecodes"))
    found = R.results(inputs, lists, segs, segs, ("heat",)).first()
    assert (found.accent_n, found.accent_top, found.accent_share) == (240, "y", 0.67) and (found.words, found.hits) == (2000, 667)

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import timeseries as W
from lectern.operators import voting as A


def tables(spark, probs, speech=((5.0, 115.0),), duration=120.0):
    music = spark.createDataFrame([(1, i, float(p)) for i, p in enumerate(probs)], "rec_id long, sec int, prob double")
    segs = spark.createDataFrame([(1, a, b) for a, b in speech], "rec_id long, start_s double, end_s double")
    recs = spark.createDataFrame([(1, duration)], "rec_id long, duration_s double")
    return music, segs, recs


def test_background_music(spark):
    probs = [0.13 if 30 <= t < 80 else 0.0 for t in range(120)]
    music, segs, recs = tables(spark, probs)
    found = W.background_music(music, segs, recs)
    assert [(r.start_s, r.end_s) for r in found.collect()] == [(30.0, 80.0)]
    none = segs.limit(0).withColumn("reasons", F.array().cast("array<string>"))
    assert W.music_share(music, segs, found, none).first().share == round(50 / 110, 3)


def test_spikes_and_jingle_are_not_music(spark):
    spikes = [0.4 if t % 20 == 0 else 0.0 for t in range(120)]
    jingle = [0.3 if 10 <= t < 13 else 0.0 for t in range(120)]
    for probs in (spikes, jingle):
        assert W.background_music(*tables(spark, probs)).count() == 0


def test_music_under_speech_needs_agreement(spark):
    clear = [0.6 if 40 <= t < 60 else 0.0 for t in range(120)]
    music, segs, recs = tables(spark, clear)
    events = segs.limit(0).withColumn("kind", F.lit("x"))
    assert [(r.start_s, r.end_s) for r in W.music_under_speech(music, segs, events, recs).collect()] == [(40.0, 60.0)]


def test_quiet_speech(spark):
    frames, segs = [], []
    for k in range(60):  # ten seconds of speech, the middle third low
        a = k * 10.0
        low = 20 <= k < 40
        segs.append((1, a, a + 9.0))
        frames += [(1, a + j * 0.03, -50.0 if low else -20.0, 1.0) for j in range(300)]
    f = spark.createDataFrame(frames, "rec_id long, t_s double, db double, power double")
    s = spark.createDataFrame(segs, "rec_id long, start_s double, end_s double")
    recs = spark.createDataFrame([(1, 600.0)], "rec_id long, duration_s double")
    assert [(r.start_s, r.end_s) for r in W.quiet_speech(f, s, recs).collect()] == [(200.0, 399.0)]


def test_quiet_speech_tells_the_median_level_of_the_run_and_the_reference(spark):
    frames, segs = [], []
    for k in range(30):  # the last third lower and lower
        level = -20.0 if k < 20 else -40.0 - k
        segs.append((1, k * 10.0, k * 10.0 + 9.0))
        frames += [(1, k * 10.0 + j * 0.3, level, 1.0) for j in range(30)]
    f = spark.createDataFrame(frames, "rec_id long, t_s double, db double, power double")
    s = spark.createDataFrame(segs, "rec_id long, start_s double, end_s double")
    recs = spark.createDataFrame([(1, 300.0)], "rec_id long, duration_s double")
    slots = {r.slot: r.level for r in W.quiet_levels(f, s, recs, frame_s=0.3).collect()}
    ref = float(np.percentile(list(slots.values()), 80))
    quiet = [v for v in slots.values() if v < -31 and v - ref < -7]
    found = W.quiet_speech(f, s, recs, frame_s=0.3).collect()
    assert len(set(quiet)) > 2 and [(r.start_s, r.end_s, r.level, r.ref) for r in found] == [(200.0, 299.0, float(np.median(quiet)), ref)]


def test_ward_finds_two_clouds():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(0, 0.1, (30, 4)), rng.normal(3, 0.1, (20, 4))])
    labels = W.ward_two(points)
    assert set(labels[:30]) == {1} and set(labels[30:]) == {2}


def test_ward_from_means_equals_ward_from_all_distances(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (2, 3, 40, 150):
        points = rng.normal(0, 1, (n, 5))
        by_distances = W.ward_two(points)
        monkeypatch.setattr(W, "MATRIX_ROWS", 1)
        assert W.ward_two(points).tolist() == by_distances.tolist()
        monkeypatch.undo()


def test_all_pieces_of_a_recording_are_clustered(spark):
    """Every second piece alone would be one voice."""
    rows = [(1, i, i * 1.5, i * 1.5 + 1.5, [1.0, 0.001 * (i % 7)] if i % 2 else [0.001 * (i % 5), 1.0]) for i in range(1510)]
    r = A.dialogue_structure(spark.createDataFrame(rows, "rec_id long, piece int, start_s double, end_s double, vec array<double>")).first()
    assert r.pieces == 1510 and r.minor_share == 0.5


def test_dialogue(spark):
    rng = np.random.default_rng(2)
    voices = np.eye(8)[[0, 1]]
    vec = lambda v: (voices[v] + rng.normal(0, 0.05, 8)).tolist()
    rows = [(1, i, i * 1.5, i * 1.5 + 1.5, vec(i // 5 % 2)) for i in range(60)] + [(2, i, i * 1.5, i * 1.5 + 1.5, vec(0)) for i in range(10)]
    found = {r.rec_id: r for r in A.dialogue_structure(spark.createDataFrame(rows, "rec_id long, piece int, start_s double, end_s double, vec array<double>")).collect()}
    assert found[1].conversation is True and found[1].reason == ""
    assert found[2].conversation is None and found[2].pieces == 10


def test_polarity(spark):
    rows = [(1, b, 1.0, 9.0 if b in (2, 3) else 1.0, 100) for b in range(6)]
    blocks = spark.createDataFrame(rows, "rec_id long, block int, mid double, side double, n int")
    assert [(r.start_s, r.end_s) for r in W.polarity(blocks).collect()] == [(1.0, 2.0)]


def test_quiet_walk_equals_plain_steps(spark):
    """Random low and loud segments: what is grown and drawn back equals taking one segment after the other."""
    import random
    from dataclasses import replace

    from lectern.settings import DEFAULTS

    st = replace(DEFAULTS, quiet_win=20.0, quiet_min=0.0, quiet_rel=-7.0, quiet_abs=-25.0)
    random.seed(11)
    frames, segs, expected_inputs = [], [], {}
    for rec in range(12):
        levels = [random.choice((-20.0, -20.0, -27.0, -45.0)) for _ in range(40)]
        for k, level in enumerate(levels):
            segs.append((rec, k * 5.0, k * 5.0 + 4.5))
            frames += [(rec, k * 5.0 + j * 0.3, level, 1.0) for j in range(15)]
        expected_inputs[rec] = levels
    f = spark.createDataFrame(frames, "rec_id long, t_s double, db double, power double")
    s = spark.createDataFrame(segs, "rec_id long, start_s double, end_s double")
    recs = spark.createDataFrame([(r, 200.0) for r in range(12)], "rec_id long, duration_s double")
    slots = {}
    for r in W.quiet_levels(f, s, recs, frame_s=0.3, st=st).collect():
        slots.setdefault(r.rec_id, {})[r.slot] = r.level
    found = sorted((r.rec_id, r.start_s, r.end_s) for r in W.quiet_speech(f, s, recs, frame_s=0.3, st=st).collect())
    expected = []
    for rec, levels in expected_inputs.items():
        known = sorted(slots[rec].values())
        at = 0.8 * (len(known) - 1)
        ref = known[int(at)] + (known[min(int(at) + 1, len(known) - 1)] - known[int(at)]) * (at - int(at))
        quiet = sorted(k for k, v in slots[rec].items() if v < -25 and v - ref < -7)
        low = [v < min(-25, ref - 7) + 3 for v in levels]
        runs = [k for k in quiet if k - 1 not in quiet]
        for a in runs:
            b = next(k for k in range(a, 99) if k + 1 not in quiet)
            inside = [i for i in range(40) if i * 5.0 + 4.5 > a * 5.0 and i * 5.0 < min((b + 1) * 5.0, 200.0)]
            chosen = set(inside)
            for step, edge in ((-1, min), (1, max)):
                while 0 <= edge(chosen) + step < 40 and low[edge(chosen) + step]:
                    chosen.add(edge(chosen) + step)
            for edge in (min, max):
                while len(chosen) > 1 and not low[edge(chosen)]:
                    chosen.remove(edge(chosen))
            expected.append((rec, min(chosen) * 5.0, max(chosen) * 5.0 + 4.5))
    assert found == sorted(expected) and len(expected) > 3


def test_shares_round_as_in_sql(spark):
    """46 of 80 is 0.575, which as a double lies below the half; 203 of 400 likewise."""
    chunks = spark.range(80).select(F.lit(1).alias("rec_id"), F.col("id").alias("chunk"), F.when(F.col("id") < 46, "en").otherwise("de").alias("label"))
    assert A.vote(chunks, F.col("label")).first().groups == {"en": 0.57, "de": 0.42}
    music = spark.range(400).select(F.lit(1).alias("rec_id"), F.col("id").cast("int").alias("sec"), F.lit(0.0).alias("prob"))
    ranges = lambda end: spark.createDataFrame([(1, 0.0, float(end), ["x"])], "rec_id int, start_s double, end_s double, reasons array<string>")
    assert W.music_share(music, ranges(400).drop("reasons"), ranges(203), ranges(1).limit(0)).first().share == 0.507

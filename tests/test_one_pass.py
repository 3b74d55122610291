"""The shared steps read each table once and agree with plain versions."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import timeseries as W
from lectern.operators import words as V
from lectern.plans import recording as R
from lectern.settings import DEFAULTS, Settings


def made(spark, seed=4):
    random.seed(seed)
    segs, frames, music = [], [], []
    for rec in range(6):
        at = random.choice([0.0, 0.4, 6.0])
        while rec != 5 and at < 100:  # the last recording has no speech
            end = at + random.choice([0.2, 2.0, 9.3])
            segs.append((rec, round(at, 2), round(end, 2)))
            at = end + random.choice([0.31, 0.7, 1.2, 8.0]) if rec != 4 else 200.0
        if rec != 3:  # one has no frames; some lie beyond the end
            frames += [(rec, k * 0.6, random.choice([-60.0, -45.0, -20.0, -3.0]), random.random()) for k in range(220)]
        if rec != 2:
            music += [(rec, s, random.random() / 2) for s in range(random.choice([40, 130]))]
    t = {
        "segments": (segs, "rec_id long, start_s double, end_s double"),
        "recordings": ([(rec, 120.0) for rec in range(6)], "rec_id long, duration_s double"),
        "music": (music, "rec_id long, sec int, prob double"),
        "frames": (frames, "rec_id long, t_s double, db double, power double"),
    }
    return {name: spark.createDataFrame(*rows) for name, rows in t.items()}, {name: rows[0] for name, rows in t.items()}


def plain_kinds(rows, st=DEFAULTS):
    out, level = {}, lambda x: 20 * math.log10(math.sqrt(np.mean(x)) + 1e-9)
    for rec, duration in rows["recordings"]:
        segs = sorted(s[1:] for s in rows["segments"] if s[0] == rec)
        heard = lambda a, b: [f for f in rows["frames"] if f[0] == rec and a <= f[1] < b]  # noqa: E731, B023
        spoken = [level([f[3] for f in heard(*s)]) for s in segs if heard(*s)]
        between = [(a[1], b[0]) for a, b in zip(segs, segs[1:], strict=False)]
        quiet = [np.median([f[2] for f in heard(*g)]) for g in between if g[1] - g[0] >= 0.3 and heard(*g)]
        everything = [f[2] for f in rows["frames"] if f[0] == rec]
        speech_db = np.median(spoken) if spoken else -30.0
        back = np.median(quiet) if quiet else np.percentile(everything, 10) if everything else None
        ends = [0.0] + [x for s in segs for x in s] + [duration]
        for a, b in zip(ends[::2], ends[1::2], strict=True):
            if b - a < 0.5:
                continue
            here, secs = heard(a, b), range(math.floor(a), max(math.ceil(b), math.floor(a) + 1))
            known = [m[2] >= st.music_thr for m in rows["music"] if m[0] == rec and m[1] in secs]
            peak, rms = (np.percentile([f[2] for f in here], 95), level([f[3] for f in here])) if here else (-120.0, -120.0)
            kind = "музыка" if known and np.mean(known) >= 0.5 else "тишина" if peak < -50 or back is not None and peak < back + st.event_db else "тихие звуки" if rms < speech_db - st.prominent_db else "шум/другое"
            out[rec, a, b] = kind
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_gaps_and_their_kinds(spark, seed):
    t, rows = made(spark, seed)
    found = W.hear_gaps(t["frames"], t["music"], t["segments"], t["recordings"]).collect()
    assert {(r.rec_id, r.start_s, r.end_s): r.kind for r in found} == plain_kinds(rows)


def test_segments_of_no_length_take_no_frames_from_the_gap_behind_them(spark):
    segs = [(1, 0.0, 0.0), (1, 6.0, 10.0), (1, 20.0, 20.0), (1, 30.0, 40.0)]
    frames = [(1, k * 0.5, -20.0 if 10 <= k * 0.5 < 20 else -60.0, 0.001 * (k % 7 + 1)) for k in range(100)]
    music = [(1, s, 0.5 if s < 6 else 0.0) for s in range(50)]
    rows = {"segments": segs, "recordings": [(1, 50.0)], "frames": frames, "music": music}
    t = {name: spark.createDataFrame(rows[name], made(spark)[0][name].schema) for name in rows}
    found = W.hear_gaps(t["frames"], t["music"], t["segments"], t["recordings"]).collect()
    assert {(r.rec_id, r.start_s, r.end_s): r.kind for r in found} == plain_kinds(rows)
    assert {(r.start_s, r.end_s) for r in found} == {(0.0, 6.0), (10.0, 20.0), (20.0, 30.0), (40.0, 50.0)}
    assert W.levels(t["frames"], t["segments"], t["recordings"]).first().background_db == -60.0


def test_seconds_that_ranges_touch(spark):
    t, rows = made(spark)
    touched = {(rec, s) for rec, a, b in rows["segments"] for s in range(math.floor(a), math.ceil(b))}
    assert {(r.rec_id, r.sec): r.speech for r in W.with_speech(t["music"], t["segments"]).collect()} == {(rec, s): (rec, s) in touched for rec, s, _ in rows["music"]}


def test_frames_are_read_once(spark):
    t, rows = made(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frames = t["frames"].mapInArrow(counted, t["frames"].schema)
    R.base_analysis(R.Inputs(t["segments"], t["recordings"], t["music"], frames), Settings(quiet_enabled=False))
    assert read.value == len(rows["frames"])


def test_quiet_slots_against_each_window(spark):
    t, rows = made(spark)
    st, expected = Settings(quiet_win=20.0), {}
    for rec, duration in rows["recordings"]:
        spoken = [f for f in rows["frames"] if f[0] == rec and any(s[0] == rec and s[1] <= f[1] < s[2] for s in rows["segments"])]
        for slot in range(math.ceil(duration / 5)):
            heard = [f[2] for f in spoken if math.floor((f[1] - 10) / 5) + 1 <= slot <= math.floor((f[1] + 10) / 5)]
            if len(heard) * 0.6 >= 5:
                expected[rec, slot] = float(np.percentile(heard, 90))
    found = {(r.rec_id, r.slot): r.level for r in W.quiet_levels(t["frames"], t["segments"], t["recordings"], 0.6, st=st).collect()}
    assert found == pytest.approx(expected) and len(found) > 20


def test_quiet_speech_does_not_write_a_frame_per_slot(spark):
    """No explode of frames to the slots that hear them: the plan's only one makes the slots of recordings."""
    t, _ = made(spark)
    frames = t["frames"].withColumn("db", F.col("db"))
    plan = W.quiet_levels(frames, t["segments"], t["recordings"], 0.6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Generate explode(sequence(0" in plan


def test_ends_of_sentences_are_sought_once_per_talk(spark, monkeypatch):
    times = []
    monkeypatch.setattr(V, "_stopped", lambda words, marks, f=V._stopped: times.append(marks) or f(words, marks))
    talk = spark.createDataFrame([(1, ["thing"] * 300, [0.4 * k for k in range(300)], [0.4 * k + 0.3 for k in range(300)], 130.0)], "rec_id long, words array<string>, starts array<double>, ends array<double>, duration_s double")
    held = {}
    monkeypatch.setattr(V, "_searched", lambda talks, out, found_in: held.setdefault("f", found_in))
    V.talk_cuts(talk, ["thing"])
    starts, ends = (pa.scalar([0.4 * k + d for k in range(300)]) for d in (0.0, 0.3))
    assert held["f"](V.SEPARATOR.join(["thing"] * 300), starts, ends, 130.0) and len(times) == 2

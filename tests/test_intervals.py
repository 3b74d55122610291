import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import intervals as I
from lectern.settings import LEFTOVER

RANGE = "rec_id long, start_s double, end_s double"


def frame(spark, rows, schema=RANGE):
    return spark.createDataFrame(rows, schema)


def ranges(df):
    return sorted((r.rec_id, r.start_s, r.end_s) for r in df.collect())


def test_complement(spark):
    recs = frame(spark, [(1, 405.7), (2, 10.0)], "rec_id long, duration_s double")
    cuts = frame(spark, [(1, 0.0, 13.0), (1, 190.0, 197.0), (1, 395.0, 405.7)])
    assert ranges(I.keep_ranges(cuts, recs)) == [(1, 13.0, 190.0), (1, 197.0, 395.0), (2, 0.0, 10.0)]


def test_layer_merge(spark):
    recs = frame(spark, [(1, 100.0)], "rec_id long, duration_s double")
    base = [(1, 0.0, 5.0, ["a"]), (1, 60.0, 70.0, ["a"]), (1, 9.0, 12.0, ["w"]), (1, 30.0, 33.0, ["w"])]
    found = sorted((r.start_s, r.end_s, r.reasons) for r in I.merge_cuts(frame(spark, base, RANGE + ", reasons array<string>"), recs).collect())
    assert found == [(0.0, 12.0, sorted(["a", "w", LEFTOVER])), (30.0, 33.0, ["w"]), (60.0, 70.0, ["a"])]


def test_no_segments_is_one_gap(spark):
    recs = frame(spark, [(1, 30.0)], "rec_id long, duration_s double")
    found = I.gaps(frame(spark, []), recs).collect()
    assert [(r.start_s, r.end_s, r.place) for r in found] == [(0.0, 30.0, "all")]


def test_pack_for_transcription(spark):
    segs = [(1, 0.0, 10.0), (1, 11.0, 20.0), (1, 30.0, 95.0), (1, 95.5, 100.0), (1, 110.0, 110.2), (1, 120.0, 121.0)]
    found = ranges(I.pack_for_transcription(frame(spark, segs)).select(I.KEY, "start_s", "end_s"))
    assert found == [(1, 0.0, 20.0), (1, 30.0, 58.0), (1, 58.0, 86.0), (1, 86.0, 100.0), (1, 120.0, 121.0)]


def plain_merge(cuts, merge_gap=1.0, min_keep=8.0):
    out = []
    for a, b in sorted(cuts):
        if out and (a - out[-1][1] <= merge_gap or a - out[-1][1] < min_keep):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_islands_equal_a_fold(spark):
    random.seed(3)
    rows = []
    for rec in range(40):
        rows += [(rec, a, a + random.uniform(0, 9)) for a in (random.uniform(0, 300) for _ in range(random.randint(1, 30)))]
    found = ranges(I.merge_cuts(frame(spark, rows).withColumn("reasons", F.array(F.lit("x")))))
    expected = sorted((rec, a, b) for rec in range(40) for a, b in plain_merge([(x, y) for r, x, y in rows if r == rec]))
    assert found == expected


def test_snaps(spark):
    recs = frame(spark, [(1, 50.0), (2, 50.0)], "rec_id long, duration_s double")
    keep = frame(spark, [(1, 1.0, 4.0), (1, 5.0, 49.0), (2, 3.0, 4.0)])
    packets = frame(spark, [(1, x * 2.0) for x in range(20)], "rec_id long, pts double")
    assert ranges(I.snap_to_packets(keep, packets, recs)) == [(1, 2.0, 4.0), (1, 6.0, 50.0), (2, 3.0, 4.0)]
    assert ranges(I.widen_to_keyframes(keep, packets, recs)) == [(1, 0.0, 50.0), (2, 3.0, 4.0)]


def test_trim_plan(spark):
    keep = frame(spark, [(1, 0.5, 1.0)])
    assert [tuple(r) for r in I.trim_plan(keep, frame(spark, [(1, 44100)], "rec_id long, sample_rate int")).collect()] == [(1, 22050, 44100)]
    with pytest.raises(Exception, match="unknown sample rate"):
        I.trim_plan(keep, frame(spark, [(1, 0)], "rec_id long, sample_rate int")).collect()

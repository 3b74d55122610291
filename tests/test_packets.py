import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import verification as Y
from lectern.operators.numbering import numbered


def walk(source, result):
    """Packet by packet."""
    at = matched = jumps = 0
    for h in result:
        place = next((p for p in range(at, len(source)) if source[p] == h), None)
        if place is not None:
            jumps += place != at
            at, matched = place + 1, matched + 1
    return at, matched, jumps


def test_chunk_maps_tell_the_walk_from_every_place():
    random.seed(7)
    for _ in range(400):
        letters = random.choice(["a", "ab", "abcd", "abcdefghijklmnop"])
        source = random.choices(letters, k=random.randrange(25))
        result = random.choices(letters + "z", k=random.randrange(12))
        places = {h: [p for p, s in enumerate(source) if s == h] for h in set(result)}
        rows = Y.chunk_map(result, places)
        assert [r[0] for r in rows] == sorted(r[0] for r in rows)
        for begin in range(len(source) + 1):
            row = next((r for r in rows if r[0] >= begin), None)
            _, first, end, matched, jumps = row or (0, begin, begin, 0, 0)
            moved, n, more = walk([None] * begin + source[begin:], [])[0], 0, 0
            moved = begin
            for h in result:
                place = next((p for p in range(moved, len(source)) if source[p] == h), None)
                if place is not None:
                    more += place != moved
                    moved, n = place + 1, n + 1
            assert (end, matched, jumps + (first != begin)) == (moved, n, more)


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_match_packets_equals_the_walk(spark, chunk):
    random.seed(8)
    files = {f"f{k}": ([random.choice("abcdef") for _ in range(random.randrange(60))], [random.choice("abcdefz") for _ in range(random.randrange(40))]) for k in range(25)}
    files["same"] = (["a"] * 50, ["a"] * 30)
    files["none"] = ([], ["a"])
    files["source only"] = (["a"], [])
    side = lambda k: spark.createDataFrame([(f, i, h, "x") for f, both in files.items() for i, h in enumerate(both[k])] + [(None, 0, "a", "x")], "file string, seq int, hash string, no string")
    found = {r.file: (r.packets, r.identical, r.pieces) for r in Y.match_packets(side(0), side(1), chunk).collect()}
    plain = {}
    for f, (source, result) in files.items():
        if source or result:
            _, matched, jumps = walk(source, result)
            plain[f] = (len(result), matched, jumps + 1)
    assert found == plain


def test_one_file_is_walked_in_many_tasks(spark):
    source = spark.range(20_000).select(F.lit("f").alias("file"), F.col("id").alias("seq"), F.col("id").cast("string").alias("hash"))
    maps = Y.match_packets(source, source.filter("seq % 7 <> 0"), chunk=1000)
    assert maps.first()[1:] == (17142, 17142, 2858)
    numbers = numbered(source, ["seq"], ["file"])
    assert numbers.select(F.spark_partition_id()).distinct().count() > 2
    assert numbers.filter("no <> seq + 1").isEmpty()


def test_numbers_of_rows(spark):
    random.seed(9)
    rows = [(random.choice(["a", "b", None]), random.choice([None, *range(20)]), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, o int, i int")
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    plain = {r[2]: n for n, r in enumerate(sorted(rows, key=key), 1)}
    assert {r.i: r.no for r in numbered(frame, ["o", "i"]).collect()} == plain
    within = {r[2]: n for k in ("a", "b", None) for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=key), 1)}
    assert {r.i: r.no for r in numbered(frame, ["o", "i"], ["k"]).collect()} == within
    assert numbered(frame.limit(0), ["o"]).count() == 0


def test_known_beginnings_leave_few_rows():
    random.seed(10)
    for _ in range(200):
        source, result = random.choices("abcdefgh", k=30), random.choices("abcdefghz", k=12)
        places = {h: [p for p, s in enumerate(source) if s == h] for h in set(result)}
        low = random.randrange(31)
        high = random.randrange(low, 31)
        whole, some = Y.chunk_map(result, places), Y.chunk_map(result, places, low, high)
        of = lambda rows, begin: next((r for r in rows if r[0] >= begin), None)
        assert len(some) <= high - low + 1
        assert all(of(whole, begin) == of(some, begin) for begin in range(low, high + 1))


def test_frequent_hashes_do_not_come_to_every_chunk(spark):
    """A source of 20 hashes and chunks of 50 packets: sent to each chunk, its places are 400 times the file."""
    source = spark.range(20_000).select(F.lit("f").alias("file"), F.col("id").alias("seq"), (F.col("id") * 7 % 20).cast("string").alias("hash"))
    result = source.filter("seq % 9 <> 0").withColumn("seq", F.col("seq") + F.when(F.col("seq") % 11 == 0, 25).otherwise(0))
    side = lambda df: [r.hash for r in df.orderBy("seq", "hash").collect()]
    _, matched, jumps = walk(side(source), side(result))
    assert Y.match_packets(source, result, chunk=50).first()[1:] == (17777, matched, jumps + 1)


def test_a_chunk_holds_few_bytes_per_place():
    """Places and hashes are numbers of eight bytes, not objects; the walk's result is that of the lists."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(5), 100_000
    hashes = rng.integers(-(2**62), 2**62, 50)[rng.integers(0, 50, n)]
    result = hashes[rng.random(n) < 0.8]
    same = lambda v, k: pa.array(np.full(k, v))
    left = pa.table({"r_file": pa.array(["7"] * len(result)), "r_chunk": same(0, len(result)), "r_h": result, "r_no": np.arange(1, len(result) + 1), "r_first": same(-1, len(result))})
    right = pa.table({"s_file": pa.array(["7"] * (n + 1)), "s_chunk": same(0, n + 1), "s_h": np.append(hashes, 0), "s_place": np.append(np.arange(n), -1)})
    tracemalloc.start()
    found = Y._chunk_maps((pa.scalar("7"), pa.scalar(0)), left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lists = {int(h): np.flatnonzero(hashes == h).tolist() for h in np.unique(hashes)}
    rows = Y.chunk_map(result.tolist(), lists, 0, 0)
    assert [tuple(r.values())[2:] for r in found.to_pylist()] == rows and peak < 64 * n

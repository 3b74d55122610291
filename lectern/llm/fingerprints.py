"""I-Match fingerprints with randomised lexicon subsets.

The lexicon keeps the terms whose inverse document frequency lies in a band: those that stand in a share of
all texts between ``LOW`` and ``HIGH``. Document frequencies are counted over the whole corpus in ``BUCKETS``
hash buckets, so the lexicon is a bitmap of 32 kB whatever the corpus. (Terms that share a bucket share its
frequency; the rarest words together add about 1e-4 of the texts to a bucket, which is under ``LOW``.)

Random subsets of the lexicon come in levels: level ``l`` has ``SLOTS`` disjoint subsets that together hold a
share ``4**-l`` of the terms. For each subset the distinct terms of a text in it are hashed together; the hash
is the exclusive or of the terms' hashes, the same for a sorted list of distinct terms in any order, which
lets a plain aggregate build it. The fingerprint lists the subsets that a text meets with their hashes. Two
texts are as alike as the share of subsets with equal hashes at the sparsest level at which the two meet at
least ``ENOUGH`` subsets and the levels beyond; so a short text is compared by dense subsets and a long one by
sparse ones, and in either case a subset holds few of the text's terms.

A text with fewer than ``FEW`` terms in the band uses all its terms. The next text is found in ranges of doc_id, not in one
sorted whole: each range also gets the first row of the range after it.

Everything is DataFrame functions. Defined results: a null text is an empty one; a text without a term has an
empty fingerprint, and two empty fingerprints are alike (1.0); repeated doc_ids follow each other in the order
of their texts; a null doc_id comes last; a table of one row has itself as next; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 1 << 18
LOW, HIGH = 5e-4, 0.1
LEVELS, SLOTS = 5, 32
#: A level decides on likeness if two texts together meet so many of its subsets.
ENOUGH = 8
#: A text with fewer terms in the band uses all its terms.
FEW = 8
#: Texts come in ranges of doc_id of about so many bytes, as long as these are not more than MAX_RANGES.
RANGE_BYTES = 8 << 20
MAX_RANGES = 1 << 16
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), SEPARATOR)), "")


def _bucket(term: Column) -> Column:
    return F.xxhash64(term).bitwiseAND(F.lit(BUCKETS - 1))


def lexicon(docs: DataFrame) -> list[int]:
    """The bitmap of buckets inside the band as BUCKETS/64 longs."""
    total = docs.count()
    words = (
        docs.select(F.explode(terms_of(F.coalesce("text", F.lit("")))).alias("term"))
        .select(_bucket(F.col("term")).alias("b"))
        .groupBy("b")
        .agg(F.count("*").alias("df"))
        .filter((F.col("df") >= LOW * total) & (F.col("df") <= max(HIGH * total, 1)))
        .groupBy(F.shiftright("b", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
        .collect()
    )
    bitmap = [0] * (BUCKETS // 64)
    for r in words:
        bitmap[r["w"]] = r["bits"]
    return bitmap


def _in_band(bitmap: list[int]):
    bits = F.expr(f"cast(split('{','.join(map(str, bitmap))}', ',') as array<bigint>)")

    def test(term: Column) -> Column:
        b = _bucket(term)
        return F.getbit(F.get(bits, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def _ranges(docs: DataFrame, n: int) -> Column:
    """The number of the doc_id range of a row, from about equal parts; null ids fall into the lowest."""
    if n < 2:
        return F.lit(0)
    shares = [i / n for i in range(1, n)]
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, min(1_000_000, 100 * n)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.expr(f"cast(split('{','.join(map(str, bounds[step - 1 :: step]))}', ',') as array<bigint>)") if bounds else F.array().cast("array<bigint>")
    fine = F.expr(f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)") if bounds else F.array().cast("array<bigint>")
    doc_id = F.col("doc_id").cast("long")
    skipped = F.size(F.filter(coarse, lambda x: x <= doc_id)) * step
    return (skipped + F.size(F.filter(F.slice(fine, skipped + 1, F.lit(step)), lambda x: x <= doc_id))).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """part, place, doc_id, text, next of every row; the rows of a part lie in one partition, ordered by place.

    ``is_guest`` marks copies of rows that stand at the end of another part, to be dropped later.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long") + 64).alias("bytes")).first()["bytes"] or 0
    n_ranges = max(1, min(MAX_RANGES, size // RANGE_BYTES))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", _ranges(docs, n_ranges))
    # one row per range: its greatest doc_id, where the order by descending doc_id enters it
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("head"), F.count("doc_id").alias("known")).orderBy(F.desc("part")).collect()
    guests = [(after["head"], before["part"]) for before, after in zip(heads, heads[1:] + heads[:1], strict=True) if after["known"]]
    lodged = spark.createDataFrame(guests, "doc_id long, guest_of int")
    own = rows.withColumn("is_guest", F.lit(False))
    joined = own.join(F.broadcast(lodged), "doc_id", "left")
    stays = F.array(F.struct(F.col("part"), F.lit(False).alias("is_guest")), F.struct(F.col("guest_of").alias("part"), F.lit(True).alias("is_guest")))
    rows = joined.select("doc_id", "text", F.explode(F.filter(stays, lambda s: s["part"].isNotNull())).alias("s")).select("doc_id", "text", "s.part", "s.is_guest")
    # the number of tasks goes by the data; the window and what follows keep this partitioning
    rows = rows.repartition(n_ranges, "part")
    order = Window.partitionBy("part").orderBy("is_guest", F.desc("doc_id"), "text")
    return rows.withColumns({"place": F.row_number().over(order), "next": F.coalesce(F.lead("text").over(order), F.col("text"))})


def _fingerprint_rows(frame: DataFrame, keys: list[str], text: str, bitmap: list[int]) -> DataFrame:
    """keys, marks: an array of (slot, hash) of each text, sorted by slot; no exchange if keys hold the partitioning."""
    in_band = _in_band(bitmap)
    frame = frame.select(*keys, terms_of(F.col(text)).alias("terms"))
    frame = frame.withColumn("banded", F.size(F.filter("terms", in_band)) >= FEW)
    frame = frame.select(*keys, "banded", F.explode_outer("terms").alias("term"))
    frame = frame.filter(F.col("term").isNull() | ~F.col("banded") | in_band(F.col("term")))
    h = F.xxhash64("term")
    chosen = F.shiftrightunsigned(h, 20)
    levels = sum(((chosen.bitwiseAND(F.lit(4**level - 1)) == 0).cast("int") for level in range(1, LEVELS)), F.lit(1))
    frame = frame.select(*keys, "term", F.explode(F.sequence(F.lit(0), levels - 1)).alias("level"))
    slot = F.col("level") * SLOTS + F.shiftrightunsigned(F.xxhash64("term", "level"), 44).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    frame = frame.select(*keys, slot.alias("slot"), F.when(F.col("term").isNotNull(), F.xxhash64(F.lit(11), "term")).alias("h"))
    frame = frame.groupBy(*keys, "slot").agg(F.bit_xor("h").alias("h"))
    marks = F.collect_list(F.when(F.col("h").isNotNull(), F.struct("slot", F.shiftrightunsigned("h", 32).cast("long").alias("h"))))
    return frame.groupBy(*keys).agg(F.sort_array(marks).alias("marks"))


def likeness(a: str, b: str) -> Column:
    """The share of equal subset hashes at the sparsest level that the two texts meet well; 0 to 1."""
    result = F.lit(None).cast("double")

    def of_level(marks: str, level: int) -> Column:
        return F.filter(marks, lambda m: (m["slot"] >= level * SLOTS) & (m["slot"] < (level + 1) * SLOTS))

    either, equal = [], []
    for level in range(LEVELS):
        inside = [of_level(a, level), of_level(b, level)]
        either.append(F.size(F.array_union(*[F.transform(x, lambda m: m["slot"]) for x in inside])))
        equal.append(F.size(F.array_intersect(*inside)))
    for level in range(LEVELS):
        share = sum(equal[level + 1 :], equal[level]) / sum(either[level + 1 :], either[level])
        result = F.when(either[level] >= (ENOUGH if level else 1), share).otherwise(result)
    return F.coalesce(result, F.lit(1.0))


def _text_of(marks: str) -> Column:
    return F.array_join(F.transform(marks, lambda m: F.concat(F.lpad(F.hex(m["slot"].cast("long")), 2, "0"), F.lpad(F.hex(m["h"]), 8, "0"))), "-")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    docs = docs.select("doc_id", "text")
    bitmap = lexicon(docs)
    rows = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut))
    rows = rows.select("part", "place", "is_guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.select("part", "place", "is_guest", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited")
    both = rows.select(
        "part", "place", "is_guest", "doc_id", "n_chars", "edited_sha256",
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("t"),
    ).select("part", "place", "is_guest", "doc_id", "n_chars", "edited_sha256", "t.which", "t.body")
    keys = ["part", "place", "is_guest", "doc_id", "n_chars", "edited_sha256"]
    marks = _fingerprint_rows(both, [*keys, "which"], "body", bitmap)
    each = marks.groupBy(*keys).agg(
        F.max(F.when(F.col("which") == 0, F.col("marks"))).alias("own"),
        F.max(F.when(F.col("which") == 1, F.col("marks"))).alias("changed"),
    )
    order = Window.partitionBy("part").orderBy("place")
    each = each.withColumn("following", F.coalesce(F.lead("own").over(order), F.col("own")))
    return each.filter(~F.col("is_guest")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _text_of("own").alias("fingerprint"),
        _text_of("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "following").alias("near_next"),
    )

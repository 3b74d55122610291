"""Source divergence audit: how far the sources of each language lie apart, and by which terms.

Every (language, source) group and every language is a vector of term shares. Work goes in three steps.

1. Terms are counted inside the tasks, so that a source with a third of all rows reaches the shuffle as partial
   counts; one shuffle by (language, term) sums them and keeps the terms of ``MIN_DOCS`` documents or more.
2. The vocabulary of a language is cut into segments by a hash of the term, as many as keep all its groups' counts
   of a segment under about ``CELLS`` numbers. Of each group and segment the counts become one compressed vector.
3. Systolic rotation: groups take one of ``SEATS`` seats and stay in the partition of their seat and segment. In each
   round of a round-robin tournament every seat meets one other: the compressed vectors of one of the two travel to
   the other's partition, and each meeting of two groups gives the divergence in both directions. At home the groups
   of a seat meet each other and the language's own vector, and a heap per group and segment keeps its ``TOP`` terms.

Partial sums of the segments are added and ranked at the end. Only counts travel, so the work after step 1 grows with
vocabulary times groups. All arithmetic is exact: shares are whole numbers of billionths found by long division in
64 bits, which holds up to 9e15 occurrences.

Defined results: null text, language and source count as empty ones; a group without a term has the shares of zero
counts; without a kept term all divergences of a language are 0 and it has no ``term`` rows; repeated rows count each;
ties rank by the item's bytes; a source alone in its language has no ``pair`` rows; an empty table gives an empty
result; only lang, source and text are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, stored

MIN_DOCS = 30
TOP = 50
SMOOTHING = 5
BILLION_STEPS = 3  # a billion is a thousand to this power
SEATS = 8
CELLS = 1 << 18
#: Different terms that a task counts before it hands them on; bytes of a text that are split at once.
COUNTED_TERMS = 200_000
PIECE_BYTES = 1 << 20
#: Letters fold A to Z only; every other ASCII byte separates; bytes of other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, occurrences and documents, summed over as many rows as fit."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def made() -> Iterator[pa.RecordBatch]:
        for (lang, source), (seen, held) in groups.items():
            n = len(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array([held[t] for t in seen], pa.int64())],
                names=["lang", "source", "term", "n", "d"],
            )
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            seen, held = groups.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for terms in _term_lists(text.as_py()):
                seen.update(terms)
                own.update(terms)
            held.update(own)
            if len(seen) > COUNTED_TERMS:
                yield from made()
        if sum(len(seen) for seen, _ in groups.values()) > COUNTED_TERMS:
            yield from made()
    yield from made()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n and sources (source, n) of each language's terms that ``min_docs`` of its documents hold."""
    counted = docs.mapInArrow(_counts, "lang string, source string, term binary, n long, d long").repartition("lang", "term")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by_term = summed.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return by_term.filter(F.col("d") >= min_docs).select("lang", "term", "n", "sources")


def _packed(places: list[int], counts: list[int]) -> bytes:
    gaps = np.diff(np.asarray(places, np.int64), prepend=0).astype(np.uint32)
    return zlib.compress(gaps.tobytes() + np.asarray(counts, np.int64).tobytes(), 1)


def _unpacked(piece: bytes | None, size: int) -> np.ndarray:
    counts = np.zeros(size, np.int64)
    if piece is not None:
        raw = zlib.decompress(piece)
        n = len(raw) // 12
        counts[np.cumsum(np.frombuffer(raw, np.uint32, n).astype(np.int64))] = np.frombuffer(raw, np.int64, n, 4 * n)
    return counts


def shares(counts: np.ndarray, all_counts: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (all + 5 terms)), by long division in base 1000."""
    rest, whole = counts + SMOOTHING, np.int64(all_counts) + SMOOTHING * np.int64(terms)
    found = np.zeros(len(counts), np.int64)
    for _ in range(BILLION_STEPS):
        rest = rest * 1000
        found = found * 1000 + rest // whole
        rest = rest % whole
    return found + 1


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One compressed vector per group of each segment; the language's own has a null source and the terms."""
    for batch in batches:
        for row in batch.to_pylist():
            vectors: dict[str | None, tuple[list[int], list[int]]] = {None: ([], [])}
            for place, term in enumerate(row["terms"]):
                vectors[None][0].append(place)
                vectors[None][1].append(term["n"])
                for s in term["sources"]:
                    places, counts = vectors.setdefault(s["source"], ([], []))
                    places.append(place)
                    counts.append(s["n"])
            n = len(vectors)
            terms = [[t["term"] for t in row["terms"]]] + [None] * (n - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["lang"]] * n, pa.string()),
                    pa.array([row["segment"]] * n, pa.int32()),
                    pa.array(list(vectors), pa.string()),
                    pa.array([sum(c) for _, c in vectors.values()], pa.int64()),
                    pa.array([_packed(*v) for v in vectors.values()], pa.binary()),
                    pa.array(terms, pa.list_(pa.binary())),
                ],
                names=["lang", "segment", "source", "n", "piece", "terms"],
            )


RESIDENT = "lang string, segment int, seat int, source string, size long, kept long, n long, piece binary"
MEETING = "part string, lang string, source string, item string, value long"


def _share_rows(frame: pd.DataFrame) -> list[np.ndarray]:
    return [shares(_unpacked(r.piece, r.size), r.n, r.kept) for r in frame.itertuples()]


def _meet(lang: str, own: list[tuple[str, np.ndarray]], peers: Iterator[tuple[str, np.ndarray]]) -> list[tuple]:
    rows = []
    for name, q in peers:
        for other, p in own:
            value = int(np.abs(p - q).sum())
            rows += [("pair", lang, other, name, value), ("pair", lang, name, other, value)]
    return rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "lang", "source", "item", "value"])


def _away(key: tuple, residents: pd.DataFrame, peers: pd.DataFrame) -> pd.DataFrame:
    """A meeting of two seats: residents of one, travelling vectors of the other."""
    if residents.empty or peers.empty:
        return _frame([])
    own = list(zip(residents["source"], _share_rows(residents), strict=True))
    travelling = ((r.source, shares(_unpacked(r.piece, r.size), r.n, r.kept)) for r in peers.rename(columns=lambda c: c.removeprefix("guest_")).itertuples())
    return _frame(_meet(key[0], own, travelling))


def _home(top: int):
    def run(key: tuple, residents: pd.DataFrame, language: pd.DataFrame) -> pd.DataFrame:
        """The groups of a seat among themselves, and each against its language by term."""
        if residents.empty:
            return _frame([])
        own = list(zip(residents["source"], _share_rows(residents), strict=True))
        rows = [row for i, (name, q) in enumerate(own) for row in _meet(key[0], own[:i], iter([(name, q)]))]
        for whole in language.rename(columns=lambda c: c.removeprefix("guest_")).itertuples():
            q = shares(_unpacked(whole.piece, whole.size), whole.n, whole.kept)
            for r, (name, p) in zip(residents.itertuples(), own, strict=True):
                over = np.flatnonzero((p > q) & (_unpacked(r.piece, r.size) > 0))
                best = heapq.nsmallest(top, ((int(q[i] - p[i]), whole.terms[i]) for i in over))
                rows += [("term", key[0], name, bytes(term).decode("utf-8", "replace"), -f) for f, term in best]
        return _frame(rows)

    return run


def partner(seat: int, turn: int, seats: int = SEATS) -> int:
    """Whom ``seat`` of an even number meets in ``turn`` 0 to seats - 2 of the tournament; the last seat stands still."""
    last = seats - 1
    if seat == last:
        return next(s for s in range(last) if (2 * s - turn) % last == 0)
    other = (turn - seat) % last
    return last if other == seat else other


def _meeting(residents: DataFrame, guests: DataFrame, keys: list[str], meet) -> DataFrame:
    """``meet`` for each seat; the guests come under names of their own, as they may be rows of the residents."""
    guests = guests.select([F.col(c).alias(f"guest_{c}") for c in guests.columns])
    return residents.groupBy(*keys).cogroup(guests.groupBy(*[f"guest_{k}" for k in keys])).applyInPandas(meet, MEETING)


def _settle(residents: DataFrame) -> None:
    """Keeps the rows where they are, in a plan that tells later ones how they are dealt, so that they are not shuffled again."""
    conf, name = residents.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        residents.persist()
    finally:
        conf.set(name, before)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, seats: int = SEATS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources of a language, and each source's ``top`` terms."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    frame = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark):
        terms = stored(kept_terms(frame, min_docs))
        groups = stored(frame.groupBy("lang", "source").count().select("lang", "source"))
        of_lang = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("all")), "lang", "left")
        cuts = F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) * (F.col("groups") + 1) / F.lit(cells))).cast("int")
        languages = stored(of_lang.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("all", F.lit(0)).alias("all"), cuts.alias("segments")))
        placed = terms.join(languages.select("lang", "segments"), "lang").withColumn("segment", F.pmod(F.xxhash64("term"), F.col("segments")).cast("int"))
        held = placed.groupBy("lang", "segment").agg(F.array_sort(F.collect_list(F.struct("term", "n", "sources"))).alias("terms"))
        vectors = stored(held.mapInArrow(_vectors, "lang string, segment int, source string, n long, piece binary, terms array<binary>"))
        # every group sits in every segment of its language, also where it has no term of it
        places = languages.withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("segments") - 1))).join(
            vectors.filter("source IS NULL").select("lang", "segment", F.col("piece").alias("whole"), "terms"), ["lang", "segment"], "left"
        )
        places = places.select("lang", "segment", "kept", "all", "whole", "terms", F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("size"))
        sums = vectors.filter("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("n").alias("n"))
        seated = groups.join(sums, ["lang", "source"], "left").withColumn("seat", F.pmod(F.xxhash64("source"), F.lit(seats)).cast("int"))
        residents = (
            seated.join(places.select("lang", "segment", "kept", F.greatest("size", F.lit(0)).alias("size")), "lang")
            .join(vectors.select("lang", "segment", "source", "piece"), ["lang", "segment", "source"], "left")
            .select("lang", "segment", "seat", "source", "size", "kept", F.coalesce("n", F.lit(0)).alias("n"), "piece")
            .repartition(n_parts, "lang", "segment", "seat")
        )
        _settle(residents)
        try:
            keys = ["lang", "segment", "seat"]
            own = places.filter("whole IS NOT NULL").select("lang", "segment", F.explode(F.sequence(F.lit(0), F.lit(seats - 1))).alias("seat"), "size", "kept", F.col("all").alias("n"), F.col("whole").alias("piece"), "terms")
            met = _meeting(residents, own, keys, _home(top))
            for turn in range(seats - 1):
                hosts = {s: partner(s, turn, seats) for s in range(seats) if partner(s, turn, seats) < s}
                host = F.create_map(*[F.lit(x) for pair in hosts.items() for x in pair])
                travelling = residents.filter(F.col("seat").isin(*hosts)).withColumn("seat", host[F.col("seat")])
                met = met.unionByName(_meeting(residents, travelling, keys, _away))
            values = stored(met.groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value")), lasting=True)
        finally:
            residents.unpersist()
    ranks = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = values.select("lang", "source", "part", "item", "value", ranks.alias("rank"))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))

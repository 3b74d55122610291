"""Language identification with hyperdimensional letter-trigram profiles.

Every letter has a random vector of +1 and -1. A trigram vector binds its three letters: the first one's
vector rotated twice, the second's rotated once, the third's as it is, multiplied element by element. A
text is bundled by adding its trigram vectors; a language prototype adds the unit vectors of its training
texts. The prediction is the prototype of the largest cosine; the score is the softmax of the cosines at
temperature ``TEMPERATURE``.

Letters are lower-cased; everything else is one separator, so that trigrams see word ends. Letters beyond
a to z share ``OTHER_SLOTS`` vectors by a hash of the code point, so the model's size does not depend on
the scripts of the corpus.

Training takes at most about ``TRAIN_ROWS`` labelled rows of each language, drawn by a hash of doc_id and text
from those that are not held out, so that a rare language is learned from all its rows; each partition sends one
sum per language, added by Spark.

Defined results: a null text and a text without a letter give ``und`` and score 0; without any training
row every prediction is ``und``; equal cosines go to the language that sorts first; repeated rows are
predicted one by one; an empty table gives an empty result; columns other than doc_id, text (and lang in
training) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, held_out

DIMENSIONS = 512
TRAIN_ROWS = 5_000
TEMPERATURE = 0.05
ASCII_SLOTS, OTHER_SLOTS = 27, 101
SLOT_BITS = 7
#: Texts are bundled together up to so many characters or rows.
BLOCK_CHARS, BLOCK_ROWS = 400_000, 96
#: Trigram vectors that a worker keeps.
KEPT_TRIGRAMS = 16_384


class Profiler:
    """Bundles texts into hypervectors; the same seed gives the same vectors in every process."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 20):
        draws = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (1 << SLOT_BITS, dimensions))
        letters = (2 * draws - 1).astype(np.float32)
        self.third = letters
        self.second = np.roll(letters, 1, axis=1)
        self.first = np.roll(letters, 2, axis=1)
        self.dimensions = dimensions
        self.slots = np.zeros(0x110000, dtype=np.uint8)
        points = np.array([c for c in range(0x110000) if chr(c).isalpha()], dtype=np.uint64)
        self.slots[points] = ASCII_SLOTS + (points * np.uint64(2654435761) % np.uint64(1 << 32) % np.uint64(OTHER_SLOTS))
        for i in range(26):
            self.slots[ord("a") + i] = 1 + i
        self.row_of = np.full(1 << 3 * SLOT_BITS, -1, dtype=np.int32)
        self.kept = np.zeros((0, dimensions), dtype=np.float32)

    def _rows(self, trigrams: np.ndarray) -> np.ndarray:
        """The vectors of distinct trigrams."""
        new = trigrams[self.row_of[trigrams] < 0]
        mask = (1 << SLOT_BITS) - 1
        if len(new):
            if len(self.kept) + len(new) > KEPT_TRIGRAMS:
                self.row_of[:] = -1
                self.kept = self.kept[:0]
                new = trigrams
            made = self.first[new >> 2 * SLOT_BITS] * self.second[new >> SLOT_BITS & mask] * self.third[new & mask]
            self.row_of[new] = np.arange(len(self.kept), len(self.kept) + len(new))
            self.kept = np.concatenate([self.kept, made])
        return self.kept[self.row_of[trigrams]]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One row per text; zero where a text has no letter."""
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        points = np.frombuffer("".join(f"\n{t.lower()}\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(t.lower()) + 2 for t in texts])
        code = self.slots[points]
        owner = np.repeat(np.arange(len(texts)), lengths)
        keep = code > 0  # and the separators beside letters
        keep[1:] |= code[:-1] > 0
        keep[:-1] |= code[1:] > 0
        code, owner = code[keep].astype(np.int64), owner[keep]
        if len(code) < 3:
            return out
        trigram = code[:-2] << 2 * SLOT_BITS | code[1:-1] << SLOT_BITS | code[2:]
        fine = (owner[:-2] == owner[2:]) & (code[1:-1] + code[:-2] > 0) & (code[1:-1] + code[2:] > 0)
        seen, counts = np.unique(owner[:-2][fine] << 3 * SLOT_BITS | trigram[fine], return_counts=True)
        if not len(seen):
            return out
        rows, trigrams = seen >> 3 * SLOT_BITS, seen & (1 << 3 * SLOT_BITS) - 1
        distinct, at = np.unique(trigrams, return_inverse=True)
        for a in range(0, len(distinct), KEPT_TRIGRAMS):
            inside = (at >= a) & (at < a + KEPT_TRIGRAMS)
            weights = np.zeros((len(texts), min(KEPT_TRIGRAMS, len(distinct) - a)), dtype=np.float32)
            weights[rows[inside], at[inside] - a] = counts[inside]
            out += weights @ self._rows(distinct[a : a + KEPT_TRIGRAMS])
        return out


def _blocks(values: list) -> Iterator[tuple[int, int]]:
    a, chars = 0, 0
    for i, text in enumerate(values):
        chars += len(text)
        if chars >= BLOCK_CHARS or i - a + 1 >= BLOCK_ROWS:
            yield a, i + 1
            a, chars = i + 1, 0
    if a < len(values):
        yield a, len(values)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    profiler, sums = Profiler(), {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in _blocks(texts):
            vectors = _unit(profiler.bundle(texts[a:b]))
            for lang in set(langs[a:b]):
                mine = [i for i, x in enumerate(langs[a:b]) if x == lang]
                sums[lang] = sums.get(lang, 0) + vectors[mine].sum(axis=0).astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "sums"])


def fit(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """The learned languages, sorted, and their unit prototypes."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    many = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().filter(F.col("count") > max_rows).collect()}
    taken = F.lit(True)
    for lang, n in many.items():
        taken = F.when(F.col("lang") == lang, drawn(F.xxhash64("doc_id", "text"), max_rows / n)).otherwise(taken)
    sums = (
        rows.filter(taken)
        .select("lang", "text")
        .mapInArrow(_partial_sums, "lang string, sums array<double>")
        .select("lang", F.posexplode("sums").alias("i", "v"))
        .groupBy("lang", "i")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    langs = sorted({r["lang"] for r in sums})
    prototypes = np.zeros((len(langs), DIMENSIONS), dtype=np.float32)
    place = {lang: k for k, lang in enumerate(langs)}
    for r in sums:
        prototypes[place[r["lang"]], r["i"]] = r["v"]
    return langs, _unit(prototypes)


def _predict(langs: list[str], prototypes: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler()
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            preds, scores = [], []
            for a, b in _blocks(texts):
                vectors = profiler.bundle(texts[a:b])
                known = np.abs(vectors).sum(axis=1) > 0
                if not langs:
                    preds += ["und"] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                cosines = _unit(vectors) @ prototypes.T
                best = cosines.argmax(axis=1)
                odds = np.exp((cosines - cosines.max(axis=1, keepdims=True)).astype(np.float64) / TEMPERATURE)
                preds += [langs[k] if x else "und" for k, x in zip(best, known, strict=True)]
                scores += np.where(known, 1 / odds.sum(axis=1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return run


def predict_language(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; trains on ``docs`` unless given a model."""
    langs, prototypes = model or fit(docs)
    return docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), F.col("text").cast("string")).mapInArrow(
        _predict(langs, prototypes), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def keep_known_languages(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """The rows of ``docs`` in a learned language, or in any where none was learned; a row without a letter goes."""
    langs, prototypes = model or fit(docs)
    if not langs:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    columns = docs.columns
    predict = _predict(langs, prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            asked = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), batch.column(columns.index("text"))], names=["doc_id", "held_out", "text"])
            (judged,) = predict(iter([asked]))
            yield batch.filter(pa.compute.not_equal(judged.column(2), "und"))

    return docs.mapInArrow(run, docs.schema)

"""Document quality by a sparse ensemble of rules over statistics of the text.

1. Statistics are Spark columns over the whole text: length, shares of letters, capitals, digits and symbols, marks and
   bars by words, repeated words, lines and neighbours, lengths of words, sentences and lines.
2. A random forest of shallow trees is fitted to labelled rows. Every path from a root to a node is a rule, a conjunction
   of bounds on statistics; equal rules count once.
3. A logistic regression under the lasso weighs the rules' indicators; most weights become 0, and those rules go.
4. The rest are compiled into one Spark column: a sum of CASE expressions through the logistic function. Scoring is a
   projection without a shuffle.

Learning is from rows whose crc32(doc_id as text) mod 5 is not 0, at most about ``TRAIN_ROWS`` of them, drawn by a hash
of doc_id; a doc_id that is labelled both ways is left out, and one with several texts gives one of them. Labels, lang,
source and doc_id are no inputs of a score.

Defined results: a null text counts as an empty one, whose statistics are all 0; equal texts have equal scores; a null
doc_id counts as held out; without a labelled row the score is 0.5, with labels of one kind that kind; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn, scratch, stored

TRAIN_ROWS = 20_000
HELD_OUT_MODULUS = 5
TREES, DEPTH, LEAST_ROWS = 24, 3, 5
LASSO = 0.002
THRESHOLD = 0.3
#: The statistics, in the order of the trees' features.
FEATURES = "characters words word_length letters capitals digits symbols marks bars distinct_words twins sentence_words line_words distinct_lines".split()


def held_out(doc_id: Column) -> Column:
    """True for rows that the classifier may not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MODULUS == 0, F.lit(True))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))


#: Characters, or runs of them, that are counted.
COUNTS: dict[str, str] = {"letters": r"\p{L}", "capitals": r"\p{Lu}", "digits": r"\p{Nd}", "blanks": r"\s", "symbols": r"[^\p{L}\p{Nd}\s.,;:'’()\-]", "marks": r"[!?]", "bars": r"[|]", "stops": r"[.!?…]+"}


def with_statistics(frame: DataFrame) -> DataFrame:
    """``frame`` with its ``text`` replaced by the statistics; all doubles."""
    others = [c for c in frame.columns if c != "text"]
    said = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = frame.select(*others, said.alias("said"))
    words = F.filter(F.split("said", r"\s+"), lambda w: w != "")
    lines = F.filter(F.transform(F.split("said", r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    counts = {name: F.regexp_count("said", F.lit(pattern)).alias(name) for name, pattern in COUNTS.items()}
    parts = parts.select(*others, F.length("said").alias("n"), words.alias("words"), lines.alias("lines"), *counts.values())
    n, words, lines, count = F.col("n"), F.col("words"), F.col("lines"), {name: F.col(name) for name in COUNTS}
    n_words, n_lines = F.size(words), F.size(lines)
    following = F.slice(words, F.lit(2), F.greatest(n_words, F.lit(1)))
    twins = F.size(F.filter(F.zip_with(words, following, lambda a, b: a == b), lambda same: same))
    solid = n - count["blanks"]
    statistics = {
        "characters": F.log1p(n.cast("double")),
        "words": F.log1p(n_words.cast("double")),
        "word_length": _ratio(solid, n_words),
        "letters": _ratio(count["letters"], solid),
        "capitals": _ratio(count["capitals"], count["letters"]),
        "digits": _ratio(count["digits"], solid),
        "symbols": _ratio(count["symbols"], solid),
        "marks": _ratio(count["marks"], n_words),
        "bars": _ratio(count["bars"], n_words),
        "distinct_words": _ratio(F.size(F.array_distinct(words)), n_words),
        "twins": _ratio(twins, n_words),
        "sentence_words": _ratio(n_words, count["stops"]),
        "line_words": _ratio(n_words, n_lines),
        "distinct_lines": _ratio(F.size(F.array_distinct(lines)), n_lines),
    }
    return parts.select(*others, *[statistics[name].alias(name) for name in FEATURES])


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, above, up to) that must all hold; None where a side is open."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        fits = F.lit(True)
        for name, above, up_to in self.bounds:
            if above is not None:
                fits = fits & (F.col(name) > above)
            if up_to is not None:
                fits = fits & (F.col(name) <= up_to)
        return fits

    def holds(self, values: dict[str, float]) -> bool:
        return all((above is None or values[name] > above) and (up_to is None or values[name] <= up_to) for name, above, up_to in self.bounds)


@dataclass(frozen=True)
class Ensemble:
    """An intercept and weighed rules."""

    intercept: float
    rules: tuple[tuple[float, Rule], ...] = ()

    def score(self) -> Column:
        """The probability of label 1, of the columns in FEATURES."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(node, bounds: dict[str, tuple[float | None, float | None]]) -> list[Rule]:
    """The rules of all nodes below and at ``node``."""
    found = [Rule(tuple((name, *side) for name, side in sorted(bounds.items())))] if bounds else []
    if node.getClass().getSimpleName() == "LeafNode":
        return found
    name, cut = FEATURES[node.split().featureIndex()], float(node.split().threshold())
    above, up_to = bounds.get(name, (None, None))
    left = bounds | {name: (above, cut if up_to is None else min(cut, up_to))}
    right = bounds | {name: (cut if above is None else max(cut, above), up_to)}
    return found + _paths(node.leftChild(), left) + _paths(node.rightChild(), right)


def rules_of(forest) -> list[Rule]:
    """The different rules of a forest, in the order of its trees."""
    return list(dict.fromkeys(rule for tree in forest.trees for rule in _paths(tree._call_java("rootNode"), {})))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """label and the statistics of about ``max_rows`` rows that may be learned from."""
    quality = F.col("quality").cast("int")
    marks = labels.filter(quality.isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(quality).alias("low"), F.max(quality).alias("label"))
    marks = stored(marks.filter("low = label").select("doc_id", "label"))
    marks = marks.filter(drawn(F.xxhash64("doc_id"), max_rows / max(1, marks.count())))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")  # about max_rows rows of two numbers
    one = F.min(F.struct("label", *FEATURES)).alias("row")
    return with_statistics(texts).groupBy("doc_id").agg(one).select("row.*")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Ensemble:
    """The weighed rules learned from labelled rows that are not held out."""
    with scratch(docs.sparkSession):
        rows = stored(training_rows(docs, labels, max_rows))
        ones, total = rows.agg(F.sum("label"), F.count("*")).first()
        if not total:
            return Ensemble(0.0)
        if ones in (0, total):
            return Ensemble(40.0 if ones else -40.0)
        numbers = rows.select("label", array_to_vector(F.array(*FEATURES)).alias("features"))
        forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, featureSubsetStrategy="onethird", seed=7).fit(numbers)
        rules = rules_of(forest)
        if not rules:
            return Ensemble(math.log(ones / (total - ones)))
        marks = stored(rows.select("label", F.array(*[r.column().cast("double") for r in rules]).alias("held")))
        model = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(marks.select("label", array_to_vector("held").alias("features")))
    weights = model.coefficients.toArray().tolist()
    return Ensemble(float(model.intercept), tuple((w, r) for w, r in zip(weights, rules, strict=True) if w != 0))


def score_documents(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = with_statistics(frame).select("doc_id", "held_out", ensemble.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

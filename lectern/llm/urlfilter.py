"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

The rules label the URLs that they fit; the trees learn from these. Features: lengths of URL, host, path and
query, path depth, host labels, digit ratio, letter entropy, parameter count, hyphens, whether a fragment or a
file ending is there, and suffix statistics: the smoothed share of blocked training URLs under the same last
host label, under the same last two labels and in the same first folder of the path, kept in ``SUFFIX_BUCKETS``
hash buckets each, so that their table has a fixed size.

A training row never sees its own label in a statistic: hosts are dealt to ``FOLDS`` folds, and a row gets the
statistics of the other folds. At most about ``TRAIN_ROWS`` labelled rows are drawn by a hash of the URL and written
once; a host of many rows weighs as the root of their number, and both labels weigh the same in all. The fitted
trees become CASE expressions, so judging is one projection after joins with tables of fixed size.

Everything is DataFrame functions and Spark's own JVM learner; no Python runs on executors.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by
its features like any other; host case is folded for A to Z only; equal rows get equal verdicts; with no
labelled row, or with one label only, what no rule fits gets that label or else ``allow``; an empty table
gives an empty result; columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drawn, stored

#: The policy, longest first where two fit.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
TRAIN_ROWS = 20_000
TREES, DEPTH, STEP = 10, 4, 0.3
SUFFIX_BUCKETS = 1024
SMOOTHING = 20.0
FOLDS = 4
STATISTICS = ("last", "last_two", "folder")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length host_length path_length query_length depth labels digit_ratio entropy parameters hyphens has_fragment has_ending last_rate last_two_rate folder_rate"
).split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A to Z lower-cased, and the path; both empty without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def lexical(frame: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url``, ``host`` and ``path`` and the buckets of its suffix statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    symbols = F.split(F.lower(url), "")
    entropy = F.aggregate(
        F.array_distinct(symbols),
        F.lit(0.0),
        lambda total, s: total - (F.length(url) - F.length(F.replace(F.lower(url), s, F.lit("")))) / n * F.log2((F.length(url) - F.length(F.replace(F.lower(url), s, F.lit("")))) / n),
    )
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(SUFFIX_BUCKETS)).cast("int")
    return frame.withColumns(
        {
            "url_length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "query_length": F.length(query).cast("double"),
            "depth": F.regexp_count("path", F.lit("/")).cast("double"),
            "labels": F.regexp_count("host", F.lit(r"\.")).cast("double"),
            "digit_ratio": F.coalesce(F.regexp_count(url, F.lit("[0-9]")) / F.nullif(n, F.lit(0)), F.lit(0.0)),
            "entropy": F.when(n > 0, F.coalesce(F.nanvl(entropy, F.lit(0.0)), F.lit(0.0))).otherwise(0.0),
            "parameters": F.regexp_count(query, F.lit("=")).cast("double"),
            "hyphens": F.regexp_count(url, F.lit("-")).cast("double"),
            "has_fragment": url.contains("#").cast("double"),
            "has_ending": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
            "last": bucket(F.substring_index("host", ".", -1)),
            "last_two": bucket(F.substring_index("host", ".", -2)),
            "folder": bucket(F.regexp_extract("path", r"^/([^/]*)/", 1)),
        }
    )


def _rates(weighed: DataFrame, *keys: str) -> list[DataFrame]:
    """Per bucket of each statistic the smoothed share of blocked weight; at most SUFFIX_BUCKETS rows each (per fold)."""
    rate = (F.sum(F.col("label") * F.col("weight")) + SMOOTHING * 0.5) / (F.sum("weight") + SMOOTHING)
    return [weighed.groupBy(*keys, c).agg(rate.alias(f"{c}_rate")) for c in STATISTICS]


def _with_rates(frame: DataFrame, rates: list[DataFrame], *keys: str) -> DataFrame:
    for c, rate in zip(STATISTICS, rates, strict=True):
        frame = frame.join(F.broadcast(rate), [*keys, c], "left").withColumn(f"{c}_rate", F.coalesce(f"{c}_rate", F.lit(0.5)))
    return frame


def _tree(node) -> Column:
    """A fitted tree as a CASE expression."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(FEATURES[split.featureIndex()]) <= float(split.threshold()), _tree(node.leftChild())).otherwise(_tree(node.rightChild()))


def margin_of(model) -> Column:
    """The weighted sum of a fitted model's trees; above 0: block."""
    return sum((F.lit(float(w)) * _tree(t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees, strict=True)), F.lit(0.0))


def weigh(labelled: DataFrame) -> DataFrame:
    """Adds weight: a host's rows together as the root of their number, both labels alike in all. The rows are a bounded sample."""
    hosts = labelled.withColumn("weight", 1 / F.sqrt(F.count("*").over(Window.partitionBy("host"))))
    sums = hosts.groupBy("label").agg(F.sum("weight").alias("all_weight"), F.count("*").alias("all_rows"))
    total = F.sum("all_rows").over(Window.partitionBy())  # of two rows
    sums = sums.select("label", (total / 2 / F.col("all_weight")).alias("factor"))
    return hosts.join(F.broadcast(sums), "label").withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")


def train(labelled: DataFrame) -> tuple[object, list[DataFrame]]:
    """The fitted model and the suffix statistics for judging; ``labelled``: url, host, path, label of both kinds."""
    weighed = stored(weigh(lexical(labelled)).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")))
    # each row once for every other fold, so that a fold's statistics lack its own hosts
    others = weighed.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).filter("own <> fold")
    rows = _with_rates(weighed, _rates(others, "fold"), "fold")
    features = stored(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "weight", "features"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, weightCol="weight", checkpointInterval=-1).fit(features)
    return model, [stored(rate) for rate in _rates(weighed)]


def judge_urls(pages: DataFrame, rules=RULES, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and margin (above 0: block) of every row."""
    host, path = host_and_path(F.col("url"))
    frame = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    frame = frame.withColumns({"rule": rule, "ruled": ruled})
    labelled = frame.filter(F.col("ruled").isNotNull()).select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) == 2:
        share = max_rows / sum(counts.values())
        sample = stored(labelled.filter(drawn(F.xxhash64("url"), share)))
        counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        verdict = F.coalesce("ruled", F.lit("block" if 1.0 in counts else "allow"))
        return frame.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.lit(0.0).alias("margin"))
    model, rates = train(sample)
    judged = _with_rates(lexical(frame), rates).withColumn("margin", margin_of(model))
    verdict = F.coalesce("ruled", F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "margin")

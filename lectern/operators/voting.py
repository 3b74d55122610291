"""Votes and two-voice structure: A-04, A-05, I-16, W-07, W-08, X-09."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timecodes import half_even
from ..settings import BRITISH, DEFAULTS, Settings
from .intervals import KEY, chain_same_label
from .timeseries import ward_two

#: What ``every_nth`` leaves at most of a recording.
MOST_PIECES = 1500


def evenly_spaced(rows: DataFrame, order: str, most: int = 80) -> DataFrame:
    """A-04: at most ``most`` rows per recording, at evenly spaced places (rounded half to even)."""
    here = Window.partitionBy(KEY)
    numbered = rows.withColumns({"place": F.row_number().over(here.orderBy(order)) - 1, "n": F.count("*").over(here)})
    spots = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * ((F.col("n") - 1) / F.lit(float(most - 1))), 0).cast("int"))
    return numbered.filter((F.col("n") <= most) | F.array_contains(spots, F.col("place"))).drop("place", "n")


def vote(chunks: DataFrame, group_of: Column, order: str = "chunk") -> DataFrame:
    """A-04: per recording the number of votes, shares per label and per group, and the leading group.

    ``chunks``: rec_id, an order column, label. Ties go to the group seen first.
    """
    voted = chunks.withColumn("grp", group_of)
    total = Window.partitionBy(KEY)

    def shares(column: str) -> DataFrame:
        counted = voted.groupBy(KEY, column).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
        counted = counted.withColumn("n", F.sum("votes").over(total))
        listed = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("k"), F.col("first"), F.col(column).alias("name"), half_even(F.col("votes") / F.col("n"), 2).alias("share"))))
        return counted.groupBy(KEY).agg(F.max("n").alias("n"), listed.alias("l"))

    labels = shares("label").select(KEY, "n", F.map_from_arrays(F.col("l.name"), F.col("l.share")).alias("labels"))
    groups = shares("grp").select(KEY, F.map_from_arrays(F.col("l.name"), F.col("l.share")).alias("groups"), F.col("l")[0]["name"].alias("top"))
    return labels.join(groups, KEY)


def foreign_stretches(chunks: DataFrame, group_of: Column, home: str = BRITISH) -> DataFrame:
    """I-16: chained chunks (rec_id, start_s, end_s, label) of one group other than ``home``, two or more."""
    return chain_same_label(chunks.withColumn("grp", group_of), "grp").filter((F.col("grp") != home) & (F.col("n") >= 2))


def every_nth(rows: DataFrame, order: str, most: int = MOST_PIECES) -> DataFrame:
    """X-09: every n-th row per recording, n the least that leaves at most ``most``."""
    here = Window.partitionBy(KEY)
    numbered = rows.withColumns({"place": F.row_number().over(here.orderBy(order)) - 1, "n": F.count("*").over(here)})
    stride = F.when(F.col("n") > most, F.floor(F.col("n") / most) + 1).otherwise(F.lit(1))
    return numbered.filter(F.col("place") % stride == 0).drop("place", "n")


# Short names of accents.
SHORT_ACCENTS = {"британский": "брит.", "американский": "амер.", "ирландский": "ирл.", "австралийский": "австрал.", "индийский": "инд.", "другой": "другой"}


def accent_label(group: Column, share: Column) -> Column:
    """F-24: a group's short name, or the group itself, with its share in whole percent."""
    names = F.create_map(*[F.lit(x) for pair in SHORT_ACCENTS.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(names, group), group), F.lit(" "), F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def smooth_labels(labelled: DataFrame, order: str = "piece") -> DataFrame:
    """W-07: the majority of five neighbours, ties to the lower of the labels 1 and 2."""
    near = Window.partitionBy(KEY).orderBy(order).rowsBetween(-2, 2)
    ones = F.sum((F.col("label") == 1).cast("int")).over(near)
    return labelled.withColumn("smooth", F.when(ones * 2 >= F.count("*").over(near), 1).otherwise(2))


def turns(smoothed: DataFrame, seconds: Column, order: str = "piece", label: str = "smooth") -> DataFrame:
    """W-08: label changes and their rate per minute of speech; ``seconds``: the length of a row."""
    before = F.lag(label).over(Window.partitionBy(KEY).orderBy(order))
    marked = smoothed.withColumns({"change": F.coalesce((before != F.col(label)).cast("int"), F.lit(0)), "length": seconds})
    return marked.groupBy(KEY).agg(F.sum("change").alias("turns"), (F.sum("change") / F.greatest(F.sum("length") / 60, F.lit(1e-6))).alias("turns_per_min"))


DIALOGUE = f"{KEY} long, pieces int, separation double, minor_share double, turns_per_min double, conversation boolean, reason string"


def dialogue_structure(voice: DataFrame, st: Settings = DEFAULTS) -> DataFrame:
    """A-05: whether two voices take turns, from embeddings (rec_id, piece, start_s, end_s, vec).

    Fewer than 20 pieces: no verdict (null). The clustering of all pieces of one recording is a function per recording.
    """

    def judge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece")
        n = len(frame)
        if n < 20:
            return pd.DataFrame([(key[0], n, None, None, None, None, "слишком мало речи, чтобы судить")], columns=_DIALOGUE_NAMES)
        vectors = np.stack(frame["vec"].to_list()).astype(float)
        vectors -= vectors.mean(axis=0)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
        labels = ward_two(vectors)
        # the mean cosine to a group is the product with the group's mean vector
        first = labels == 1
        to_first, to_second = (vectors @ (vectors[g].sum(axis=0) / max(1, g.sum())) for g in (first, ~first))
        separation = float(np.where(first, to_first - to_second, to_second - to_first).mean())
        minor = float(min(first.mean(), 1 - first.mean()))
        near = np.ones(5)
        ones, around = np.convolve(first, near, "same"), np.convolve(np.ones(n), near, "same")
        changes = int(np.count_nonzero(np.diff(2 * ones >= around)))
        rate = changes / max(float((frame["end_s"] - frame["start_s"]).sum()) / 60, 1e-6)
        two = separation >= st.separation and minor >= st.minor_share
        talk = two and rate >= st.turns_per_min
        reason = "" if talk else "голоса звучат длинными блоками, а не чередуются" if two else "говорит в основном один человек"
        return pd.DataFrame([(key[0], n, round(separation, 3), round(minor, 2), round(rate, 1), bool(talk), reason)], columns=_DIALOGUE_NAMES)

    return voice.groupBy(KEY).applyInPandas(judge, DIALOGUE)


_DIALOGUE_NAMES = [c.split(" ")[0] for c in DIALOGUE.split(", ")]

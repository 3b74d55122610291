"""Chains of pointers by doubling: how long each is and what is met on it, in rounds as many as its length has digits.

``pointers``: path, to; a path points to one other at most. A chain ends where nothing points on, and before a path that
it has met already, so a chain into a circle goes once around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keep_sized


def _met(rows: DataFrame, others: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by a shuffle: what is kept of a round is small as a file, but rounds are many, and a broadcast sends each through the driver."""
    return rows.join(others.hint("merge"), on, how)


def _ends(pointers: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(path, end, n) of the chains that end and (path, at) of those that have not after ``limit`` steps or more."""
    done: DataFrame | None = None
    going, steps = keep_sized(pointers.select("path", F.col("to").alias("at"), F.lit(1).cast("long").alias("n"))), 1
    whole = going
    while True:
        further = whole.select(F.col("path").alias("at"), F.col("at").alias("next"), F.col("n").alias("more"))
        met = _met(going, further, "at", "left")
        ended = keep_sized(met.filter("next IS NULL").select("path", F.col("at").alias("end"), "n"))
        done = ended if done is None else done.unionByName(ended)
        going = keep_sized(met.filter("next IS NOT NULL").select("path", F.col("next").alias("at"), (F.col("n") + F.col("more")).alias("n")))
        steps *= 2
        # one round after all chains that end are at their ends
        if steps > 2 * limit or going.isEmpty():
            return done, going.select("path", "at")
        # those that ended are met with the rest of their way, the others with twice the steps
        whole = keep_sized(done.select("path", F.col("end").alias("at"), "n").unionByName(going))


def lengths(pointers: DataFrame) -> DataFrame:
    """(path, steps): how many others each chain meets, each once."""
    limit = pointers.count()
    done, going = _ends(pointers, limit)
    found = done.select("path", F.col("n").alias("steps"))
    if going.isEmpty():
        return found
    # after as many steps as there are pointers all that still go are in circles, and all of a circle is reached
    circle = keep_sized(going.select(F.col("at").alias("path")).distinct())
    inside = _met(pointers, circle, "path", "left_semi")
    least, steps, size = keep_sized(inside.select("path", F.col("to").alias("at"), F.least("path", "to").alias("least"))), 1, circle.count()
    while steps < size:
        further = least.select(F.col("path").alias("at"), F.col("at").alias("next"), F.col("least").alias("other"))
        least = keep_sized(_met(least, further, "at").select("path", F.col("next").alias("at"), F.least("least", "other").alias("least")))
        steps *= 2
    around = least.groupBy("least").agg(F.count("*").alias("round"))
    rounds = keep_sized(_met(least, around, "least").select("path", (F.col("round") - 1).alias("steps")))
    tails = _met(_met(pointers, going.select("path"), "path", "left_semi"), circle, "path", "left_anti")
    reached, _ = _ends(tails, limit)
    tailed = _met(reached, rounds.select(F.col("path").alias("end"), "steps"), "end").select("path", (F.col("n") + F.col("steps")).alias("steps"))
    return found.unionByName(rounds).unionByName(tailed)


def along(pointers: DataFrame, what: list[str], join: dict[str, Column]) -> DataFrame:
    """(path, *what): what is met along the whole of each chain that meets any.

    ``pointers`` has path, to and the columns ``what``, said of one step; ``join`` says them of two ways in a row, from
    columns near_* of the first and far_* of the second. Ways of 1, 2, 4 … steps are joined from halves, only for chains
    that long, and each chain is put together from those that its length has as binary digits.
    """
    steps = keep_sized(lengths(pointers.select("path", "to")).filter("steps > 0"))
    way = keep_sized(_met(pointers, steps, "path").select("path", "to", *what, "steps"))
    ways, k = [way], 0
    sides = lambda side: [F.col(c).alias(f"{side}_{c}") for c in what]
    while True:
        k += 1
        near = way.filter(F.col("steps") >= 1 << k).select("path", F.col("to").alias("middle"), "steps", *sides("near"))
        far = way.select(F.col("path").alias("middle"), "to", *sides("far"))
        way = keep_sized(_met(near, far, "middle").select("path", "to", *[join[c].alias(c) for c in what], "steps"))
        if way.isEmpty():
            break
        ways.append(way)
    # from the longest way on, each chain goes on where the way before ended
    state = steps.select("path", F.col("path").alias("at"), "steps", *[F.lit(None).cast(dict(pointers.dtypes)[c]).alias(c) for c in what], F.lit(True).alias("fresh"))
    for k in range(len(ways) - 1, -1, -1):
        far = ways[k].select(F.col("path").alias("at"), F.col("to").alias("next"), *sides("far"))
        goes = F.col("steps").bitwiseAND(F.lit(1 << k)) != 0
        met = state.filter(goes).select("path", "at", "steps", "fresh", *sides("near"))
        met = _met(met, far, "at")
        moved = met.select("path", F.col("next").alias("at"), "steps", *[F.when(F.col("fresh"), F.col(f"far_{c}")).otherwise(join[c]).alias(c) for c in what], F.lit(False).alias("fresh"))
        state = keep_sized(state.filter(~goes).unionByName(moved))
    return state.select("path", *what)

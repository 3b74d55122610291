"""Numbers of rows in an order, without one sorted task: ranges written once, counts per range, a sum before each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import keep

RANGE, BEFORE, PLACE = "lectern_range", "lectern_before", "lectern_place"


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, name: str = "no") -> DataFrame:
    """Adds ``name``: 1 to n in the order of ``order``, for each value of ``by`` anew where that is given.

    The ranges of (by, order) are kept before they are counted, so a task that is run again after a loss finds its rows
    in the same range. A value of ``by`` may lie in many ranges; what precedes a range within it is the sum of their
    counts, of which there are no more than ranges. Rows equal in (by, order) lie in one range.
    """
    by = by or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(rows.repartitionByRange(parts, *by, *order).withColumn(RANGE, F.spark_partition_id()))
    sums = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, RANGE).agg(F.count("*").alias(PLACE))
    offsets = sizes.select(*[F.col(c).alias(f"{BEFORE}_{c}") for c in by], F.col(RANGE).alias(f"{BEFORE}_of"), F.coalesce(F.sum(PLACE).over(sums), F.lit(0)).alias(BEFORE))
    same = F.col(RANGE) == F.col(f"{BEFORE}_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{BEFORE}_{c}"))
    local = F.row_number().over(Window.partitionBy(*by, RANGE).orderBy(*order))
    placed = ranged.withColumn(PLACE, local).join(offsets, same)
    return placed.select(*rows.columns, (F.col(BEFORE) + F.col(PLACE)).alias(name))

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) mod 4 has this remainder are never learned from.
HELD_OUT_REMAINDER = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """True for rows that no model may learn from; a null doc_id counts as held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(True))


def drawn(hashed: Column, share: float) -> Column:
    """True for about ``share`` of the hashes, for shares of any smallness."""
    return hashed.bitwiseAND(F.lit(2**63 - 1)).cast("double") < F.lit(float(min(1.0, share)) * 2.0**63) if share < 1 else F.lit(True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a temporary one is made.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return context.getCheckpointDir()


#: The paths written in each open ``scratch``, innermost last.
_written: list[list[str]] = []


def stored(df: DataFrame, lasting: bool = False) -> DataFrame:
    """``df`` written as a table into the checkpoint folder and read from there.

    Inside ``scratch`` the table goes when that ends, a ``lasting`` one when the one around it does.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    depth = len(_written) - 1 - lasting
    if depth >= 0:
        _written[depth].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, also: str | None = None) -> Iterator[None]:
    """Deletes at its end the tables that were stored inside it; nothing that reads them may be run later.

    The table ``also`` goes with them, unless what ran inside has failed.
    """
    _written.append([])
    try:
        yield
        _written[-1].extend([also] if also else [])
    finally:
        configuration = spark._jsc.hadoopConfiguration()
        for path in _written.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(configuration).delete(place, True)

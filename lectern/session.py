"""Session helpers shared by the queries, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "lectern", memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and bench use."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus if str(cpus).isdigit() else 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; only where that is unset and the master is local
    (tests) a temporary one is made.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return context.getCheckpointDir()


def keep_by(df: DataFrame, *keys: str) -> DataFrame:
    """``keep`` of ``df`` dealt by ``keys``: windows, groups and joins on the keys read it without another exchange.

    The plan is made without adaptive changes, as only then the kept rows are known to lie where they were dealt.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return keep(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), *keys))
    finally:
        conf.set(name, before)


def keep_sized(df: DataFrame) -> DataFrame:
    """``keep`` as a table of files, whose size is then known as it is.

    A checkpoint goes on with the size estimated for its plan; where each round joins what the one before kept, that
    estimate is squared again and again, until its digits alone take minutes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/lectern-kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()

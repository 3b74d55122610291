"""The corpus pipeline: toxicity, language, near-duplicates, benchmark leaks, packing.

Each stage is a function of (spark, docs, sf_dir). ``run`` writes the rows of each stage as Parquet into the
checkpoint folder of the session and reads them again as the documents of the next; what a stage has stored on its
way, and the rows that it read, are deleted once its own are written. All stages but the last
return the columns of the documents they get.

Decisions: texts that the toxicity grammar scores 0.3 or more go; texts without a letter, which have no
language, go; of each near-duplicate class the row of the least doc_id stays; a text in which any window of
ten benchmark words occurs goes; what is left is packed into windows of 1024 tokens.

Empty tables pass through every stage and give an empty result; a null text counts as an empty one, has no
language and goes in the second stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontamination, langid, neardup, packing, toxicity
from lectern.llm.common import checkpoint_folder, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known_languages(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL has no way to say the learned grammar, the profiles, the alignment or the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with scratch(spark, before):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs, before = spark.read.parquet(path), path
    return docs

"""Every model table and query as a temporary view, so that all of it is reachable from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import adapters

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession, sf_dir: str, queries: tuple[str, ...] = ()) -> list[str]:
    """Views of the general tables, of the model tables, and of the named queries; gives their names."""
    from .queries import QUERIES

    made = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    segments, words = adapters.segments(spark, sf_dir), adapters.words(spark, sf_dir)
    made |= {"segments": segments, "recordings": adapters.recordings(segments), "words": words, "word_recordings": adapters.word_recordings(words)}
    made |= {n: getattr(adapters, n)(spark, sf_dir) for n in ("music", "frames", "accents", "voice", "catalog", "titles", "files")}
    made |= {n: QUERIES[n](spark, sf_dir) for n in queries}
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return sorted(made)

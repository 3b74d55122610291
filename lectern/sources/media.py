"""Files, folders and the catalogue sheet as sources and sinks: S-08, S-10 to S-15, S-17, M-01 to M-08."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import path_key
from ..operators.numbering import numbered

# Endings of media files and the names of result folders.
MEDIA = (
    "m4a mp3 aac wav flac ogg oga opus wma aiff aif alac ape wv amr ac3 eac3 mka caf m4b mp2 mp4 m4v mov mkv "
    "webm avi wmv flv mpg mpeg ts mts m2ts 3gp 3g2 ogv vob asf dv mxf f4v rm rmvb"
).split()
RESULTS = ("готово",)


def is_media(path: Column) -> Column:
    """S-08: a media file that is no hidden file, no result and in no hidden or result folder."""
    name = F.regexp_replace(path, "^.*/", "")
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda d: d.startswith(".") | d.isin(*RESULTS))
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(MEDIA) & ~name.startswith(".") & ~name.contains("_cut") & ~hidden


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """S-08: path, size and time of the media files under a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    return found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).filter(is_media(F.col("path")))


def new_files(found: DataFrame, *known: DataFrame) -> DataFrame:
    """X-07: files whose path, in one spelling, is in none of the known tables."""
    out = found.withColumn("key", path_key(F.col("path")))
    for other in known:
        out = out.join(other.select(path_key(F.col("path")).alias("key")), "key", "left_anti")
    return out.drop("key")


def upsert_cells(sheet: DataFrame, updates: DataFrame) -> DataFrame:
    """S-10: a sheet (row, cuts, note) with the cells of updates that are not null; rows below 1 are ignored.

    Of several updates of a cell the last one by ``seq`` counts.
    """
    valid = updates.filter("row >= 1")
    latest = valid.groupBy("row").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in ("cuts", "note")])
    joined = sheet.join(latest, "row", "full_outer")
    rest = [c for c in sheet.columns if c not in ("row", "cuts", "note")]
    return joined.select("row", F.coalesce("new_cuts", "cuts").alias("cuts"), F.coalesce("new_note", "note").alias("note"), *rest)


def append_texts(sheet: DataFrame, updates: DataFrame) -> DataFrame:
    """S-11: transcripts (id, link, text, seq) into a sheet (row, id, link, text), one row per video.

    A known id keeps its first row; new ones follow after the last row in order of ``seq``, after a heading in
    row 1 where the sheet is empty. Of several updates of an id the last counts.
    """
    latest = updates.groupBy("id").agg(F.max_by("link", "seq").alias("new_link"), F.max_by("text", "seq").alias("new_text"), F.min("seq").alias("first_seq"))
    owners = sheet.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("row").alias("row")).withColumn("owns", F.lit(True))
    kept = sheet.join(owners, ["id", "row"], "left").join(latest, "id", "left")
    mine = F.col("owns") & F.col("new_text").isNotNull()
    old = kept.select("row", "id", F.when(mine, F.col("new_link")).otherwise(F.col("link")).alias("link"), F.when(mine, F.col("new_text")).otherwise(F.col("text")).alias("text"))
    added = latest.join(owners, "id", "left_anti")
    last = F.broadcast(sheet.agg(F.coalesce(F.max("row"), F.lit(1)).alias("last"), F.count("*").alias("n")))
    new = numbered(added, ["first_seq"]).crossJoin(last)  # one row
    new = new.select((F.col("last") + F.col("no")).cast("int").alias("row"), "id", F.col("new_link").alias("link"), F.col("new_text").alias("text"))
    heading = last.filter("n = 0").select(F.lit(1).alias("row"), F.lit(None).cast("string").alias("id"), F.lit("Ссылка").alias("link"), F.lit("Расшифровка").alias("text"))
    return old.unionByName(new).unionByName(heading)


def compact(sheet: DataFrame, cells: list[str]) -> DataFrame:
    """S-12: rows whose cells are not all blank, renumbered in order; adds ``new_row``."""
    filled = F.trim(F.concat_ws("", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells])) != ""
    return numbered(sheet.filter(filled), ["row"], name="new_row")


def in_batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """X-04: adds ``batch``, ``size`` rows each, in order."""
    return numbered(rows, [order]).withColumn("batch", F.floor((F.col("no") - 1) / size)).drop("no")


def write_links(links: DataFrame, folder: str) -> None:
    """S-13: links, one per line, CRLF, ordered by row."""
    links.orderBy("row").select("link").write.mode("overwrite").option("lineSep", "\r\n").text(folder)


REPORT = ("Файл", "Строка", "Длительность", "Таймкоды для вырезки", "Акцент", "Тема", "Вырезанный файл", "Путь")


def report(items: DataFrame) -> DataFrame:
    """S-14: the eight columns of the report.

    ``items``: path, row, duration_s, edited, timecodes, accent, accent_share, medical, has_cut, output.
    """
    from ..functions.timecodes import fmt_time

    accent = F.when(F.col("accent").isNotNull(), F.format_string("%s %d%%", F.col("accent"), F.bround(F.col("accent_share") * 100, 0).cast("int"))).otherwise("")
    topic = F.when(F.col("medical").isNull(), "").when(F.col("medical"), "медицинская").otherwise("проверить")
    values = [
        F.regexp_replace("path", "^.*/", ""),
        F.coalesce(F.col("row").cast("string"), F.lit("")),
        F.coalesce(fmt_time(F.col("duration_s")), F.lit("")),
        F.coalesce("edited", "timecodes", F.lit("")),
        accent,
        topic,
        F.when(F.col("has_cut"), F.coalesce("output", F.lit("всё вырезано"))).otherwise(""),
        F.col("path"),
    ]
    return items.select(*[v.alias(n) for v, n in zip(values, REPORT, strict=True)])


def write_report(items: DataFrame, folder: str) -> None:
    """S-14: the report as CSV with a heading."""
    report(items).write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(folder)


class SessionStore:
    """S-15: states of the item table; a new one is written aside and then named, so a failed write loses nothing.

    The folder holds one sub-folder per state and a table of names; the latest complete state is read, and a
    damaged one is passed over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, items: DataFrame) -> None:
        name = f"state-{uuid.uuid4().hex}"
        items.write.parquet(f"{self.folder}/{name}")
        mark = self.spark.range(1).select(F.lit(name).alias("state"), F.current_timestamp().alias("saved"))
        mark.coalesce(1).write.mode("append").parquet(f"{self.folder}/saved")

    def load(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            marks = self.spark.read.parquet(f"{self.folder}/saved").orderBy(F.desc("saved")).limit(20).collect()
        except AnalysisException:
            return None
        for mark in marks:
            try:
                return self.spark.read.parquet(f"{self.folder}/{mark['state']}")
            except AnalysisException:
                continue
        return None


def refresh_cache(cache: DataFrame, wanted: DataFrame, fetch: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """S-17: a cache (id, title, len_s, ok) with what ``fetch`` finds for ids that it lacks or that failed.

    ``fetch`` maps frames with a column id to frames of the cache's columns, many partitions at once; a length
    that is known is kept when a refreshed row has none.
    """
    missing = wanted.select("id").distinct().join(cache.filter("ok").select("id"), "id", "left_anti")
    fetched = missing.mapInPandas(fetch, cache.schema)
    old = cache.select("id", *[F.col(c).alias(f"old_{c}") for c in cache.columns if c != "id"])
    merged = fetched.join(old, "id", "full_outer")
    return merged.select("id", *[F.coalesce(c, f"old_{c}").alias(c) for c in cache.columns if c != "id"])


def infer(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """M-01 to M-08: a model as a function of batches. ``load`` runs once per Python worker and gives the model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)

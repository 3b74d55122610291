"""Model tables derived from general tables: recordings, segments, music, frames, words, catalogue rows.

They stand in for the outputs of speech, music and language models, which enter this engine as tables. Every
rule is deterministic and has a twin in SQL (``lectern.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.intervals import KEY, coalesce_segments
from ..session import table

LENGTH = 900.0


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred events make a recording: times are stretched to 900 s, values are lengths."""
    events = table(spark, sf_dir, "events").select(F.expr("event_id div 100").alias(KEY), micros(F.col("ts")).alias("us"), "value").filter(F.col(KEY).isNotNull())
    own = Window.partitionBy(KEY)
    low, high = F.min("us").over(own), F.max("us").over(own)
    span = F.nullif((high - low).cast("double"), F.lit(0.0))
    start = F.coalesce((F.col("us") - low).cast("double") / span, F.lit(0.0)) * LENGTH
    return events.select(KEY, start.alias("start_s"), "value").select(KEY, "start_s", (F.col("start_s") + F.col("value") / 20).alias("end_s"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalesce_segments(raw_segments(spark, sf_dir))


def recordings(segs: DataFrame) -> DataFrame:
    return segs.groupBy(KEY).agg(F.greatest(F.lit(LENGTH + 5), F.max("end_s")).alias("duration_s"))


def music(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen embeddings of 64 numbers make 896 seconds of music probabilities, with clear music for 12 s of every 97."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    sec = (F.col("vec_id") % 14) * 64 + F.col("i")
    clear = F.when(sec % 97 < 12, F.lit(0.35)).otherwise(F.lit(0.0))
    return rows.select(F.expr("vec_id div 14").alias(KEY), sec.cast("int").alias("sec"), (F.abs(F.col("v").cast("double")) + clear).alias("prob"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as frames of 0.6 s with levels from the discount; 375 orders make a recording of about 900 s."""
    items = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 375").alias(KEY), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    order = Window.partitionBy(KEY).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    power = F.col("l_discount") * F.col("l_discount")
    return items.select(KEY, ((F.row_number().over(order) - 1) * F.lit(0.6)).alias("t_s"), F.round(20 * F.log10(F.col("l_discount") + 1e-9), 6).alias("db"), power.alias("power"))


def words(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Documents as word streams: a word every 0.4 s, a second more for each line break before it; ``of``: only of these recordings."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(KEY), "text")
    docs = docs if of is None else docs.join(of.select(KEY).distinct(), KEY, "left_semi")
    rows = docs.select(KEY, F.posexplode(F.split("text", "\n")).alias("line", "t"))
    parts = rows.select(KEY, "line", F.posexplode(F.filter(F.split("t", "[ \t\r]+"), lambda w: w != "")).alias("k", "word"))
    no = F.row_number().over(Window.partitionBy(KEY).orderBy("line", "k")) - 1
    start = 0.5 + 0.4 * no + 1.0 * F.col("line")
    return parts.select(KEY, no.alias("word_no"), start.alias("start_s"), (start + 0.3).alias("end_s"), "word")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word streams of ``words`` as one row of arrays per document that has words."""
    parts = lambda t: F.array_remove(F.split(t, "[ \t\r]+"), "")
    lines = F.split("text", "\n")
    of_line = F.flatten(F.transform(lines, lambda t, line: F.array_repeat(line, F.size(parts(t)))))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(KEY), F.flatten(F.transform(lines, parts)).alias("words"), of_line.alias("lines")).filter(F.size("words") > 0)
    rows = rows.select(KEY, "words", F.transform("lines", lambda line, no: 0.5 + 0.4 * no + 1.0 * line).alias("starts"))
    rows = rows.select(KEY, "words", "starts", F.transform("starts", lambda s: s + 0.3).alias("ends"))
    return rows.withColumn("duration_s", F.element_at("ends", -1) + 2.0)


def word_recordings(stream: DataFrame) -> DataFrame:
    return stream.groupBy(KEY).agg((F.max("end_s") + 2.0).alias("duration_s"))


def accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as chunks of a recording, their language as the accent label."""
    docs = table(spark, sf_dir, "documents").filter(F.col("lang").isNotNull())
    start = F.col("doc_id").cast("double") * 8
    return docs.select(F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias(KEY), F.col("doc_id").alias("chunk"), start.alias("start_s"), (start + 8).alias("end_s"), F.col("lang").alias("label"))


def voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty embeddings make a recording of 1.5-s pieces."""
    rows = table(spark, sf_dir, "embeddings").withColumn("piece", (F.col("vec_id") % 50).cast("int"))
    start = F.col("piece") * 1.5
    return rows.select(F.expr("vec_id div 50").alias(KEY), "piece", start.alias("start_s"), (start + 1.5).alias("end_s"), F.col("embedding").alias("vec"), ((F.col("label") % 2) + 1).alias("label"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as catalogue rows: the id from the page's title, cells and colours from labels of equal number."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    title = F.substring(F.regexp_extract("html", "<title>([^<]*)</title>", 1), 1, 12)
    joined = pages.join(labels, "page_id", "left")
    return joined.select(
        (F.col("page_id") + 2).cast("int").alias("row"),
        F.right(F.md5(title), F.lit(11)).alias("id"),
        F.col("url").alias("link"),
        F.when((F.col("quality") == 1) & (F.col("page_id") % 3 == 0), "0:10-0:20").otherwise("").alias("cuts"),
        F.when((F.col("quality") == 0) & (F.col("page_id") % 5 == 0), "?").otherwise("").alias("note"),
        F.when(F.col("toxic") == 1, F.array(F.lit("#cc3333"))).otherwise(F.array().cast("array<string>")).alias("bg"),
        F.when(F.col("page_id") % 17 == 0, "#ff0000").otherwise("#000000").alias("fg"),
    )


def _page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), (F.length(html) / 10.0).alias("len_s"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as videos with their whole titles."""
    return _page_titles(spark, sf_dir).select(F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("id"), (F.col("page_id") + 2).cast("int").alias("row"), "title", "len_s")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files for each page: its whole title, the title after a number, and before a number in brackets."""
    rows = _page_titles(spark, sf_dir)
    title = F.translate("title", "/\\.", "   ")
    number = (F.col("page_id") % 900 + 1).cast("string")
    names = F.array(title, F.concat(number, F.lit(". "), title), F.concat(title, F.lit(" ("), number, F.lit(")")))
    return rows.select(F.explode(names).alias("name"), F.col("len_s").alias("duration_s")).select(F.concat(F.lit("/media/"), F.col("name"), F.lit(".m4a")).alias("path"), "duration_s")


def item_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of items from all events: a user is an item, an hour a second, the kind of event and its value the fact."""
    value = F.col("value")
    kinds = {"view": F.lit("row"), "click": F.when(value < 15, "found").otherwise("music"), "signup": F.lit("analysed"), "purchase": F.lit("cut"), "error": F.lit("failed")}
    kind, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for event, fact in kinds.items():
        kind = F.when(F.col("event_type") == event, fact).otherwise(kind)
    for event, limit in {"view": 5, "signup": 10, "error": 150}.items():
        flag = F.when(F.col("event_type") == event, value > limit if event != "error" else value < limit).otherwise(flag)
    flag = F.when((F.col("event_type") == "view") & (value > 60), None).otherwise(flag)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600)).cast("long").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), flag.alias("flag")
    )

"""Benchmark decontamination through a positional inverted index.

Test items are cut into windows of ten words (an item of fewer words is one window). A count of the test
terms over all training texts tells for each different window its two rarest words, its *anchors*, with their
places. The postings (text, position) of anchor terms are the part of the index that a search from the rarest
terms reads. Intersecting them by offset, that is joining pairs of postings that stand within a window's
width in a text with the pairs of anchors of the same two terms and the same distance, gives the places where
a window may begin; a place is kept once, however many windows ask for it. Comparing the words at these places
with all windows gives the exact matches. ``proximity_matches`` finds items whose rarest terms stand close
together without being a phrase.

Postings, places and spots are rows of their own until they are gathered per text, as pieces of its own
positions, so nothing grows with the length of items or with how often their words repeat. Tables are
broadcast only up to ``BROADCAST_BYTES`` of summed size; otherwise Spark shuffles.

Words: A to Z lower-cased, then runs of characters outside ASCII punctuation, space and control characters.
Defined results: a null or empty text has no words, an item without words has no window; repeated rows are
judged one by one, also with equal or null doc_id; equal items count by their item_id; empty tables give an
empty result, or one without hits; columns other than doc_id, item_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

WINDOW_WORDS = 10
BROADCAST_BYTES = 16_000_000
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | Column = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def _light(df: DataFrame) -> DataFrame:
    """``df``, which has been written, with a broadcast hint if its summed size is small."""
    sizes = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) if f.dataType.typeName() in ("string", "array") else F.lit(16) for f in df.schema.fields]
    size = df.agg(F.sum(sum(sizes, F.lit(48)).cast("long")).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _row_key() -> Column:
    """96 bits of a row; rows of equal doc_id and text are equal."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.struct(F.xxhash64("doc_id", text).alias("x"), F.hash(text, F.lit(1), "doc_id").alias("y"))


def _item_words(benchmark: DataFrame) -> DataFrame:
    """item_id and words of each different item with words."""
    return benchmark.select("item_id", words_of().alias("item_words")).filter(F.size("item_words") > 0).distinct()


def _windows(items: DataFrame) -> DataFrame:
    """item_id and phrase, the words of a window joined by spaces, once for each item."""
    n = F.size("item_words")
    width = F.least(n, F.lit(WINDOW_WORDS))
    phrases = F.transform(F.sequence(F.lit(1), n - width + 1), lambda at: F.array_join(F.slice("item_words", at, width), " "))
    return items.select("item_id", F.explode(F.array_distinct(phrases)).alias("phrase"))


def _rarity(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each test term stands in the training texts."""
    counts = docs.select(F.explode(words_of()).alias("term")).join(_light(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counts, "term", "left").fillna(0, "n")


def _anchors(phrases: DataFrame, rarity: DataFrame) -> DataFrame:
    """a, b, gap, at, width: the two rarest words of a window in its order, how far apart, where the first stands.

    A window of one word has itself twice, with gap 0.
    """
    placed = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("at", "term")).join(rarity, "term")
    two = F.array_sort(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "at"))), 1, 2), lambda t: F.struct(t["at"].alias("at"), t["term"].alias("term"))))
    first, last = F.col("two")[0], F.element_at("two", -1)
    made = placed.groupBy("phrase").agg(two.alias("two"), F.count("*").cast("int").alias("width"))
    return made.select(first["term"].alias("a"), last["term"].alias("b"), (last["at"] - first["at"]).alias("gap"), first["at"].alias("at"), "width").distinct()


def places(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """row, places: for each row the different (start, width) at which the anchors of some window stand."""
    terms = stored(anchors.select(F.explode(F.array("a", "b")).alias("term")).distinct())
    postings = docs.select(_row_key().alias("row"), F.posexplode(words_of()).alias("pos", "term")).join(_light(terms), "term")
    # gathered as a set, so that many copies of one row are one before they are shuffled
    listed = postings.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("pos", F.xxhash64("term").alias("term")))).alias("list"))
    following = lambda x, i: F.filter(F.slice("list", i + 1, WINDOW_WORDS), lambda y: y["pos"] - x["pos"] < WINDOW_WORDS)
    pairs = F.flatten(
        F.transform("list", lambda x, i: F.transform(following(x, i), lambda y: F.struct(x["term"].alias("a"), y["term"].alias("b"), (y["pos"] - x["pos"]).alias("gap"), x["pos"].alias("pos"))))
    )
    pairs = listed.select("row", F.explode(pairs).alias("p")).select("row", "p.*")
    hashed = stored(anchors.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), "gap", "at", "width").distinct())
    found = pairs.join(_light(hashed), ["a", "b", "gap"]).select("row", F.struct((F.col("pos") - F.col("at")).alias("start"), "width").alias("place"))
    return found.filter(F.col("place.start") >= 0).groupBy("row").agg(F.collect_set("place").alias("places"))


def window_places(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows``: row, doc_id, n_words of every row; ``spots``: row, start, width, phrase of the windows that stand in a
    row; ``windows``: item_id, phrase.

    All are written; equal rows share their spots. A spot is one row, however many items have its window.
    """
    windows = stored(_windows(_item_words(benchmark)))
    phrases = stored(windows.select("phrase").distinct())
    terms = stored(phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct())
    anchors = stored(_anchors(phrases, _rarity(docs, terms)))
    asked = stored(places(docs, anchors))
    joined = docs.select("doc_id", "text", _row_key().alias("row")).join(_light(asked), "row", "left").select("row", "doc_id", "places", words_of().alias("words"))
    n = F.size("words")
    held = F.transform(
        F.filter("places", lambda p: p["start"] + p["width"] <= n),
        lambda p: F.struct(p["start"].alias("start"), p["width"].alias("width"), F.array_join(F.slice("words", p["start"] + 1, p["width"]), " ").alias("phrase")),
    )
    rows = stored(joined.select("row", "doc_id", n.cast("long").alias("n_words"), held.alias("held")))
    spread = rows.filter(F.size("held") > 0).dropDuplicates(["row"]).select("row", F.explode("held").alias("h")).select("row", "h.*")
    spots = stored(spread.join(_light(phrases), "phrase").select("row", "start", "width", "phrase"))
    return rows.drop("held"), spots, windows


def exact_matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` of ``window_places`` and ``matches``: row, start, width, item_id, a row for each spot and item, as asked."""
    rows, spots, windows = window_places(docs, benchmark)
    return rows, spots.join(_light(windows), "phrase").select("row", "start", "width", "item_id")


def items_of(spots: DataFrame, windows: DataFrame) -> DataFrame:
    """row, item_id, once each: a window counts once a row before it meets the items that have it."""
    once = spots.select("row", "phrase").distinct()
    return once.join(_light(windows), "phrase").select("row", "item_id").distinct()


def _covered(stretches: Column) -> Column:
    """How many positions a sorted array of (start, width) covers."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, s: Column) -> Column:
        end = s["start"] + s["width"]
        new = F.greatest(end - F.greatest(s["start"], state["end"]), F.lit(0))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + new).alias("n"))

    return F.aggregate(stretches, zero, step, lambda state: state["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    rows, spots, windows = window_places(docs.select("doc_id", "text"), benchmark)
    hit = spots.groupBy("row").agg(_covered(F.array_sort(F.collect_set(F.struct("start", "width")))).alias("n_hit"))
    ids = F.array_sort(F.collect_list(F.col("item_id").cast("string")))
    named = items_of(spots, windows).groupBy("row").agg(ids.alias("ids"))
    named = named.select("row", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"))
    found = stored(hit.join(named, "row"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return rows.join(_light(found), "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    _, spots, _ = window_places(docs.select("doc_id", "text"), benchmark)
    leaks = stored(spots.select(F.col("row.x").alias("x"), F.col("row.y").alias("y")).distinct())
    # all columns ride in one struct, so that none can clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _row_key().alias("row")).select("doc", "row.x", "row.y")
    return whole.join(_light(leaks), ["x", "y"], "left_anti").select("doc.*")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, terms: int = 4, span: int = 20) -> DataFrame:
    """doc_id, item_id, at: positions where the ``terms`` rarest different terms of an item end within ``span`` words."""
    items = stored(_item_words(benchmark).select(F.xxhash64("item_id", "item_words").alias("item"), "item_id", "item_words"))
    rarity = stored(_rarity(docs, stored(items.select(F.explode("item_words").alias("term")).distinct())))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "term"))
    rare = (
        items.select("item", "item_id", F.explode(F.array_distinct("item_words")).alias("term"))
        .join(rarity, "term")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= terms)
        .select("item", "item_id", "term", "rank")
    )
    rare = stored(rare)
    needed = stored(rare.groupBy("item").agg(F.max("rank").alias("needed")))
    postings = docs.select(_row_key().alias("row"), "doc_id", F.posexplode(words_of()).alias("pos", "term"))
    near = Window.partitionBy("row", "item").orderBy("pos").rangeBetween(-(span - 1), 0)
    return (
        postings.join(_light(rare), "term")
        .withColumn("seen", F.size(F.collect_set("term").over(near)))
        .join(_light(needed), "item")
        .filter(F.col("seen") == F.col("needed"))
        .select("doc_id", "item_id", F.col("pos").alias("at"))
    )

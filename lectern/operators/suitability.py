"""Verdicts on recordings: P-04, P-05, P-08, O-06, O-07, F-24."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import BRITISH, DEFAULTS, MUSIC_NOTE, NOT_BRITISH, NOT_CONVERSATION, NOT_MEDICAL, Settings


def encounter(density: Column, lecture: Column, st: Settings = DEFAULTS) -> Column:
    """P-05: enough phrases of an encounter, and more than of a lecture."""
    return F.coalesce((density >= st.encounter_min) & (density > lecture), F.lit(False))


def suitability(check_dialogue: bool = True, notes: dict[str, str] | None = None, st: Settings = DEFAULTS) -> Column:
    """P-04: why a recording does not fit, in order; empty: it fits; null: not checked.

    Columns: dialogue_done, conversation, encounter, lecture, topic_done, medical, accent_top, music_share.
    """
    done = F.coalesce("dialogue_done", F.lit(False))
    talk = F.when(F.lit(check_dialogue) & F.coalesce(F.col("conversation") == F.lit(False), F.lit(False)) & ~encounter(F.col("encounter"), F.col("lecture"), st), NOT_CONVERSATION)
    topic = F.when(F.col("topic_done") & (F.col("medical") == F.lit(False)), NOT_MEDICAL)
    top = F.nullif(F.coalesce("accent_top", F.lit("")), F.lit(""))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in (notes or {"": NOT_BRITISH}).items() for x in pair]), top)
    accent = F.when(top != BRITISH, F.coalesce(named, F.lit(NOT_BRITISH)))
    music = F.when(F.coalesce("music_share", F.lit(0.0)) >= st.unfit_music_share, MUSIC_NOTE)
    why = F.array_compact(F.array(talk, topic, accent, music))
    if check_dialogue:
        return F.when(done, why)
    unchecked = (F.size(why) == 0) & ~F.coalesce("topic_done", F.lit(False)) & top.isNull()
    return F.when(~unchecked, why)


def cut_all_buckets(items: DataFrame, st: Settings = DEFAULTS, has_sheet: bool = True) -> DataFrame:
    """O-06: the bucket of every item: pending, skipped, outside, bad, no_row, unchecked, unfit, noted, todo.

    Columns: analysed, is_done, skip, inside (three-valued), cut_error, row, needs_words, why, noted.
    """
    bucket = F.when(~F.col("analysed") | F.col("is_done"), "pending").when(F.col("skip").isNotNull(), "skipped").when(F.col("inside") == F.lit(False), "outside").when(F.col("cut_error").isNotNull(), "bad")
    if has_sheet:
        bucket = bucket.when(F.col("row").isNull(), "no_row")
    bucket = bucket.when(F.col("needs_words"), "unchecked")
    if st.only_suitable:
        if st.dialogue:
            bucket = bucket.when(F.col("why").isNull(), "unchecked")
        bucket = bucket.when((F.size("why") > 0) & F.col("noted"), "noted").when(F.size("why") > 0, "unfit")
    return items.withColumn("bucket", bucket.otherwise("todo"))


def unfit_notes(items: DataFrame) -> DataFrame:
    """O-07: items of the bucket ``unfit`` with what their note says; their cut list goes along (see sheet_updates)."""
    return items.filter(F.col("bucket") == "unfit").withColumn("note", F.array_join("why", " + "))


def unwritten(items: DataFrame) -> DataFrame:
    """O-07: cut items whose sheet write failed or never happened; their text is written again without a new cut."""
    written = F.coalesce(F.col("sheet") == "записано", F.lit(False))
    return items.filter(F.col("has_cut") & F.col("row").isNotNull() & ~written)


def needs_words(done_list: Column, wanted: list[str], done_whole: Column, whole: bool) -> Column:
    """P-08: analysed, not cut, not skipped, not edited by hand, and searched for other words."""
    target = F.array(*[F.lit(w) for w in wanted]).cast("array<string>")
    done = F.coalesce(done_list, F.array().cast("array<string>")) == target
    if wanted:
        done = done & F.coalesce(done_whole == F.lit(whole), F.lit(False))
    return F.col("analysed") & ~F.col("has_cut") & F.col("skip").isNull() & F.col("edited").isNull() & ~done

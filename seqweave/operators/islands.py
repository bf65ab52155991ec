"""Splits of ordered rows: a flag on a row says that a new run begins there, a running sum numbers the runs.

Every split of one table uses the window (key, pos), so Spark plans one exchange and one sort for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import COMMA, SENTENCE_ENDERS, SENTENCE_GAP, SPLIT_GAP, STARTER_POS


def over(key: Sequence[str], order: Sequence[str] = ("pos",)):
    return W.partitionBy(*key).orderBy(*order)


def clustered(df: DataFrame, key: Sequence[str], order: Sequence[str] = ("pos",)) -> DataFrame:
    """Rows of a key together and in order, with a last column __n that numbers them.

    A window asks for that distribution, so no exchange is added where the rows have it already, as after a
    split over the same key; an explicit repartition would always move them.
    """
    return df.withColumn("__n", F.row_number().over(over(key, order)))


def label_runs(df: DataFrame, breaks: Column, key: Sequence[str], label: str, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Number runs from 0; ``breaks`` is looked at on every row but the first of its key."""
    flag = F.when(F.row_number().over(over(key, order)) > 1, F.coalesce(breaks, F.lit(False))).otherwise(F.lit(False))
    return df.withColumn("__new", flag.cast("int")).withColumn(label, F.sum("__new").over(over(key, order)).cast("int")).drop("__new")


def before(column: str, key: Sequence[str], order: Sequence[str] = ("pos",)) -> Column:
    return F.lag(column).over(over(key, order))


def last_char_in(text: Column, marks: str) -> Column:
    """Whether the last character is one of ``marks``; false for null and empty texts."""
    return F.coalesce((F.length(text) > 0) & (F.instr(F.lit(marks), F.right(text, F.lit(1))) > 0), F.lit(False))


def gap(key: Sequence[str], order: Sequence[str] = ("pos",)) -> Column:
    """Time from the end of the row before, negative where they overlap."""
    return F.col("start") - before("end", key, order)


def speaker_change(key: Sequence[str], speaker: str = "speaker", order: Sequence[str] = ("pos",)) -> Column:
    return ~F.col(speaker).eqNullSafe(before(speaker, key, order))


def speaker_runs(df: DataFrame, key: Sequence[str], speaker: str = "speaker", order: Sequence[str] = ("pos",), label: str = "run_id") -> DataFrame:
    return label_runs(df, speaker_change(key, speaker, order), key, label, order)


def sentences(df: DataFrame, key: Sequence[str], enders: str = SENTENCE_ENDERS, label: str = "sentence_id") -> DataFrame:
    """The mark stays with the sentence that it ends; a full stop of the Latin script is none by default."""
    return label_runs(df, last_char_in(before("text", key), enders), key, label)


def segments(df: DataFrame, key: Sequence[str], least_gap=SPLIT_GAP, enders: str = SENTENCE_ENDERS, comma: str = COMMA, label: str = "segment_id") -> DataFrame:
    """Smallest pieces: cut at speakers, pauses, sentence marks, commas and clause ends."""
    clause = F.coalesce(before("ends_clause", key), F.lit(False)) if "ends_clause" in df.columns else F.lit(False)
    breaks = speaker_change(key) | (gap(key) >= least_gap) | last_char_in(before("text", key), enders + comma + ("," if comma == COMMA else "")) | clause
    return label_runs(df, breaks, key, label)


def summary_sentences(df: DataFrame, key: Sequence[str], least_gap=SENTENCE_GAP, enders: str = SENTENCE_ENDERS, label: str = "sentence_id") -> DataFrame:
    """Sentences for summaries: a speaker that wasn't known before makes no cut; a token's last character may end one."""
    known = before("speaker", key).isNotNull()
    breaks = (known & speaker_change(key)) | (gap(key) >= least_gap) | last_char_in(before("text", key), enders)
    return label_runs(df, breaks, key, label)


def gap_sessions(df: DataFrame, key: Sequence[str], time: str, least, order: Sequence[str]) -> DataFrame:
    """Runs without a pause of ``least`` or more between neighbours."""
    return label_runs(df, F.col(time) - before(time, key, order) >= least, key, "session_id", order)


def phrases(morphemes: DataFrame, key: Sequence[str], starters: Sequence[str] = STARTER_POS, prefix: str = "接頭辞", label: str = "phrase_id") -> DataFrame:
    """Phrase units from morphemes: content words begin one, and a prefix begins one that its word joins."""
    is_prefix = F.col("pos1") == prefix
    breaks = is_prefix | (F.col("pos1").isin(*starters) & ~F.coalesce(before("pos1", key) == prefix, F.lit(False)))
    return label_runs(morphemes, breaks, key, label)


def ends_clause(morphs: Column, particles: Sequence[str]) -> Column:
    """Whether a phrase's morphemes (surface, pos1) end a clause; a mark at the end is looked past."""

    def closes(m):
        return (m["pos1"] == "助動詞") | ((m["pos1"] == "助詞") & m["surface"].isin(*particles))

    last, second = F.try_element_at(morphs, F.lit(-1)), F.try_element_at(morphs, F.lit(-2))
    return F.coalesce(closes(last), F.lit(False)) | F.coalesce(last["pos1"].isin("補助記号", "記号") & closes(second), F.lit(False))


def text_of(pos: str = "pos", text: str = "text") -> Column:
    """Aggregate: texts in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), "")


def spaced_text_of(pos: str = "pos", text: str = "text") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), " ")


def summarise(df: DataFrame, key: Sequence[str], joiner: Column | None = None) -> DataFrame:
    """One row for each run: text, start, end, speaker of the first row, chars, tokens, units. Ends go by position, not by value."""
    tokens = [F.sum("morph_count").cast("long").alias("tokens")] if "morph_count" in df.columns else []
    return df.groupBy(*key).agg(
        (joiner if joiner is not None else text_of()).alias("text"), F.min("pos").alias("first_pos"), F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"),
        F.min_by("speaker", "pos").alias("speaker"), F.countDistinct("speaker").alias("n_speakers"), F.sum(F.length("text")).cast("long").alias("chars"), F.count(F.lit(1)).alias("units"), *tokens,
    )


def linger(key: Sequence[str], by=0.5, order: Sequence[str] = ("pos",)) -> Column:
    """A cue's shown end: longer by ``by`` but not into the next cue."""
    return F.least(F.col("end") + by, F.lead("start").over(over(key, order)))

"""Whole paths from a transcript's words to its cues, composed of the single operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..schema import LINE_CHARS
from ..sources.files import characters
from . import folds, islands, pairing

ID = ["transcript_id"]
PARTICLES = "て で ば から ので けど けれど けれども が と たら なら し のに ながら ても でも".split()
_MORPHEME = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("surface", "pos1", "pos2")]))


def plain_tokenizer(text: str) -> list[tuple[str, str, str]]:
    """Stands in where no dictionary is at hand: runs of one class of characters. Not the same as a real one."""
    out: list[list[str]] = []
    for c in text:
        kind = "空白" if c.isspace() else "補助記号" if not c.isalnum() else "助詞" if "぀" <= c <= "ゟ" else "名詞"
        if out and out[-1][1] == kind and kind != "補助記号":
            out[-1][0] += c
        else:
            out.append([c, kind, ""])
    return [tuple(m) for m in out]


def units(words: DataFrame, tokenizer: Callable[[str], Sequence[tuple[str, str, str]]] = plain_tokenizer, particles: Sequence[str] = tuple(PARTICLES)) -> DataFrame:
    """Phrase units of each transcript: speakers, then sentences, are split before the tokenizer sees one sentence."""
    chars = characters(words)
    w = islands.over(ID, ("pos", "sub"))
    chars = chars.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).drop("sub")
    breaks = islands.speaker_change(ID) | islands.last_char_in(islands.before("text", ID), "。！？!?")
    chars = islands.label_runs(chars, breaks, ID, "sentence_id")
    sent = chars.groupBy(*ID, "sentence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", "start", "end", "speaker"))), lambda x: x).alias("c"))

    @F.pandas_udf(_MORPHEME)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"surface": s, "pos1": a, "pos2": b} for s, a, b in tokenizer(t)])

    sent = sent.withColumn("m", cut(F.array_join(F.transform("c", lambda x: x["text"]), "")))
    m = sent.select(*ID, "sentence_id", "c", F.posexplode("m").alias("i", "m"))
    sized = m.withColumn("n", F.length("m.surface"))
    from_char = F.coalesce(F.sum("n").over(islands.over([*ID, "sentence_id"], ("i",)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    sized = sized.withColumn("at", from_char).withColumn("own", F.slice("c", F.col("at") + 1, F.col("n"))).where("size(own) > 0")
    sized = sized.select(*ID, "sentence_id", F.col("i").alias("pos"), "own", F.struct("m.surface", "m.pos1").alias("m"), "m.pos1")
    labelled = islands.phrases(sized, [*ID, "sentence_id"])
    first = labelled.groupBy(*ID, "sentence_id", "phrase_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m", "own"))).alias("p"))
    morphs = F.transform("p", lambda x: x["m"])
    own = F.flatten(F.transform("p", lambda x: x["own"]))
    out = first.select(*ID, own.alias("o"), islands.ends_clause(morphs, particles).alias("ends_clause"), F.size("p").alias("morph_count"))
    out = out.select(*ID, F.col("o")[0]["pos"].alias("at"), F.array_join(F.transform("o", lambda x: x["text"]), "").alias("text"), F.col("o")[0]["start"].alias("start"), F.element_at("o", -1)["end"].alias("end"), F.col("o")[0]["speaker"].alias("speaker"), "ends_clause", "morph_count")
    pos = (F.row_number().over(islands.over(ID, ("at",))) - 1).cast("int")
    return out.withColumn("pos", pos).select(*ID, "pos", "text", "start", "end", "speaker", "ends_clause", "morph_count")


def watch_cues(u: DataFrame, limit: int = LINE_CHARS, stop: str = "。") -> DataFrame:
    """Units with cue_id and line_no for watching: small pieces, packed into lines, paired and balanced."""
    u = folds.merge_tiny_segments(islands.segments(u, ID), ID, stop=stop)
    segs = islands.summarise(u, [*ID, "segment_id"])
    packed = folds.line_packing(segs, ID, limit, stop=stop)
    lines = packed.groupBy(*ID, "line_id").agg(F.sum("chars").alias("chars"), F.min_by("start", "segment_id").alias("start"), F.max_by("end", "segment_id").alias("end"), F.min_by("speaker", "segment_id").alias("speaker"))
    paired = pairing.pair_lines(lines, ID, limit)
    single = F.count(F.lit(1)).over(islands.over([*ID, "cue_id"], ("line_id",)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == 1
    cues = paired.withColumn("__single", single).select(*ID, "line_id", "cue_id", "nth", "cut", "__single")
    u = u.join(packed.select(*ID, "segment_id", "line_id"), [*ID, "segment_id"]).join(cues, [*ID, "line_id"])
    u = pairing.split_at_stop(pairing.balanced_split(u, [*ID, "cue_id"], stop, "__half"), [*ID, "cue_id"], stop, "__stop")
    line = F.when(F.col("cut"), F.col("__half")).when(F.col("__single"), F.col("__stop")).otherwise(F.col("nth"))
    return u.withColumn("line_no", line).select(*ID, "pos", "text", "start", "end", "speaker", "morph_count", "cue_id", "line_no")


def translation_cues(u: DataFrame) -> DataFrame:
    """Units with cue_id and line_no for translation: sentences joined up to a token limit, a line for each speaker's run."""
    u = folds.sentence_cues(u, ID).withColumnRenamed("cue_id", "sentence_id")
    sent = islands.summarise(u, [*ID, "sentence_id"])
    groups = folds.token_capped_merge(sent, ID, label="cue_id", order=("sentence_id",)).select(*ID, "sentence_id", "cue_id")
    u = u.join(groups, [*ID, "sentence_id"])
    return islands.speaker_runs(u, [*ID, "cue_id"], label="line_no").select(*ID, "pos", "text", "start", "end", "speaker", "morph_count", "cue_id", "line_no")

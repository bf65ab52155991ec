"""Readers of transcripts, provider results, subtitle files and card tables. Every reader takes many files at once; a file's path is its transcript_id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators import islands
from ..schema import PROVIDER, SENTENCE_ENDERS, TRANSCRIPT


def read_transcripts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Canonical transcript documents as rows of words."""
    docs = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(paths if isinstance(paths, str) else list(paths)).withColumn("transcript_id", F.input_file_name())
    return explode_words(docs)


def explode_words(docs: DataFrame) -> DataFrame:
    w = docs.select("transcript_id", F.posexplode("words").alias("pos", "w"))
    return w.select("transcript_id", "pos", "w.text", "w.start", "w.end", "w.type", F.col("w.speaker_id").alias("speaker"), F.coalesce("w.logprob", F.lit(0.0)).alias("logprob"))


def characters(words: DataFrame) -> DataFrame:
    """Characters of spoken words with their share of the time; a word of one character keeps its own, a long mark is cut short."""
    n = F.length("text")
    c = words.where("type = 'word' and length(text) > 0").select("*", F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring("text", i, F.lit(1)))).alias("sub", "ch"))
    a, b = S.interpolate(F.col("start"), F.col("end"), F.col("sub"), n)
    single = n == 1
    return c.select("transcript_id", "pos", "sub", F.col("ch").alias("text"), F.when(single, F.col("start")).otherwise(a).alias("start"), F.when(single, S.clamp_ender(F.col("text"), F.col("start"), F.col("end"), enders=SENTENCE_ENDERS)).otherwise(b).alias("end"), "speaker")


def read_provider(spark: SparkSession, paths: str | Sequence[str], language: str = "jpn") -> DataFrame:
    docs = spark.read.schema(PROVIDER).option("multiLine", True).json(paths if isinstance(paths, str) else list(paths)).withColumn("transcript_id", F.input_file_name())
    return normalise_provider(docs, language)


def normalise_provider(docs: DataFrame, language: str = "jpn") -> DataFrame:
    """Provider tokens as canonical documents: seconds, speaker names, log-probabilities, kinds of items.

    Sounds come first, then white space, then words; leading blanks of a word become an item of no length.
    """

    def item(text, start, end, kind, speaker, logprob):
        return F.struct(text.alias("text"), F.bround(start, 3).alias("start"), F.bround(end, 3).alias("end"), F.lit(kind).alias("type"), speaker.alias("speaker_id"), F.bround(logprob, 4).alias("logprob"))

    def items(t):
        start, end = t["start_ms"] / 1000, t["end_ms"] / 1000
        speaker = F.when(t["speaker"].isNull() | (t["speaker"] == ""), F.lit("speaker_0")).otherwise(F.concat(F.lit("speaker_"), t["speaker"]))
        log = F.coalesce(S.log_confidence(t["confidence"]), F.lit(0.0))
        text = F.coalesce(t["text"], F.lit(""))
        bare = F.regexp_replace(text, f"^{S.BLANK}", "")
        word = item(bare, start, end, "word", speaker, log)
        blank = item(F.left(text, F.length(text) - F.length(bare)), start, start, "spacing", speaker, F.lit(0.0))
        return (
            F.when(t["is_audio_event"], F.array(item(text, start, end, "audio_event", speaker, log)))
            .when(S.strip(text) == "", F.array(item(text, start, end, "spacing", speaker, log)))
            .when(F.length(bare) < F.length(text), F.array(blank, word)).otherwise(F.array(word))
        )

    whole = F.array_join(F.transform("tokens", lambda t: F.coalesce(t["text"], F.lit(""))), "")
    return docs.select("transcript_id", F.lit(language).alias("language_code"), F.coalesce("text", whole).alias("text"), F.flatten(F.transform("tokens", items)).alias("words"))


def read_blocks(spark: SparkSession, paths: str | Sequence[str], validate: bool = True) -> DataFrame:
    """Subtitle files as rows of blocks; a byte-order mark and CRLF are accepted.

    With ``validate`` a block without a readable time code goes and its lines are joined by blanks; without it
    every block of two lines or more stays as written.
    """
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    return parse_blocks(raw.select(F.input_file_name().alias("transcript_id"), "value"), validate)


def parse_blocks(files: DataFrame, validate: bool = True) -> DataFrame:
    """Blocks of (transcript_id, value): parted by empty lines, a line of blanks is none; time lines are read as S.parse_times does.

    A block's lines and times come from generators: a filter on a generated column isn't moved below it, where all
    that the column is made of would be written out, and computed, once for each use.
    """
    text = F.replace(F.regexp_replace("value", "^﻿", ""), F.lit("\r\n"), F.lit("\n"))
    blocks = files.select("transcript_id", F.posexplode(F.split(S.strip(text), r"\n\n+")).alias("at", "b"))
    lines = blocks.select("transcript_id", "at", F.explode(F.array(F.split(S.strip(F.col("b")), "\n"))).alias("l")).where("size(l) >= 2")
    lines = lines.select("*", F.explode(F.array(S.line_times(F.element_at("l", 2)))).alias("times"))
    body = F.slice("l", F.lit(3), F.greatest(F.size("l") - 2, F.lit(0)))
    start, end = S.both_times(F.col("times"))
    full = F.array_join(body, "\n")
    if validate:
        full = F.array_join(F.filter(F.transform(body, S.strip), lambda x: x != ""), " ")
    d = lines.select("transcript_id", "at", S.strip(F.element_at("l", 1)).alias("index"), S.strip(F.element_at("l", 2)).alias("timecode"), start.alias("start"), end.alias("end"), full.alias("text"), F.size(body).alias("n_lines"))
    if validate:
        d = d.where("start is not null and end is not null")
    pos = (F.row_number().over(W.partitionBy("transcript_id").orderBy("at")) - 1).cast("int")
    return d.withColumn("pos", pos).select("transcript_id", "pos", "index", "timecode", "start", "end", "text", "n_lines")


def read_cards(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Card tables with a header row; several files with the same header are one table."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(paths if isinstance(paths, str) else list(paths))


def playable_cards(cards: DataFrame, media: DataFrame, file: str = "file") -> DataFrame:
    """Cards whose sound file exists, with audio and image names; the image is '' where its file is missing."""
    files = media.select(F.col(file).alias("__f")).distinct()
    d = cards.withColumn("audio", S.sound_file(F.coalesce("audioclip", F.lit("")))).where("audio <> ''").join(files.withColumnRenamed("__f", "audio"), "audio", "left_semi")
    d = d.withColumn("__image", S.image_file(F.coalesce("screenclip", F.lit(""))))
    d = d.join(files, d["__image"] == files["__f"], "left")
    return d.withColumn("image", F.when(F.col("__f").isNotNull(), F.col("__image")).otherwise("")).drop("__image", "__f")


def with_context(cards: DataFrame, prefix: str | Column) -> DataFrame:
    lead = F.lit(prefix) if isinstance(prefix, str) else prefix
    return cards.withColumn("context", F.concat(lead, F.lit(" | "), F.coalesce("context", F.lit(""))))


def repeated_inputs(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(path).count().where("count > 1")


def sentences(words: DataFrame) -> DataFrame:
    """Sentences for summaries from rows of words: transcript_id, pos, timecode, start, end, text; those of blanks alone are dropped."""
    key = ["transcript_id"]
    spoken = words.where("type = 'word'")
    runs = islands.summarise(islands.summary_sentences(spoken, key), [*key, "sentence_id"]).withColumn("text", S.strip(F.col("text"))).where("text <> ''")
    pos = (F.row_number().over(W.partitionBy(*key).orderBy("sentence_id")) - 1).cast("int")
    code = F.concat(S.rounded_timecode(F.col("start")), F.lit(" --> "), S.rounded_timecode(F.col("end")))
    return runs.withColumn("pos", pos).select(*key, "pos", code.alias("timecode"), "start", "end", "text")


def read_sentences(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Sentences of transcripts and subtitle files: a path that ends with .json is read as the first, any other as the second."""
    by_kind = {True: [p for p in paths if p.lower().endswith(".json")], False: [p for p in paths if not p.lower().endswith(".json")]}
    columns = ["transcript_id", "pos", "timecode", "start", "end", "text"]
    parts = [sentences(read_transcripts(spark, by_kind[True]))] if by_kind[True] else []
    parts += [read_blocks(spark, by_kind[False]).select(*columns)] if by_kind[False] else []
    if not parts:
        raise ValueError("no paths to read")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def preferred(files: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in ``order``, with ``n``, the number of rows it was chosen from."""
    w = W.partitionBy(*key)
    d = files.withColumn("__rn", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    return d.where("__rn = 1").drop("__rn")

"""Writers of subtitle, summary, chunk, card and view files, one folder for each transcript, written where the rows are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators.islands import linger as shown_until
from ..operators.islands import over, text_of
from ..schema import LINGER


def cue_lines(units: DataFrame, key: Sequence[str], stops: bool = True) -> DataFrame:
    """Cues from labelled units (cue_id, line_no): start, end, lines without final stops, n_speakers."""
    text = S.without_stops(text_of()) if stops else text_of()
    lines = units.groupBy(*key, "cue_id", "line_no").agg(text.alias("line"), F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.collect_set("speaker").alias("speakers"), F.min_by("speaker", "pos").alias("speaker"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("line_no", c))), lambda x: x[c])
    return lines.groupBy(*key, "cue_id").agg(
        ordered("line").alias("lines"), F.min_by("start", "line_no").alias("start"), F.max_by("end", "line_no").alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("speakers")))).alias("n_speakers"), F.min_by("speaker", "line_no").alias("speaker"),
    )


def srt_text(cues: DataFrame, key: Sequence[str], linger=LINGER) -> DataFrame:
    """The key and ``block``, ``value``: subtitle blocks numbered from 1, shown a little longer where there is room."""
    w = over(key, ("cue_id",))
    end = shown_until(key, linger, ("cue_id",))
    n = F.row_number().over(w)
    value = F.concat(n.cast("string"), F.lit("\n"), S.timecode(F.col("start")), F.lit(" --> "), S.timecode(end), F.lit("\n"), S.speaker_lines(F.col("lines"), F.col("n_speakers")), F.lit("\n"))
    return cues.select(*key, n.alias("block"), value.alias("value"))


def block_text(blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Blocks with their index and time code as read."""
    return blocks.select(*key, F.col("pos").alias("block"), F.concat(F.col("index"), F.lit("\n"), F.col("timecode"), F.lit("\n"), F.col("text"), F.lit("\n")).alias("value"))


def summary_text(topics: DataFrame, blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Summary blocks from the start of a range's first block to the end of its last one, as written there.

    A key whose ranges don't reach its last block is unfinished and raises when its rows are read.
    """
    b = blocks.select(*key, (F.col("pos") + 1).alias("__at"), "timecode")
    d = topics.join(b.select(*key, F.col("__at").alias("start"), F.substring_index("timecode", " --> ", 1).alias("__s")), [*key, "start"], "left")
    d = d.join(b.select(*key, F.col("__at").alias("end"), F.substring_index("timecode", " --> ", -1).alias("__e")), [*key, "end"], "left")
    total = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    reached = F.max("end").over(W.partitionBy(*key))
    d = d.withColumn("__reached", reached).join(total, list(key))
    value = F.concat((F.col("seq") + 1).cast("string"), F.lit("\n"), F.col("__s"), F.lit(" --> "), F.col("__e"), F.lit("\n"), F.col("summary"), F.lit("\n"))
    checked = F.when(F.col("__reached") == F.col("__n"), value).otherwise(F.raise_error(F.lit("summary isn't finished")))
    return d.select(*key, F.col("seq").alias("block"), checked.alias("value"))


def html_text(cues: DataFrame, key: Sequence[str], colours: int = 8, gap=0.4) -> DataFrame:
    """Cues as list items, coloured by each speaker's first appearance, with a mark at pauses of one speaker."""
    first = cues.groupBy(*key, "speaker").agg(F.min("cue_id").alias("__first"))
    rank = first.withColumn("colour", ((F.row_number().over(W.partitionBy(*key).orderBy("__first")) - 1) % colours).cast("int")).drop("__first")
    w = over(key, ("cue_id",))
    pause = (F.lag("speaker").over(w) == F.col("speaker")) & (F.col("start") - F.lag("end").over(w) >= gap)
    d = cues.withColumn("__pause", F.coalesce(pause, F.lit(False))).join(rank, [*key, "speaker"], "left")
    body = F.array_join(F.transform("lines", S.escape), "<br>")
    item = F.concat(F.when(F.col("__pause"), F.lit('<li class="pause"></li>\n')).otherwise(F.lit("")), F.lit('<li class="speaker'), F.col("colour").cast("string"), F.lit('"><time>'), S.clock(F.col("start")), F.lit("</time> "), body, F.lit("</li>"))
    return d.select(*key, F.col("cue_id").alias("block"), item.alias("value"))


def write_text(rows: DataFrame, path: str, key: Sequence[str], order: str = "block") -> None:
    """Rows (key, block, value) as text, one file in each key's folder, in order."""
    ordered = rows.repartition(*key).sortWithinPartitions(*key, order)
    ordered.select(*key, "value").write.mode("overwrite").partitionBy(*key).text(path)


def write_transcripts(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def write_chunks(rendered: DataFrame, chunks: DataFrame, blocks: DataFrame, path: str, key: Sequence[str]) -> None:
    """Chunk inputs as text, one folder a chunk, with the chunks' table, the blocks' index and times, and which had two lines."""
    rendered.select(*key, "chunk_id", "value").write.mode("overwrite").partitionBy(*key, "chunk_id").text(f"{path}/inputs")
    chunks.select(*key, "chunk_id", "start_block", "end_block", "num_blocks").write.mode("overwrite").json(f"{path}/chunks")
    two = F.instr(F.coalesce("text", F.lit("")), "\n") > 0
    blocks.select(*key, "pos", "index", "timecode", two.alias("two_lines")).write.mode("overwrite").json(f"{path}/metadata")
    two_line_blocks(blocks, key).write.mode("overwrite").json(f"{path}/original_line_counts")


def two_line_blocks(blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    """The places of each key's blocks of two lines or more, in order."""
    two = F.instr(F.coalesce("text", F.lit("")), "\n") > 0
    return blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(two, F.col("pos")))).alias("two_line_blocks"))


def cue_listing(cues: DataFrame, key: Sequence[str]) -> DataFrame:
    """A line for each cue to look over: number, times, length, characters, lines, speaker, texts."""
    n = F.row_number().over(over(key, ("cue_id",)))
    chars = F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x))
    value = F.format_string("Cue %4d  %8.2f-%8.2f  %5.1fs  %3dch  %dL  [%s]  %s", n, S.printed(F.col("start"), 2), S.printed(F.col("end"), 2), S.printed(F.col("end") - F.col("start"), 1), chars, F.size("lines"), F.col("speaker"), F.array_join("lines", " / "))
    return cues.select(*key, n.alias("block"), value.alias("value"))


def card_counts(cards: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """n_cards, and n_media: their sound files and images, each as often as a card shows it."""
    return cards.groupBy(*key).agg(F.count(F.lit(1)).alias("n_cards"), F.sum(F.when(F.col("image") != "", 2).otherwise(1)).cast("long").alias("n_media"))


def write_cards(cards: DataFrame, path: str) -> None:
    cards.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def notes(cards: DataFrame, deck: str) -> DataFrame:
    """Deck rows: stable ids of deck and model, and the four fields of a note; packing them is left to the caller."""
    d = F.lit(deck)
    return cards.select(S.stable_id(d).alias("deck_id"), S.stable_id(F.concat(d, F.lit("_model"))).alias("model_id"), F.concat(F.lit("[sound:"), F.col("audio"), F.lit("]")).alias("Audio"), F.when(F.col("image") != "", F.concat(F.lit('<img src="'), F.col("image"), F.lit('">'))).otherwise("").alias("Image"), F.col("text").alias("Text"), F.col("context").alias("Context"))

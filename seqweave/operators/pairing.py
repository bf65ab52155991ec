"""Cues of one or two lines: which lines pair, and where a cue is cut into two balanced lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import LINE_CHARS, MERGE_GAP
from .islands import over


def pair_lines(lines: DataFrame, key: Sequence[str], limit: int = LINE_CHARS, least_gap=MERGE_GAP, short=0.6, rate=8.0, order: Sequence[str] = ("line_id",)) -> DataFrame:
    """Adds cue_id, nth (0 or 1) and cut (the cue is to be balanced anew) to lines (chars, start, end, speaker).

    Whether a line may pair with the next depends on these two alone, so in each run of lines that may, those at even places
    are the first of a pair: no fold is needed. ``short`` is in the unit of the times, ``rate`` in characters a unit.
    """
    w = over(key, order)
    d = F.col("end") - F.col("start")
    lines = lines.withColumn("__needs", F.coalesce((d < short) | ((d > 0) & (F.col("chars") > rate * d)), F.lit(False)))
    can = (F.col("chars") <= limit) & (F.lead("chars").over(w) <= limit) & (F.col("__needs") | F.lead("__needs").over(w)) & (F.lead("start").over(w) - F.col("end") < least_gap)
    lines = lines.withColumn("__can", F.coalesce(can, F.lit(False))).withColumn("__n", F.row_number().over(w))
    # place in the run of true flags: distance to the last false one
    since = F.col("__n") - F.coalesce(F.max(F.when(~F.col("__can"), F.col("__n"))).over(w), F.lit(0)) - 1
    lines = lines.withColumn("__head", F.col("__can") & (since % 2 == 0))
    second = F.coalesce(F.lag("__head").over(w), F.lit(False))
    lines = lines.withColumn("nth", second.cast("int")).withColumn("cue_id", (F.sum(F.lit(1) - F.col("nth")).over(w) - 1).cast("int"))
    same = F.when(F.col("nth") == 1, F.lag("speaker").over(w)).otherwise(F.lead("speaker").over(w)).eqNullSafe(F.col("speaker"))
    paired = F.col("__head") | (F.col("nth") == 1)
    return lines.withColumn("cut", F.when(paired, same).otherwise(F.col("chars") > limit)).drop("__needs", "__can", "__n", "__head")


def balanced_split(units: DataFrame, key: Sequence[str], stop: str = "。", label: str = "line_no") -> DataFrame:
    """Two lines for each group of units: cut behind a stop if one stands inside, nearest to the middle; the first of equals."""
    size = F.length(F.coalesce("text", F.lit("")))
    running, whole = F.sum(size).over(over(key)), F.sum(size).over(over(key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = F.lead("pos").over(over(key)).isNull()
    place = F.when(~last, F.struct((~F.endswith(F.coalesce("text", F.lit("")), F.lit(stop))).alias("a"), F.abs(2 * running - whole).alias("b"), F.col("pos").alias("c")))
    d = units.withColumn("__place", place)
    best = F.min("__place").over(over(key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return d.withColumn(label, F.when(F.col("pos") <= best["c"], 0).when(best.isNull(), 0).otherwise(1)).drop("__place")


def split_at_stop(units: DataFrame, key: Sequence[str], stop: str = "。", label: str = "line_no") -> DataFrame:
    """Cut groups whose first stop isn't their last character behind the unit that holds it, if units remain."""
    size = F.length(F.coalesce("text", F.lit("")))
    running = F.sum(size).over(over(key))
    found = F.instr(F.coalesce("text", F.lit("")), stop)
    ends = F.when(found > 0, F.struct(F.col("pos").alias("p"), (running - size + found).alias("at")))
    d = units.withColumn("__hit", ends).withColumn("__sum", running)
    wide = over(key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, total, final = F.min("__hit").over(wide), F.max("__sum").over(wide), F.max("pos").over(wide)
    cut = first.isNotNull() & (first["at"] < total) & (first["p"] < final)
    return d.withColumn(label, F.when(F.coalesce(cut, F.lit(False)) & (F.col("pos") > first["p"]), 1).otherwise(0)).drop("__hit", "__sum")

"""Summary windows over sentences: check and repair of ranges, what a window commits, and the loop over windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.scalars import numbered, strip, without_fence
from ..schema import CORE, MANY_WINDOWS, TILE, WINDOW
from .islands import clustered


def window_estimate(n: Column, core: int = CORE) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / core)).cast("int")


def window_plan(n: Column) -> tuple[Column, Column]:
    """The number of windows to expect, and a warning where a text is long enough to be split by hand first."""
    windows = window_estimate(n)
    return windows, F.when(windows > MANY_WINDOWS, F.format_string("about %d windows; split the text", windows))


def brief(premise: Column, recent: Column, texts: Column) -> Column:
    """What a summariser is given for a window: the premise, the last ranges (start, end, summary) and the numbered sentences."""
    before = F.array_join(F.transform(recent, lambda r: F.format_string("- (sentences %d-%d) %s", r["start"], r["end"], r["summary"])), "\n")
    parts = ("[premise]", F.coalesce(premise, F.lit("(none)"))), ("[before]", F.when(F.size(recent) > 0, before).otherwise("(first window)")), ("[sentences]", numbered(texts))
    return F.concat_ws("\n", *[c for title, body in parts for c in (F.lit(title), body)])


def parse_answer(raw: Column, n: Column) -> tuple[Column, Column]:
    """Ranges (start, end, summary) of a summariser's answer in order with gaps closed, and why it can't be accepted.

    An answer is a JSON array, perhaps within a code fence, of objects with start, end and summary; one of the two
    columns is null. The reasons are looked for in the order in which they are named here.
    """
    body = without_fence(raw)
    loose = F.from_json(body, "array<struct<start:string,end:string,summary:string>>")
    strict = F.from_json(body, "array<struct<start:int,end:int,summary:string>>")
    # a value of another type makes the whole answer null in the strict reading
    missing = F.exists(loose, lambda c: c["start"].isNull() | c["end"].isNull() | c["summary"].isNull())
    typed = strict.isNotNull() & ~F.exists(strict, lambda c: c["start"].isNull() | c["end"].isNull())
    bare = F.exists(loose, lambda c: ~c["start"].rlike(r"^-?[0-9]+$") | ~c["end"].rlike(r"^-?[0-9]+$"))
    ordered = F.array_sort(strict)
    follows = F.transform(ordered, lambda c, i: F.struct(c["start"].alias("start"), F.coalesce(F.get(ordered, i - 1)["end"], F.lit(0)).alias("before"), i.alias("i")))
    problem = (
        F.when(~F.startswith(body, F.lit("[")) | loose.isNull() | (F.size(loose) <= 0) | F.exists(loose, lambda c: c.isNull()), "not an array of objects")
        .when(missing, "missing key").when(~typed | bare, "not whole numbers").when(F.exists(strict, lambda c: c["start"] > c["end"]), "reversed")
        .when(F.exists(strict, lambda c: strip(c["summary"]) == ""), "blank").when(F.try_element_at(ordered, F.lit(1))["start"] != 1, "first is not 1")
        .when(F.exists(follows, lambda c: (c["i"] > 0) & (c["start"] <= c["before"])), "overlap").when(F.try_element_at(ordered, F.lit(-1))["end"] > n, "outside")
    )
    closed = F.transform(ordered, lambda c, i: F.struct(c["start"].alias("start"), F.coalesce(F.get(ordered, i + 1)["start"] - 1, n).cast("int").alias("end"), c["summary"].alias("summary")))
    return F.when(problem.isNull(), closed), problem


def fallback_tiles(n: Column, tile: int = TILE) -> Column:
    """Ranges (start, end), from 1 and inclusive, of ``tile`` sentences each."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / tile).cast("int")), lambda i: F.struct((i * tile + 1).alias("start"), F.least((i + 1) * tile, n).cast("int").alias("end")))).otherwise(
        F.expr("cast(array() as array<struct<start:int,end:int>>)")
    )


def check_ranges(topics: DataFrame, key: Sequence[str], n: str = "n") -> DataFrame:
    """Adds ``problem``: why a summary's range can't be accepted, null where it can.

    A range needs whole numbers in order within 1 .. n, a summary that isn't blank, and must not overlap the one before.
    """
    w = W.partitionBy(*key).orderBy("start", "end")
    problem = (
        F.when(F.col("start").isNull() | F.col("end").isNull(), "not a range").when(F.col("start") > F.col("end"), "reversed")
        .when(F.trim(F.coalesce("summary", F.lit(""))) == "", "blank").when((F.col("start") < 1) | (F.col("end") > F.col(n)), "outside")
        .when(F.col("start") <= F.lag("end").over(w), "overlap")
        .when((F.row_number().over(w) == 1) & (F.col("start") != 1), "outside")
    )
    return topics.withColumn("problem", problem)


def close_gaps(topics: DataFrame, key: Sequence[str], n: str = "n") -> DataFrame:
    """Each range reaches to the next one, the last to n."""
    w = W.partitionBy(*key).orderBy("start")
    return topics.withColumn("end", F.coalesce(F.lead("start").over(w) - 1, F.col(n)).cast(topics.schema["end"].dataType))


def remap(topics: DataFrame, cursor: Column) -> DataFrame:
    """Window ranges as ranges of the whole."""
    return topics.withColumn("start", F.col("start") + cursor).withColumn("end", F.col("end") + cursor)


def core_region(topics: DataFrame, key: Sequence[str], cursor: str = "cursor", final: str = "final", core: int = CORE) -> DataFrame:
    """What a window commits: all ranges if it is the last one, else those that end within its core, one at least."""
    n = F.row_number().over(W.partitionBy(*key).orderBy("start"))
    return topics.withColumn("__n", n).where(F.col(final) | (F.col("end") <= F.col(cursor) + core) | (F.col("__n") == 1)).drop("__n")


def recent(topics: DataFrame, key: Sequence[str], last: int = 3) -> DataFrame:
    n = F.row_number().over(W.partitionBy(*key).orderBy(F.col("seq").desc()))
    return topics.withColumn("__n", n).where(F.col("__n") <= last).drop("__n")


def repair(found: list[tuple], n: int) -> list[tuple] | None:
    """Ranges of one window put in order with gaps closed, or None where they can't be accepted."""
    if not found or any(not isinstance(a, int) or not isinstance(b, int) or a > b or not str(s or "").strip() for a, b, s in found):
        return None
    found = sorted(found, key=lambda x: x[0])
    if found[0][0] != 1 or found[-1][1] > n or any(b[0] <= a[1] for a, b in zip(found, found[1:])):
        return None
    ends = [b[0] - 1 for b in found[1:]] + [n]
    return [(a, e, s) for (a, _, s), e in zip(found, ends)]


def summary_loop(sentences: DataFrame, key: Sequence[str], summarise: Callable[[list[str], list[str]], list[tuple]] | None = None, window: int = WINDOW, core: int = CORE, tile: int = TILE, tries: int = 4) -> DataFrame:
    """Summaries of ordered sentences (pos, text): the key, seq, start, end, summary, fallback.

    ``summarise(texts, recent)`` gives (start, end, summary) for a window, its last three summaries at hand.
    A window begins where the last accepted range of the one before ends, so windows follow one another within a key; keys run apart.
    After ``tries`` answers that fail the check, tiles of ``tile`` sentences are committed.
    """
    k = list(key)

    def loop(texts: list[str]):
        done, cursor, total = [], 0, len(texts)
        while cursor < total:
            part = texts[cursor : cursor + window]
            final, got = cursor + len(part) >= total, None
            for _ in range(tries if summarise else 0):
                got = repair(list(summarise(part, [s for _, _, s, _ in done[-3:]])), len(part))
                if got:
                    break
            tiles = not got
            if tiles:
                got = [(i + 1, min(i + tile, len(part)), part[i]) for i in range(0, len(part), tile)]
            got = [(a + cursor, b + cursor, s, tiles) for a, b, s in got]
            kept = got if final else [g for i, g in enumerate(got) if g[1] <= cursor + core or i == 0]
            done += kept
            cursor = kept[-1][1]
        return done

    schema = T.StructType([*(sentences.schema[c] for c in k), *T._parse_datatype_string("seq int, start int, end int, summary string, fallback boolean").fields])

    def run(batches):
        def rows(group, texts):
            return [(*group, i, *t) for i, t in enumerate(loop(texts))]

        now, texts, out = None, [], []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(len(k) + 1)]
            for *group, text in zip(*cols):
                if group != now:
                    if now is not None:
                        out += rows(now, texts)
                    now, texts = group, []
                texts.append(text or "")
        if now is not None:
            out += rows(now, texts)
        arrow = [pa.array([r[i] for r in out], t) for i, t in enumerate([*kinds, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()])]
        yield pa.RecordBatch.from_arrays(arrow, names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(sentences.schema[c].dataType) for c in k]
    return clustered(sentences, k).select(*k, "text", "__n").mapInArrow(run, schema)


def topic_times(topics: DataFrame, blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds first_time and last_time: the start of a range's first block and the end of its last one."""
    edge = blocks.select(*key, (F.col("pos") + 1).cast("int").alias("__at"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    d = topics.join(edge.select(*key, F.col("__at").alias("start"), F.col("__s").alias("first_time")), [*key, "start"], "left")
    return d.join(edge.select(*key, F.col("__at").alias("end"), F.col("__e").alias("last_time")), [*key, "end"], "left")

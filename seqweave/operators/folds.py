"""Left-to-right folds whose decisions depend on what was decided before.

A fold reads rows sorted by key and position, in record batches, and keeps the state of the present group only:
one exchange, no group held in memory, no call for each group.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..schema import COMMA, COMMA_KEEP, COMMA_NEXT, COMMA_TOKENS, GROUP_TOKENS, LINE_CHARS, MERGE_GAP, SENTENCE_ENDERS, TINY_CHARS
from .islands import clustered, label_runs, last_char_in, over, speaker_change


def fold_labels(df: DataFrame, key: Sequence[str], inputs: Sequence[str], start: Callable, label: str, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Add an int column: ``start()`` makes a group's step, which maps each row's ``inputs`` to its label."""
    names = df.columns
    k = [names.index(c) for c in key]
    take = [names.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]):
        now, step = None, None
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in k))
            rows = zip(*(batch.column(i).to_pylist() for i in take))
            out = []
            for group, row in zip(keys, rows):
                if step is None or group != now:
                    now, step = group, start()
                out.append(step(*row))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.int32())], names=[*names, label])

    schema = T.StructType([*df.schema.fields, T.StructField(label, T.IntegerType())])
    return clustered(df, key, order).mapInArrow(run, schema)


def token_capped_merge(df: DataFrame, key: Sequence[str], most: int = GROUP_TOKENS, least_gap=MERGE_GAP, label: str = "group_id", order: Sequence[str] = ("pos",)) -> DataFrame:
    """Join rows (start, end, tokens) to the group before while pauses and the token limit allow."""

    def start():
        state = [-1, 0, None]

        def step(begin, end, tokens):
            if state[2] is not None and begin - state[2] < least_gap and state[1] + tokens <= most:
                state[1] += tokens
            else:
                state[0] += 1
                state[1] = tokens
            state[2] = end
            return state[0]

        return step

    return fold_labels(df, key, ("start", "end", "tokens"), start, label, order)


def line_packing(df: DataFrame, key: Sequence[str], limit: int = LINE_CHARS, least_gap=MERGE_GAP, enders: str = SENTENCE_ENDERS, stop: str = "。", label: str = "line_id", order: Sequence[str] = ("segment_id",)) -> DataFrame:
    """Pack segments (text, start, end, speaker) into lines of at most ``limit`` characters."""

    def start():
        state = {"id": -1}

        def step(text, begin, end, speaker):
            n = len(text or "")
            fits = state["id"] >= 0 and speaker == state["speaker"] and state["chars"] + n <= limit and not state["ended"] and begin - state["end"] < least_gap and not state["stop"]
            if fits:
                state["chars"] += n
                state["stop"] |= stop in (text or "")
            else:
                state.update(id=state["id"] + 1, chars=n, stop=stop in (text or ""))
            state.update(speaker=speaker, end=end, ended=bool(text) and text[-1] in enders)
            return state["id"]

        return step

    return fold_labels(df, key, ("text", "start", "end", "speaker"), start, label, order)


def next_section_tokens(df: DataFrame, key: Sequence[str], enders: str = SENTENCE_ENDERS, comma: str = COMMA) -> DataFrame:
    """Adds next_tokens: tokens from the next row up to and with its next mark, within the same speaker; pauses don't count."""
    return _with_sections(df, key, enders, comma).drop("__section")


def _with_sections(df: DataFrame, key: Sequence[str], enders: str, comma: str, order: Sequence[str] = ("pos",)) -> DataFrame:
    """next_section_tokens and __section, which numbers the sections: rows lie by key, __section and order, the same as by key and order."""
    stops = F.lag(last_char_in(F.col("text"), enders + comma)).over(over(key, order))
    d = label_runs(df, speaker_change(key, order=order) | stops, key, "__section", order)
    section = over([*key, "__section"], order)
    so_far = F.sum("morph_count").over(section.rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = F.sum("morph_count").over(section.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    d = d.withColumn("__tokens", whole).withColumn("__rest", F.coalesce("__tokens", F.lit(0)) - F.coalesce(so_far, F.lit(0)))
    w = over(key, ("__section", *order))
    last = F.coalesce(F.lead("__section").over(w) != F.col("__section"), F.lit(False))
    same = F.lead("speaker").over(w).eqNullSafe(F.col("speaker"))
    after = F.when(last & same, F.coalesce(F.lead("__tokens").over(w), F.lit(0))).when(last, 0).otherwise(F.col("__rest"))
    return d.withColumn("next_tokens", after.cast("int")).select(*df.columns, "next_tokens", "__section")


def sentence_cues(df: DataFrame, key: Sequence[str], enders: str = SENTENCE_ENDERS, comma: str = COMMA, least_gap=MERGE_GAP, label: str = "cue_id", order: Sequence[str] = ("pos",)) -> DataFrame:
    """A sentence a cue, long ones cut at commas unless that leaves a tiny rest behind a small cue."""
    ahead = _with_sections(df, key, enders, comma, order)

    def start():
        state = {"id": 0, "open": False, "tokens": 0}

        def step(text, begin, end, speaker, tokens, following):
            if state["open"] and (speaker != state["speaker"] or begin - state["end"] >= least_gap):
                state.update(id=state["id"] + 1, tokens=0)
            state["tokens"] += tokens or 0
            here, mark = state["id"], (text or "")[-1:]
            state.update(open=True, speaker=speaker, end=end)
            flush = bool(mark) and mark in enders
            if not flush and mark and mark in comma and state["tokens"] >= COMMA_TOKENS:
                flush = not ((following or 0) <= COMMA_NEXT and state["tokens"] <= COMMA_KEEP)
            if flush:
                state.update(id=here + 1, open=False, tokens=0)
            return here

        return step

    return fold_labels(ahead, key, ("text", "start", "end", "speaker", "morph_count", "next_tokens"), start, label, ("__section", *order)).drop("next_tokens", "__section")


def merge_tiny_segments(df: DataFrame, key: Sequence[str], tiny: int = TINY_CHARS, limit: int = LINE_CHARS, least_gap=MERGE_GAP, stop: str = "。", segment: str = "segment_id") -> DataFrame:
    """Relabel units: a tiny segment joins the one before; if that grows too long, both are cut anew.

    Cut behind the first unit that ends with a stop, else where the halves differ least, the first such place.
    """
    names = df.columns
    k, take, place = [names.index(c) for c in key], [names.index(c) for c in ("text", "start", "end", "speaker", segment)], names.index(segment)
    TEXT, START, END, SPEAKER = range(4)

    def run(batches):
        held: list[list] = []  # segments of units that may still change: the last one put out, and the one being read
        now, number, reading, labels, waiting = None, -1, None, [], deque()

        def chars(units):
            return sum(len(u[TEXT] or "") for u in units)

        def emit(units):
            nonlocal number
            number += 1
            labels.extend([number] * len(units))

        def close():
            """The segment being read is complete: join it to the one before or let that one go."""
            if len(held) < 2:
                return
            last, seg = held
            joins = chars(seg) < tiny and seg[0][SPEAKER] == last[-1][SPEAKER] and not any(stop in (u[TEXT] or "") for u in last) and seg[0][START] - last[-1][END] < least_gap
            if not joins:
                emit(last)
                held[:] = [seg]
                return
            units = last + seg
            if chars(units) <= limit:
                held[:] = [units]
                return
            lengths = [len(u[TEXT] or "") for u in units]
            cut = next((i + 1 for i, u in enumerate(units[:-1]) if (u[TEXT] or "").endswith(stop)), None)
            if cut is None:
                total, run_length, best = sum(lengths), 0, None
                for i, n in enumerate(lengths[:-1]):
                    run_length += n
                    if best is None or abs(2 * run_length - total) < best:
                        best, cut = abs(2 * run_length - total), i + 1
            emit(units[:cut])
            held[:] = [units[cut:]]

        def ready():
            """Batches of which every row has its label, the label beside the columns as they came."""
            while waiting and len(labels) >= waiting[0].num_rows:
                batch = waiting.popleft()
                n = batch.num_rows
                columns = [pa.array(labels[:n], batch.schema.field(i).type) if i == place else c for i, c in enumerate(batch.columns[: len(names)])]
                del labels[:n]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            waiting.append(batch)
            groups = zip(*(batch.column(i).to_pylist() for i in k))
            for group, *u, s in zip(groups, *(batch.column(i).to_pylist() for i in take)):
                if group != now:
                    close()
                    for units in held:
                        emit(units)
                    held, now, number, reading = [], group, -1, None
                if reading is None or s != reading:
                    close()
                    held.append([])
                    reading = s
                held[-1].append(u)
            yield from ready()
        close()
        for units in held:
            emit(units)
        yield from ready()

    return clustered(df, key).mapInArrow(run, df.schema)

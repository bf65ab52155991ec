"""Gap sessions over streams: the same rule as islands.gap_sessions, with late rows held back by a watermark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_gap_sessions(events: DataFrame, key: str, time: str, gap_seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """Finished sessions of each key: key, first, last, n. A pause of ``gap_seconds`` or more ends one.

    Spark's own session window joins rows exactly one gap apart, so the rule is kept in state: rows of a key
    wait, sorted, until the watermark is a gap beyond them. ``key`` is a string column, ``time`` a timestamp.
    """
    gap = pd.Timedelta(seconds=gap_seconds)

    def step(k, frames, state: GroupState):
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            held += [t.value // 1000 for t in f[time]]
        held.sort()
        mark = state.getCurrentWatermarkMs() * 1000
        out, width = [], gap.value // 1000
        while held:
            end = 1
            while end < len(held) and held[end] - held[end - 1] < width:
                end += 1
            if end == len(held) and held[-1] + width > mark:
                break
            if held[end - 1] + width > mark:
                break
            out.append((k[0], pd.Timestamp(held[0] * 1000), pd.Timestamp(held[end - 1] * 1000), end))
            held = held[end:]
        if held:
            state.update((held,))
            state.setTimeoutTimestamp(max(held[0] // 1000 + width // 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "first", "last", "n"])

    rows = events.select(F.col(key).cast("string").alias(key), time).withWatermark(time, lateness)
    return rows.groupBy(key).applyInPandasWithState(step, "key string, first timestamp, last timestamp, n long", "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)

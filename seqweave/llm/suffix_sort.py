"""Substring deduplication over a sorted suffix array, built by a distributed merge sort that knows common prefixes.

Suffixes start at the picked k-grams that repeat (see anchors.py): a sparse suffix array that no repeat of
``least`` words escapes. Each map task sorts its suffixes and front-codes them: a suffix is stored as the
number of words it shares with the one before it and the rest. These runs are exchanged once, by ranges of
the order; a reduce task merges its runs with a loser tree. Every run's head knows how many words it shares with
the suffix that left the tree last, so the head that shares more comes first without a look at its words, and
on a tie comparison starts behind the shared words; it yields the common prefixes of neighbours as it goes.
Suffixes are ordered by the hash of their first k words, then by their words' bytes, so ranges of the hash split evenly.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import HOT, K, SPANS, contexts, hot_spans, merge_spans, spread

#: gram, doc_id, has doc_id, key, number of starts, lead, last, shared words, bytes of the rest; the starts, the rest and the words before follow
_HEAD = "<Qq?qIiiHI"
_HEAD_SIZE = struct.calcsize(_HEAD)


def common_words(a: bytes, b: bytes, start: int = 0) -> int:
    """Number of leading words (of four bytes) that two suffixes share, known to be ``start`` at least."""
    end = min(len(a), len(b)) // 4
    if a[4 * start : 4 * end] == b[4 * start : 4 * end]:
        return end
    lo, hi = start, end  # shared at lo, different within hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[4 * lo : 4 * mid] == b[4 * lo : 4 * mid]:
            lo = mid
        else:
            hi = mid
    return lo


def encode_run(suffixes: list[tuple]) -> bytes:
    """Front-code suffixes (gram, words, left, doc_id, key, starts, lead, last) that are sorted by gram and words."""
    out, gram, before = [], None, b""
    for g, words, left, doc_id, key, starts, lead, last in suffixes:
        shared = common_words(before, words) if g == gram else 0
        rest = words[4 * shared :]
        out += (struct.pack(_HEAD, g, doc_id or 0, doc_id is not None, key, len(starts), lead, last, shared, len(rest)), struct.pack(f"<{len(starts)}i", *starts), rest, left)
        gram, before = g, words
    return b"".join(out)


def decode_run(blob: bytes) -> Iterator[tuple]:
    """(gram, shared words with the suffix before, words, left, doc_id, key, starts, lead, last)."""
    at, words = 0, b""
    while at < len(blob):
        g, doc_id, known, key, places, lead, last, shared, n = struct.unpack_from(_HEAD, blob, at)
        at += _HEAD_SIZE
        starts = struct.unpack_from(f"<{places}i", blob, at)
        at += 4 * places
        words = words[: 4 * shared] + blob[at : at + n]
        left = blob[at + n : at + n + 4 * lead]
        at += n + 4 * lead
        yield g, shared, words, left, doc_id if known else None, key, starts, lead, last


class LoserTree:
    """Merges front-coded runs. ``lcp`` of a run is what its head shares with the suffix that left last."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.lcp = [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.losers = [-1] * self.size
        self.winner = self._play(1)

    def _first(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser then knows what it shares with the winner."""
        if b < 0 or b >= len(self.runs) or self.heads[b] is None:
            return a, b
        if a < 0 or a >= len(self.runs) or self.heads[a] is None:
            return b, a
        x, y = self.heads[a], self.heads[b]
        if x[0] != y[0]:
            a, b = (a, b) if x[0] < y[0] else (b, a)
            self.lcp[b] = 0
            return a, b
        if self.lcp[a] != self.lcp[b]:  # whoever shares more with the last one out is nearer to it, and keeps less with the other
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        n = common_words(x[2], y[2], self.lcp[a])
        if (x[2][4 * n : 4 * n + 4], x[4] is None, x[4] or 0, x[5], x[6]) > (y[2][4 * n : 4 * n + 4], y[4] is None, y[4] or 0, y[5], y[6]):
            a, b = b, a
        self.lcp[b] = n
        return a, b

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, lose = self._first(self._play(2 * node), self._play(2 * node + 1))
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        """(shared words with the suffix before, suffix) in order; suffixes of another gram share none."""
        while self.winner < len(self.runs) and (head := self.heads[self.winner]) is not None:
            run = self.winner
            yield self.lcp[run], head
            after = next(self.runs[run], None)
            self.heads[run] = after
            # the next of the same run stands to the one just out as the front coding says
            self.lcp[run] = after[1] if after is not None and after[0] == head[0] else 0
            node, now = (run + self.size) // 2, run
            while node:
                now, self.losers[node] = self._first(now, self.losers[node])
                node //= 2
            self.winner = now


def cluster_spans(members: list[tuple[int, tuple]], least: int) -> Iterator[tuple]:
    """Span rows of the suffixes of one gram, from their order and common prefixes.

    A window of ``least`` words that begins d words before its gram repeats in the suffixes that share its
    ``least`` - d words from the gram on, an interval of the array without a smaller common prefix, and whose last d words before
    the gram are the same.
    """
    if len(members) < 2:
        return
    earliest: dict[tuple[int, int, bytes], tuple] = {}
    deepest = max(m[7] for _, m in members)
    for turn in (0, 1):
        interval = [0] * (deepest + 1)
        for shared, (_, _, _, left, doc_id, key, starts, lead, last) in members:
            order = (doc_id is None, doc_id or 0, key)
            for d in range(min(deepest, least - shared - 1) + 1):
                interval[d] += 1  # least - d words are more than are shared: another interval begins
            begin = None
            for s in range(last + 1):
                d = lead - s
                place = (d, interval[d], left[4 * s :])
                if not turn:
                    if (known := earliest.get(place)) is None or order < known[0]:
                        earliest[place] = (order, doc_id)
                    continue
                first, ref = earliest[place]
                if first < order:
                    if begin is None:
                        begin = (s, ref)
                elif begin is not None:
                    for a, b in spread(starts, begin[0], s - 1 - begin[0] + least):
                        yield doc_id, key, a, b, begin[1]
                    begin = None
            if turn and begin is not None:
                for a, b in spread(starts, begin[0], last - begin[0] + least):
                    yield doc_id, key, a, b, begin[1]


def mixed(gram: int) -> int:
    """A picked gram's place in the order. Picks have small hashes, so a one-to-one mixing spreads them evenly over the ranges."""
    return gram * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def sorted_runs(passages: DataFrame, ranges: int) -> DataFrame:
    """(range, run): each task's suffixes, sorted, front-coded and cut by ranges of the gram."""

    def sort(batches):
        for table in _gather(batches, 12 << 20):
            suffixes = []
            for g, doc_id, key, starts, lead, last, words in zip(*(table.column(c).to_pylist() for c in ("gram", "doc_id", "key", "starts", "lead", "last", "words"))):
                suffixes.append((mixed(g), words[4 * lead :], words[: 4 * lead], doc_id, key, starts, lead, last))
            suffixes.sort(key=lambda s: (s[0], s[1], s[3] is None, s[3] or 0, s[4], s[5]))
            by: dict[int, list] = {}
            for s in suffixes:
                by.setdefault(s[0] * ranges >> 64, []).append(s)
            for r, part in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([encode_run(part)], pa.binary())], names=["range", "run"])

    return passages.mapInArrow(sort, "range int, run binary")


def _gather(batches, limit: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def merge_runs(batches, least: int):
    """Merge all runs of each range; batches come sorted by range."""

    def batch_of(rows):
        cols = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["doc_id", "key", "start", "stop", "ref_doc_id"])

    def merged(runs):
        members, rows = [], []
        for shared, m in LoserTree([decode_run(r) for r in runs]):
            if members and members[-1][1][0] != m[0]:
                rows += cluster_spans(members, least)
                members = []
                if len(rows) > 1 << 14:
                    yield batch_of(rows)
                    rows = []
            members.append((shared, m))
        rows += cluster_spans(members, least)
        yield batch_of(rows)

    now, runs = None, []
    for batch in batches:
        for r, run in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist()):
            if r != now and runs:
                yield from merged(runs)
                runs = []
            now = r
            runs.append(run)
    if runs:
        yield from merged(runs)


#: Bytes of passages that a reduce task is to merge, and the most that one passage takes: 2 * least words and its places.
RANGE_BYTES = 32 << 20


def duplicate_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50, ranges: int | None = None, hot: int = HOT) -> DataFrame:
    """Word spans [start, stop) that stand in an earlier document too: doc_id, start, stop, ref_doc_id.

    The same spans as relative_lz.duplicate_spans defines, found by suffix order; nulls, empty, short, very long and
    repeated rows, ties, empty tables and other columns count as there. ``ranges`` is the number of reduce tasks, by
    default as many as give each RANGE_BYTES of passages, by the number of repeated picks.
    """
    if K > least:
        raise ValueError("least must be at least the words of a pick")
    passages, windows, n_picks = contexts(df, least, doc_id, text, hot)
    ranges = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_picks * (8 * least + 64) // RANGE_BYTES))
    runs = sorted_runs(passages, ranges)
    spans = runs.repartitionById(ranges, F.col("range")).mapInArrow(lambda batches: merge_runs(batches, least), SPANS)
    spans = spans if windows is None else spans.unionByName(hot_spans(windows, least))
    return merge_spans(spans).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.stop", "s.ref_doc_id")

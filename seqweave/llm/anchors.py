"""Anchors of repeated passages: sampled word k-grams that stand in more than one place.

Winnowing picks, in every window of ``least - k + 1`` k-grams, the one with the least hash. Equal passages of
``least`` words or more thus share a picked k-gram, and a passage whose picks all stand once in the corpus
cannot repeat: nothing is lost by looking on only around picks that stand twice or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, byte_strings, chunks, discard, ragged, row_key, stored

K = 12
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[bytes], seen: Hashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all words laid end to end, and the number of words of each text."""
    seen = Hashes(xxhash.xxh32_intdigest) if seen is None else seen
    if len(seen) > 1 << 18:
        seen.clear()
    sizes, parts = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        words = t.split()
        sizes[i] = len(words)
        parts.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), sizes


def gram_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """64-bit hash of the k words from each position on."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    w = words.astype(np.uint64)
    for i in range(k):
        out = out * _BASE + w[i : i + n] + np.uint64(1)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def picks(words: np.ndarray, sizes: np.ndarray, least: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same pick: the pick's position, the first and the last window start, the pick's hash.

    A window is ``least`` words of one sequence, sequences lying end to end; its pick is the k-gram in it with
    the least hash, of equal ones the last, so it depends on the window's words alone.
    """
    window = least - k + 1
    grams = gram_hashes(words, k)
    n = len(grams) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    bits = np.uint64(32)  # of a hash the upper half ranks it, the lower half makes room for the position, in any text alike
    low = (np.uint64(1) << bits) - np.uint64(1)
    ranked = (grams >> bits << bits) | (low - np.arange(len(grams), dtype=np.uint64))
    # least value of each window, from running minima of blocks forwards and backwards
    pad = -len(ranked) % window
    blocks = np.append(ranked, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    best = np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])
    # windows that start where ``least`` words of the same sequence follow
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    starts = np.flatnonzero(room[:n] >= least)
    at = (low - (best[starts] & low)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))) if len(at) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(at)) - 1 if len(at) else new
    return at[new], starts[new], starts[last], grams[at[new]]


def documents_with_key(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key, doc_id, text of the rows with a text; rows that are equal in both are one document."""
    return df.where(F.col(text).isNotNull()).select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def repeated_anchors(docs: DataFrame, least: int, hot: int) -> DataFrame:
    """(key, at array<int>, hot array<int>): for each document the picks whose k-gram is picked in two places or more.

    ``hot`` lists those of them whose k-gram is picked in more than ``hot`` places.
    """

    def pick(batches):
        seen = Hashes(xxhash.xxh32_intdigest)
        for part in chunks(batches, "text"):
            words, sizes = word_hashes(byte_strings(part.column("text")), seen)
            at, _, _, grams = picks(words, sizes, least)
            owner = np.repeat(np.arange(len(sizes)), sizes)[at]
            offset = at - (np.cumsum(sizes) - sizes)[owner]
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(owner)), pa.array(offset, pa.int32()), pa.array(grams.view(np.int64))], names=["key", "at", "gram"])

    found = stored(docs.select("key", "text").mapInArrow(pick, "key long, at int, gram long"), "picks")
    place = F.struct("key", "at")
    twice = found.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("gram", "n")
    marked = found.join(twice, "gram").groupBy("key").agg(F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("n") > hot, F.col("at"))).alias("hot"))
    out = stored(marked, "anchors")
    discard(found)
    return out


#: Places of a picked k-gram beyond which its passages are compared window by window, see ``hot_spans``.
HOT = 1 << 16


def contexts(df: DataFrame, least: int, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame | None, int]:
    """Passages around repeated picks, windows of hot picks (None without any), and how many picks repeat.

    Passages: gram, doc_id, key, starts, lead, last, words.
    ``starts`` lists the passage's places in the document as progressions (first, step, count), end to end.
    ``words`` holds 32-bit word hashes (little-endian) from each of these words on; the pick
    stands at ``lead`` of them, and the passage's windows of ``least`` words begin at 0 .. ``last``. Every window whose
    pick repeats stands in exactly one row, and equal windows stand under the same gram with the same distance to it.
    A passage that a document repeats word by word, as looping text does thousands of times, is one row.

    Windows: doc_id, key, start and ``window``, a 128-bit hash of its words, for every window whose pick is hot, so that no
    task has to hold or read all passages of a pick that stands in a great part of the corpus.
    """
    docs = documents_with_key(df, doc_id, text)
    anchors = repeated_anchors(docs, least, hot)
    n_picks, n_hot = anchors.agg(F.coalesce(F.sum(F.size("at")), F.lit(0)), F.coalesce(F.sum(F.size("hot")), F.lit(0))).first()
    marked = docs.join(anchors, "key").dropDuplicates(["key"])

    def cut(batches):
        seen = Hashes(xxhash.xxh32_intdigest)
        for part in chunks(batches, "text", 2 << 20):
            words, sizes = word_hashes(byte_strings(part.column("text")), seen)
            at, first, final, grams = picks(words, sizes, least)
            base = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)[at]

            def places(lists: pa.ListArray) -> np.ndarray:
                return np.repeat(base, np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy()

            keep = np.isin(at, places(part.column("at")))
            at, first, final, grams, owner = at[keep], first[keep], final[keep], grams[keep], owner[keep]
            if n_hot:
                warm = ~np.isin(at, places(part.column("hot")))
                n = (final - first + 1)[~warm]
                own, begin = np.repeat(owner[~warm], n), ragged(first[~warm], n)
                data = words.tobytes()
                marks = [xxhash.xxh3_128_digest(data[4 * i : 4 * (i + least)]) for i in begin.tolist()]
                if marks:
                    none = pa.nulls(len(marks), pa.int64())
                    yield batch_of(none, part, own, pa.nulls(len(marks), pa.list_(pa.int32())), begin - base[own], begin - base[own], marks)
                at, first, final, grams, owner = at[warm], first[warm], final[warm], grams[warm], owner[warm]
            size = final - first + least
            data, edges = words[ragged(first, size)].tobytes(), np.append(0, np.cumsum(4 * size)).tolist()
            rows: dict[tuple, list[int]] = {}
            for i, (d, g, start, lead, last) in enumerate(zip(owner.tolist(), grams.view(np.int64).tolist(), (first - base[owner]).tolist(), (at - first).tolist(), (final - first).tolist())):
                rows.setdefault((d, g, lead, last, data[edges[i] : edges[i + 1]]), []).append(start)
            own, gram, lead, last, blob = zip(*rows) if rows else ((),) * 5
            yield batch_of(pa.array(gram, pa.int64()), part, own, pa.array(map(progressions, rows.values()), pa.list_(pa.int32())), lead, last, blob)

    def batch_of(gram, part, own, starts, lead, last, blob):
        own = pa.array(own, pa.int64())
        columns = [gram, part.column("doc_id").take(own), part.column("key").take(own), starts, pa.array(lead, pa.int32()), pa.array(last, pa.int32()), pa.array(blob, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["gram", "doc_id", "key", "starts", "lead", "last", "words"])

    found = marked.select("key", "doc_id", "text", "at", "hot").mapInArrow(cut, "gram long, doc_id long, key long, starts array<int>, lead int, last int, words binary")
    if not n_hot:
        return found, None, n_picks
    found = stored(found, "passages")
    windows = found.where("gram is null").select("doc_id", "key", F.col("lead").alias("start"), F.col("words").alias("window"))
    return found.where("gram is not null"), windows, n_picks


def hot_spans(windows: DataFrame, least: int) -> DataFrame:
    """Rows as in SPANS for the windows that an earlier document holds: the earliest is an aggregate with a partial
    one before it, and its table is small beside the windows, so a window in half of all documents makes no hot task."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("window", "first")
    later = windows.join(first, "window").where(place > F.col("first"))
    return later.select("doc_id", "key", "start", (F.col("start") + least).alias("stop"), F.col("first.doc_id").alias("ref_doc_id"))


def progressions(places: list[int]) -> list[int]:
    """Rising numbers as (first, step, count), end to end."""
    if len(places) == 1:
        return [places[0], 0, 1]
    out, i = [], 0
    while i < len(places):
        step = places[i + 1] - places[i] if i + 1 < len(places) else 0
        j = i + 1
        while j < len(places) and places[j] - places[j - 1] == step:
            j += 1
        out += (places[i], step, j - i)
        i = j
    return out


def spread(starts: list[int], i: int, n: int) -> list[tuple[int, int]]:
    """[start, stop) of ``n`` words at ``i`` of a passage, at all its places; those that touch are joined."""
    out, begin, end = [], None, -1
    for first, step, count in zip(starts[::3], starts[1::3], starts[2::3]):
        for a, b in [(first, first + (count - 1) * step)] if step <= n else [(first + k * step,) * 2 for k in range(count)]:
            if begin is not None and a + i <= end:
                end = b + i + n
            else:
                if begin is not None:
                    out.append((begin, end))
                begin, end = a + i, b + i + n
    out.append((begin, end))
    return out


SPANS = "doc_id long, key long, start int, stop int, ref_doc_id long"


def merge_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, key, spans array<struct<start,stop,ref_doc_id>>) from rows as in SPANS: spans that overlap or touch become one."""
    one = F.struct("start", "stop", "ref_doc_id")
    ordered = spans.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_set(one)).alias("all"))

    def add(acc, s):
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["ref_doc_id"].alias("ref_doc_id"))
        return F.when(F.try_element_at(acc, F.lit(-1))["stop"] >= s["start"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    empty = F.slice("all", 1, 0)
    return ordered.select("doc_id", "key", F.aggregate("all", empty, add).alias("spans"))

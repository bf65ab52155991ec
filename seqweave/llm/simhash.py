"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 128 bits holds the signs of summed word hashes (MD5, so that SQL can tell the same), each distinct
word of a document counting once. It is cut into m segments. Two fingerprints within ``radius`` bits differ, by the pigeonhole principle,
in at most a = radius // m bits in one of the first radius % m + 1 segments, or in at most a - 1 bits in one
of the others. So for each segment the Hamming ball of that size around its value is enumerated, the table of
that segment is read at each value in the ball, and the complete distance of every match is checked: exact.
"""

from __future__ import annotations

from hashlib import md5
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, Index, byte_strings, chunks, free_name, stored
from .components import components, forest

BITS = 128
#: each byte of a hash as eight bytes of 0 or 1, so that one 64-bit addition counts eight bits
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """(n, 2) 64-bit words; a text without words has the fingerprint 0."""
    ids = Index()
    sets = [list(set(map(ids.__getitem__, t.split()))) for t in texts]
    if not ids:
        return np.zeros((len(texts), 2), np.uint64)
    digests = np.frombuffer(b"".join([md5(w, usedforsecurity=False).digest() for w in ids]), np.uint8).reshape(-1, 16)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.fromiter((i for s in sets for i in s), np.int64, int(sizes.sum()))
    # runs of at most 255 words of one document are summed eight bits to a 64-bit word, then the runs in 32 bits
    runs = -(-sizes // 255)
    doc = np.repeat(np.arange(len(sets)), runs)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * nth
    sums = np.empty((len(doc), 16), np.uint64)
    for k in range(16):
        sums[:, k] = np.add.reduceat(_SPREAD[digests[flat, k]], starts)
    counts = np.zeros((len(sets), BITS), np.int32)
    some = sizes > 0
    counts[some] = np.add.reduceat(sums.view(np.uint8).reshape(-1, BITS), (np.cumsum(runs) - runs)[some], axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(np.uint64)


def fingerprint_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), hi, lo for each row, hi and lo null where the text has no words."""

    def make(batches):
        for part in chunks(batches, "t"):
            texts = byte_strings(part.column("t"))
            prints = fingerprints(texts).view(np.int64)
            none = np.array([not t or t.isspace() for t in texts])
            yield pa.RecordBatch.from_arrays([part.column("d"), part.column("m"), pa.array(prints[:, 0], mask=none), pa.array(prints[:, 1], mask=none)], names=["doc_id", "mark", "hi", "lo"])

    rows = df.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(F.col(text)).alias("m"), F.col(text).alias("t"))
    return rows.mapInArrow(make, "doc_id long, mark long, hi long, lo long")


#: What the matches of evenly spread values cost, in lookups: a match's distance takes some 2.5, and the values met are twice as full.
MATCH = 5


def segment_plan(n: int, radius: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(first bit, width) of each segment and the radius of its ball; wider segments for more fingerprints.

    The result doesn't depend on the plan; it only balances the ball's size against the matches a value has.
    """

    def plan(m: int) -> tuple[list[tuple[int, int]], list[int]]:
        edges = [BITS * i // m for i in range(m + 1)]
        a, b = divmod(radius, m)
        return [(edges[i], edges[i + 1] - edges[i]) for i in range(m)], [a if i <= b else a - 1 for i in range(m)]

    def cost(m: int) -> float:
        return sum(ball_size(w, r) * (1 + MATCH * n / 2**w) for (_, w), r in zip(*plan(m)))

    return plan(min((8, 7, 6, 5, 4), key=cost))


def bit_range(prints: np.ndarray, first: int, width: int) -> np.ndarray:
    """Bits first .. first + width of each fingerprint, counted from the most significant of word 0."""
    out = np.zeros(len(prints), np.uint64)
    for k in range(2):
        lo, hi = max(first, 64 * k), min(first + width, 64 * k + 64)
        if lo < hi:
            piece = (prints[:, k] >> np.uint64(64 * k + 64 - hi)) & np.uint64((1 << (hi - lo)) - 1)
            out |= piece << np.uint64(first + width - hi)
    return out.astype(np.int64)


def ball(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``width`` bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def ball_size(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


class Buckets:
    """Fingerprints sorted by a value of ``width`` bits, and where each value's rows begin and end."""

    def __init__(self, prints: np.ndarray, values: np.ndarray, width: int):
        self.order = np.argsort(values, kind="stable")
        self.values = values[self.order]
        self.words = [np.ascontiguousarray(prints[self.order, k]) for k in range(2)]
        self.distinct, at = np.unique(self.values, return_index=True)
        self.edges = np.append(at, len(values))
        # tables of all values while they are not much larger than the fingerprints; the first one is small and tells most misses
        self.here = self.table = None
        if width <= 24 and 1 << width <= 32 * len(values) + (1 << 16):
            self.here = np.zeros(1 << width, bool)
            self.here[self.distinct] = True
            self.table = np.zeros((1 << width) + 1, np.int32)
            np.cumsum(np.bincount(self.values, minlength=1 << width), out=self.table[1:])

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the values are there, and each one's first row and number of rows."""
        if self.here is not None:
            hit = np.flatnonzero(self.here[wanted])
            there = wanted[hit]
            begin = self.table[there]
            return hit, begin, self.table[there + 1] - begin
        at = np.minimum(np.searchsorted(self.distinct, wanted), len(self.distinct) - 1)
        hit = np.flatnonzero(self.distinct[at] == wanted)
        at = at[hit]
        return hit, self.edges[at], self.edges[at + 1] - self.edges[at]


def pairs_within(prints: np.ndarray, plan: tuple, s: int, radius: int, own: np.ndarray, block: int = 1 << 16, prefix: int = 0):
    """Index pairs within ``radius`` that segment ``s`` finds, in blocks: pairs of all rows if all are ``own``, else of own ones with others.

    Own rows agree in the first ``prefix`` bits of the segment, and so do the others. A pair is met once, from the row that
    lacks the highest bit in which their values differ. Rows lie sorted by value, so both sides of a mask are read in runs.
    """
    (first, width), r = plan[0][s], plan[1][s]
    width -= prefix
    values = bit_range(prints, first, width + prefix)
    alone = bool(own.all())
    if not alone and own.any():
        r -= int(values[own][0] >> width ^ values[~own][0] >> width).bit_count()
    if r < 0 or not own.any():
        return
    values &= (1 << width) - 1
    mine = np.flatnonzero(own)
    a = Buckets(prints[mine], values[mine], width)
    theirs = mine if alone else np.flatnonzero(~own)
    b = a if alone else Buckets(prints[theirs], values[theirs], width)
    mine, theirs = mine[a.order], theirs[b.order]
    # the word that holds less of the segment tells most matches from near ones
    w = 1 if first + (width + prefix) // 2 < 64 else 0

    def near(x: np.ndarray, y: np.ndarray):
        close = np.bitwise_count(a.words[0][x] ^ b.words[0][y]) + np.bitwise_count(a.words[1][x] ^ b.words[1][y]) <= radius
        if close.any():
            yield mine[x[close]], theirs[y[close]]

    def matches(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Near ones of each row and ``sizes`` rows of b from ``starts``."""
        i = 0
        while i < len(rows):  # the first match of every row
            x, y = rows[i : i + block], starts[i : i + block]
            hit = np.flatnonzero(np.bitwise_count(a.words[w][x] ^ b.words[w][y]) <= radius)
            yield from near(x[hit], y[hit])
            i += block
        more = np.flatnonzero(sizes > 1)
        rows, starts, sizes = rows[more], starts[more] + 1, sizes[more] - 1
        total = np.cumsum(sizes, dtype=np.int64)
        i = 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + block, "right")))
            n, begin = sizes[i:j].astype(np.int64), starts[i:j].astype(np.int64)
            ends = np.cumsum(n)
            y = np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)
            differ = np.repeat(a.words[w][rows[i:j]], n)
            differ ^= b.words[w][y]
            hit = np.flatnonzero(np.bitwise_count(differ) <= radius)
            yield from near(rows[i:j][np.searchsorted(ends, hit, "right")], y[hit])
            i = j

    masks = sorted(ball(width, r))
    if alone:  # within a value each row meets those behind it
        rows = np.arange(len(mine))
        behind = np.repeat(a.edges[1:], np.diff(a.edges)) - rows - 1
        some = np.flatnonzero(behind)
        yield from matches(rows[some], rows[some] + 1, behind[some])
        masks = masks[1:]
    high, asking, wanted = 0, np.arange(len(mine)), a.values
    for mask in masks:
        if alone and high != mask.bit_length():
            high = mask.bit_length()
            asking = np.flatnonzero(a.values >> (high - 1) & 1 == 0)
            wanted = a.values[asking]
        hit, begin, n = b.find(wanted ^ mask)
        yield from matches(asking[hit], begin, n)


def near_edges(prints: DataFrame, radius: int, rows_per_task: int = 1 << 20) -> DataFrame:
    """Edges (u, v) that join the ids of fingerprints (id, hi, lo) as all pairs within ``radius`` do.

    One task holds one segment's table, or one pair of value groups of it where a table would pass
    ``rows_per_task``: groups share their first p bits, and only pairs of groups whose prefixes differ in no
    more bits than the ball may are formed, each pair once. Each task returns a spanning forest of its pairs, so groups of
    thousands of copies cost a row a copy.
    """
    n = prints.count()
    plan = segment_plan(n, radius)
    spans, radii = plan
    p = max(0, (n // rows_per_task).bit_length())
    jobs = [(s, g, h) for s, r in enumerate(radii) if r >= 0 for g in range(1 << p) for h in range(g, 1 << p) if (g ^ h).bit_count() <= r]
    jobs.sort(key=lambda j: (j[1] ^ j[2]).bit_count())  # the long ones first

    def find(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        parts = pa.Table.from_batches(held)
        job = parts.column("job").to_numpy()
        for j in np.unique(job):
            mine = parts.filter(pa.array(job == j))
            s, g, h = jobs[j]
            ids = mine.column("id").to_numpy()
            both = np.stack([mine.column("hi").to_numpy(), mine.column("lo").to_numpy()], axis=1).view(np.uint64)
            first, width = spans[s]
            side = bit_range(both, first, width) >> (width - p) == g
            found_u, found_v = [], []
            held = 0
            for x, y in pairs_within(both, plan, s, radius, side, prefix=p) if g == h or not side.all() else ():
                found_u.append(ids[x])
                found_v.append(ids[y])
                held += len(x)
                if held > 1 << 22:  # keep the forest of what was found so far
                    u, v = forest(np.concatenate(found_u), np.concatenate(found_v))
                    found_u, found_v, held = [u], [v], len(u)
            if found_u:
                u, v = forest(np.concatenate(found_u), np.concatenate(found_v))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def route(batches):
        by: dict[tuple[int, int], list[int]] = {}
        for j, (s, g, h) in enumerate(jobs):
            for group in {g, h}:
                by.setdefault((s, group), []).append(j)
        for batch in batches:
            both = np.stack([batch.column("hi").to_numpy(), batch.column("lo").to_numpy()], axis=1).view(np.uint64)
            for s, (first, width) in enumerate(spans):
                group = bit_range(both, first, width) >> (width - p)
                takes, sent = [], []
                for g in np.unique(group):
                    rows = np.flatnonzero(group == g)
                    for j in by.get((s, int(g)), ()):
                        takes.append(rows)
                        sent.append(np.full(len(rows), j, np.int32))
                if takes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sent)), *batch.take(pa.array(np.concatenate(takes))).columns], names=["job", "id", "hi", "lo"])

    routed = prints.mapInArrow(route, "job int, id long, hi long, lo long")
    return routed.repartitionById(len(jobs), F.col("job")).mapInArrow(find, "u long, v long")


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 22) -> DataFrame:
    """doc_id, mark, group_id, kept for each row of ``df``; see near_duplicates. ``mark`` is a hash of the text.

    The points of the search are the distinct fingerprints, numbered as they were written, so documents are told
    apart by doc_id and text together wherever they meet.
    """
    prints = stored(fingerprint_table(df, doc_id, text), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    points = prints.where("hi is not null").groupBy("hi", "lo").agg(F.min(order).alias("least"))
    points = stored(points.withColumn("id", F.monotonically_increasing_id()), "points")
    linked = components(near_edges(points.select("id", "hi", "lo"), radius))
    rooted = points.join(linked, points["id"] == linked["node"], "left").select("hi", "lo", "least", F.coalesce("root", "id").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    grouped = rooted.join(best, "root").select("hi", "lo", "best")
    out = prints.join(grouped, ["hi", "lo"], "left")
    # of rows that are equal in doc_id and text the first one stands for all
    first = F.row_number().over(W.partitionBy("doc_id", "mark", "hi", "lo").orderBy(F.lit(0))) == 1
    chosen = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark")) & F.col("first")
    kept = F.when(F.col("best").isNull(), F.lit(True)).otherwise(chosen)
    return out.withColumn("first", first).select("doc_id", "mark", F.col("best.doc_id").alias("group_id"), kept.alias("kept"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 22) -> DataFrame:
    """Group documents whose fingerprints are linked by distances of at most ``radius`` of 128 bits.

    Returns a row for each input row: doc_id, group_id, kept. group_id is the least doc_id of the group, and
    ``kept`` is true for one row of the group: the one with the least doc_id (nulls last), of these the one with the least
    hash of its text, of rows equal in both any one. The same doc_id with another text is another document.
    Documents with the same fingerprint are one point of the search, so exact copies cost nothing there.
    Texts without words (null, empty, blank) have no group and are kept. Very long texts are read whole. A group of which no
    document has a doc_id has a null group_id and one kept row. An empty table gives no rows; other columns are not read.
    """
    return near_groups(df, doc_id, text, radius).select("doc_id", "group_id", "kept")


def remove_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 22) -> DataFrame:
    """The rows of ``df`` that near_duplicates keeps, in all their columns; of equal rows one.

    Rows equal in doc_id and text but not in other columns are one document, and any one of them stays; texts without words
    stay as often as they stand. Columns may have any names.
    """
    names = df.columns
    mark, nth, known, none = (free_name(names, c) for c in ("__mark", "__nth", "__known", "__none"))
    wordless = ~F.coalesce(F.col(text).rlike(WORD), F.lit(False))

    def keyed(rows: DataFrame, ident: Column, hashed: Column) -> DataFrame:
        """With doc_id as two columns without nulls, so that the join and the count of equal rows share one exchange."""
        return rows.withColumns({known: F.coalesce(ident.cast("long"), F.lit(0)), none: ident.isNull(), mark: hashed})

    groups = near_groups(df, doc_id, text, radius).where("kept and group_id is not null or kept and doc_id is null")
    stay = keyed(groups.select(F.col("doc_id").alias("i"), F.col("mark").alias("m")), F.col("i"), F.col("m")).select(known, none, mark).distinct()
    named = keyed(df.where(~wordless), F.col(doc_id), F.xxhash64(F.col(text))).join(stay, [known, none, mark], "left_semi")
    alone = named.withColumn(nth, F.row_number().over(W.partitionBy(known, none, mark).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return alone.select(*names).unionByName(df.where(wordless))

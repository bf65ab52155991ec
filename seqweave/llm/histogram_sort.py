"""Sharding by histogram sort: exact byte counts below probe keys choose the splitters, then one exchange."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, stored


def ordered_bytes(df: DataFrame, keys: Sequence[str]) -> Column:
    """Key columns as one binary value that sorts as they do, nulls first.

    Whole numbers become eight bytes with the sign flipped; anything else is taken as a string, in which
    01 follows each zero byte so that the end mark 00 00 sorts before all that may stand there.
    """
    parts = []
    for k in keys:
        c, kind = F.col(k), df.schema[k].dataType
        if isinstance(kind, T.IntegralType):
            body = F.unhex(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
        else:
            body = F.concat(F.encode(F.replace(c.cast("string"), F.lit("\0"), F.lit("\0\x01")), "utf-8"), F.unhex(F.lit("0000")))
        parts.append(F.when(c.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), body)))
    return F.concat(*parts)


def find_splitters(narrow: DataFrame, shard_bytes: int, tolerance: float, picks: int) -> list[bytes]:
    """Upper keys of all shards but the last, from a table (key binary, bytes long).

    Each round counts, across all partitions, the exact bytes between neighbouring probes of the ranges that
    still hold a wanted position, and draws the next probes there, rows weighted by their bytes. The driver
    receives at most 4 * ``picks`` rows a shard, never in proportion to the rows.
    """
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    n = -(-total // shard_bytes) or 1
    goals = [total * i // n for i in range(1, n)]
    slack = int(tolerance * total / n)
    found: dict[int, bytes] = {}
    probes: list[bytes] = []  # sorted; a range ends at each, and one after the last
    below: dict[bytes, int] = {}
    active = [(0, None, None, 0)]  # range: bytes before it, its lower and upper key (None: open)
    turn = 0
    while goals and active:
        # bounds of the active ranges and the probes inside them, in key order
        cuts = sorted({k for _, lo, hi, _ in active for k in (lo, hi) if k is not None} | set(probes))
        live = [False] * (len(cuts) + 1)
        for _, lo, hi, _ in active:
            a = bisect_left(cuts, lo) + 1 if lo is not None else 0
            b = bisect_left(cuts, hi) if hi is not None else len(cuts)
            live[a : b + 1] = [True] * (b + 1 - a)

        def place(batches, cuts=cuts, live=live):
            for batch in batches:
                at = [bisect_left(cuts, k) for k in batch.column(0).to_pylist()]
                keep = pa.array([live[i] for i in at], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["at", "key", "bytes"]).filter(keep)

        u = (F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        counted = (
            narrow.mapInArrow(place, "at int, key binary, bytes long")
            .withColumn("salt", F.pmod(F.xxhash64(F.lit(turn), "key"), F.lit(picks * (4 * n if turn == 0 else 1))))
            .withColumn("race", -F.log(u) / F.greatest("bytes", F.lit(1)))
            .groupBy("at", "salt")
            .agg(F.sum("bytes").alias("bytes"), F.min_by("key", "race").alias("pick"), F.min("key").alias("low"), F.max("key").alias("high"))
            .collect()
        )
        of: dict[int, list] = {}
        for r in counted:
            of.setdefault(r["at"], []).append(r)
        following, probes = [], []
        for base, lo, hi, _ in active:
            a = bisect_left(cuts, lo) + 1 if lo is not None else 0
            b = bisect_left(cuts, hi) if hi is not None else len(cuts)
            for i in range(a, b + 1):
                rows = of.get(i, [])
                size = sum(r["bytes"] for r in rows)
                low, high = (bytes(min(r["low"] for r in rows)), bytes(max(r["high"] for r in rows))) if rows else (None, None)
                inside = [g for g in range(len(goals)) if g not in found and base < goals[g] <= base + size]
                left = cuts[i - 1] if i else None
                for g in list(inside):
                    near_low, near_high = goals[g] - base, base + size - goals[g]
                    single = low == high
                    if (near_high <= slack or near_low <= slack or single) and (left is not None or near_high <= near_low or single):
                        found[g] = high if near_high <= near_low or left is None else left
                        inside.remove(g)
                if inside:
                    following.append((base, left, high, 0))
                    probes += sorted({low} | {bytes(r["pick"]) for r in rows} - {high})
                base += size
        active, probes, turn = following, sorted(set(probes)), turn + 1
    return sorted(set(found.values()))


def _search(key: Column, cuts: Column, n: Column, most: int) -> Column:
    """Number of ``cuts`` (rising, ``n`` of them, at most ``most``) that lie below ``key``, by halving."""

    def halve(at: Column, _: Column) -> Column:
        lo, hi = at["lo"], at["hi"]
        mid = F.shiftright(lo + hi, 1)
        right = (lo < hi) & (F.element_at(cuts, F.least(mid, n - 1) + 1) < key)
        return F.struct(F.when(right, mid + 1).otherwise(lo).alias("lo"), F.when(right | (lo >= hi), hi).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(most.bit_length()))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi")), halve, lambda at: at["lo"]))


def refine_ranges(narrow: DataFrame, cuts: list[bytes], shard_bytes: int) -> DataFrame:
    """(range, keys): the upper keys of the shards inside each range that ``cuts`` make, but for the last one.

    Each range is one task, which reads its keys in order with a running sum of their bytes: it is divided evenly, at the
    nearest places that whole keys allow. The driver receives a row a range.
    """

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bisect_left(cuts, k) for k in batch.column(0).to_pylist()], pa.int32()), *batch.columns], names=["range", "key", "bytes"])

    ranged = narrow.mapInArrow(place, "range int, key binary, bytes long")
    sizes = dict(ranged.groupBy("range").agg(F.sum("bytes")).collect())

    def edges(rows, size: int):
        """Upper keys for the rows (key, bytes) of one range."""
        n = -(-size // shard_bytes)
        goal, at, before, out = 1, 0, None, []
        for key, more in rows:
            below, at = at, at + more
            while goal < n and (p := size * goal // n) <= at:
                near = key if before is None or at - p <= p - below else before
                if near not in out[-1:] and (near is not key or at < size):
                    out.append(near)
                goal += 1
            before = key
        return out

    def split(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

        for r, mine in groupby(rows(), key=lambda x: x[0]):
            whole = ((k, sum(size for _, _, size in same)) for k, same in groupby(mine, key=lambda x: x[1]))
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([edges(whole, sizes[r])], pa.list_(pa.binary()))], names=["range", "keys"])

    return ranged.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "key").mapInArrow(split, "range int, keys array<binary>")


#: Shards up to which the driver finds all splitters itself; beyond, it finds as many ranges, each refined in a task.
DRIVER_SHARDS = 1024


def histogram_sort(df: DataFrame, keys: Sequence[str] = ("source", "doc_id"), text: str = "text", shard_bytes: int = 32 << 20, tolerance: float = 0.01, picks: int = 6, out: str = "shard", driver_shards: int = DRIVER_SHARDS) -> DataFrame:
    """Sort ``df`` by ``keys`` into shards of about ``shard_bytes`` bytes of text, one partition each.

    Splitters are refined until every shard edge lies within ``tolerance`` of a shard from its exact place, or
    until one key alone spans the place, as with a very long document. The rows move once. Beyond ``driver_shards``
    shards the driver finds the edges of so many ranges, and a task for each range those that divide it evenly; these come
    in a table that Spark joins in the way its size at run time allows.

    Null keys sort first; null and empty texts weigh 0 bytes and keep their place; rows with equal keys share a
    shard; an empty table gives no rows; a column named like ``out`` is replaced; other columns pass unchanged, whatever their names.
    """
    names = [c for c in df.columns if c.lower() != out.lower()]
    key, cuts_of, range_of = (free_name([*df.columns, out], c) for c in ("__key", "__cuts", "__range"))
    keyed = df.withColumn(key, ordered_bytes(df, keys))
    if out in df.columns and out not in keys:
        keyed = keyed.drop(out)
    narrow = stored(keyed.select(F.col(key).alias("key"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes")), "sort-keys")
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    coarse = total > driver_shards * shard_bytes
    cuts = find_splitters(narrow, -(-total // driver_shards) if coarse else shard_bytes, tolerance, picks)
    spark = df.sparkSession

    def among(rows: DataFrame, name: str) -> DataFrame:
        """The place of each row among ``cuts``, which come in one row of at most ``driver_shards`` keys."""
        if not cuts:
            return rows.withColumn(name, F.lit(0))
        table = spark.createDataFrame([(cuts,)], f"`{cuts_of}` array<binary>")
        return rows.crossJoin(F.broadcast(table)).withColumn(name, _search(F.col(key), F.col(cuts_of), F.lit(len(cuts)), len(cuts))).drop(cuts_of)

    if coarse:
        fine = stored(refine_ranges(narrow, cuts, shard_bytes), "splitters")
        inside = dict(fine.select("range", F.size("keys")).collect())
        first = [0, *accumulate(inside.get(r, 0) + 1 for r in range(len(cuts) + 1))]
        table = fine.select(F.col("range").alias(range_of), F.col("keys").alias(cuts_of))
        ranged = among(keyed, range_of).join(table, range_of)
        placed = ranged.withColumn(out, F.element_at(F.lit(first), F.col(range_of) + 1) + _search(F.col(key), F.col(cuts_of), F.size(cuts_of), max(*inside.values(), 1)))
        shards = first[-1]
    else:
        placed, shards = among(keyed, out), len(cuts) + 1
    discard(narrow)
    return placed.repartitionById(shards, F.col(out)).sortWithinPartitions(key).select(*names, out)

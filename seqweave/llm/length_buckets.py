"""Packing: bucket edges that minimise padding, found exactly over the global length histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import stored, word_count


def best_edges(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding in total.

    Padding of a bucket (i, j] is len_j * (N_j - N_i) - (S_j - S_i), with N and S the running counts and
    lengths; for fixed j it is a line in len_j whose slope -N_i falls with i, so each layer of the dynamic
    program walks a lower hull: exact, and linear in the distinct lengths. Among equal optima the one with the
    smallest edges, from the last bucket backwards, wins.
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    N, S = [0], [0]
    for length, n in lengths:
        N.append(N[-1] + n)
        S.append(S[-1] + n * length)
    m, k = len(lengths), min(buckets, len(lengths))
    cost = [None] + [lengths[j - 1][0] * N[j] - S[j] for j in range(1, m + 1)]
    back: list[list[int]] = []
    for layer in range(2, k + 1):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        head, now, froms = 0, [None] * (m + 1), [0] * (m + 1)
        for j in range(layer, m + 1):
            i = j - 1
            a, b = -N[i], cost[i] + S[i]
            while len(hull) - head >= 2:
                (a1, b1, _), (a2, b2, _) = hull[-2], hull[-1]
                if (b - b1) * (a1 - a2) <= (b2 - b1) * (a1 - a):
                    hull.pop()
                else:
                    break
            hull.append((a, b, i))
            x = lengths[j - 1][0]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] < hull[head][0] * x + hull[head][1]:
                head += 1
            a, b, i = hull[head]
            now[j] = a * x + b + x * N[j] - S[j]
            froms[j] = i
        cost = now
        back.append(froms)
    edges, j = [], m
    for froms in reversed(back):
        edges.append(lengths[j - 1][0])
        j = froms[j]
    edges.append(lengths[j - 1][0])
    return edges[::-1]


def length_buckets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = 16, token_budget: int = 65_536) -> DataFrame:
    """Assign every document to a batch: doc_id, n_tokens, bucket, pad_to, batch, slot.

    Tokens are words (runs without ASCII white space). A bucket holds the lengths up to ``pad_to``; in it,
    documents in order of doc_id (nulls last, then n_tokens) fill batches of floor(token_budget / pad_to)
    documents, one at least, so that a padded batch keeps to the budget unless one document exceeds it.
    Ranks come from a range exchange of narrow rows plus counts a partition: no task holds a whole bucket.

    A null, empty or blank text has n_tokens 0 and null bucket, pad_to, batch and slot. Repeated rows each get
    a slot. An empty table gives no rows; columns other than doc_id and text are not read. The histogram on
    the driver has a row for each distinct length, so it is bounded by the longest document.
    """
    lengths = df.select(F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("n_tokens"))
    sized = stored(lengths, "lengths")
    some = sized.where("n_tokens > 0")
    counted = [(r[0], r[1]) for r in some.groupBy("n_tokens").count().collect()]
    edges = best_edges(counted, buckets)
    marks = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast(T.ArrayType(T.IntegerType()))
    bucket = F.size(F.filter(marks, lambda e: e < F.col("n_tokens")))
    in_order = [F.col("bucket"), F.col("doc_id").asc_nulls_last(), F.col("n_tokens")]
    ranked = stored(
        some.withColumn("bucket", bucket).repartitionByRange(*in_order).sortWithinPartitions(*in_order).withColumn("__at", F.monotonically_increasing_id())
        .select("doc_id", "n_tokens", "bucket", F.shiftright("__at", 33).cast("int").alias("__part"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")),
        "ranked",
    )
    parts = ranked.groupBy("__part", "bucket").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = W.partitionBy("bucket").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("__part", "bucket", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.col("__row") - F.col("__first") + F.col("__before")
    pad_to = F.element_at(marks, F.col("bucket") + 1)
    room = F.greatest(F.floor(F.lit(token_budget) / pad_to), F.lit(1)).cast("long")
    packed = ranked.join(parts, ["__part", "bucket"]).select(
        "doc_id", "n_tokens", "bucket", pad_to.alias("pad_to"), rank.alias("__rank"), room.alias("__room")
    ) if edges else None
    none = sized.where("n_tokens = 0").select("doc_id", "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("pad_to", "int"), ("batch", "long"), ("slot", "long"))])
    if packed is None:
        return none
    return packed.select("doc_id", "n_tokens", "bucket", "pad_to", F.expr("__rank div __room").alias("batch"), F.expr("__rank % __room").alias("slot")).unionByName(none)

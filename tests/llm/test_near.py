"""Near duplicates against all pairs, and components against union-find."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.llm import components, simhash


def groups_of(n, edges):
    par = list(range(n))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        par[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def near_points(rng, n, radius):
    base = rng.randint(0, 2**63, (n, 2)).astype(np.uint64)
    for i in range(n // 2, n):
        base[i] = base[rng.randint(n // 2)]
        for bit in rng.choice(128, rng.randint(0, radius + 6), replace=False):
            base[i, bit // 64] ^= np.uint64(1) << np.uint64(63 - bit % 64)
    return base


@pytest.mark.parametrize("radius, per_task", [(22, 1 << 20), (22, 60), (9, 100), (3, 1 << 20)])
def test_search_equals_all_pairs(spark, radius, per_task):
    p = near_points(np.random.RandomState(radius), 400, radius)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(p.view(np.int64))], "id long, hi long, lo long").repartition(3)
    got = [tuple(r) for r in simhash.near_edges(df, radius, per_task).collect()]
    d = np.bitwise_count(p[:, None] ^ p[None]).sum(-1)
    want = np.argwhere((d <= radius) & (np.arange(400)[:, None] < np.arange(400)[None]))
    assert groups_of(400, got) == groups_of(400, want)


def test_pairs_of_every_plan():
    p = near_points(np.random.RandomState(0), 300, 22)
    d = np.bitwise_count(p[:, None] ^ p[None]).sum(-1)
    want = {(a, b) for a, b in np.argwhere(d <= 12) if a < b}
    for n in (100, 1 << 21, 1 << 23):
        plan = simhash.segment_plan(n, 12)
        got = set()
        for s in range(len(plan[0])):
            for x, y in simhash.pairs_within(p, plan, s, 12, np.ones(300, bool)):
                got |= {(min(a, b), max(a, b)) for a, b in zip(x, y)}
        assert got == want


def test_each_pair_of_groups_is_searched_for_itself():
    """Own rows meet the others, not once more each other, whatever prefix tells them apart."""
    p = near_points(np.random.RandomState(5), 600, 22)
    d = np.bitwise_count(p[:, None] ^ p[None]).sum(-1)
    plan = simhash.segment_plan(600, 22)
    own = simhash.bit_range(p, *plan[0][0]) >> plan[0][0][1] - 1 == 0
    got, mixed = [], np.arange(600) % 2 == 0
    for s in range(len(plan[0])):
        for x, y in simhash.pairs_within(p, plan, s, 22, mixed):
            assert mixed[x].all() and not mixed[y].any()
            got += zip(x.tolist(), y.tolist())
    assert set(got) == {(a, b) for a, b in np.argwhere(d <= 22).tolist() if a % 2 == 0 and b % 2}
    for prefix in (0, 1):
        found = [(a, b) for x, y in simhash.pairs_within(p, plan, 0, 22, own, prefix=prefix) for a, b in zip(x.tolist(), y.tolist())]
        v, (_, r) = simhash.bit_range(p, *plan[0][0]), (0, plan[1][0])
        want = [(a, b) for a, b in np.argwhere(d <= 22).tolist() if own[a] and not own[b] and int(v[a] ^ v[b]).bit_count() <= r]
        assert sorted(found) == sorted(want)


@pytest.mark.parametrize("n, most", [(235_998, 20_000), (2_800_000, 60_000), (14_000_000, 250_000)])
def test_work_of_a_point_is_bounded(n, most):
    """Lookups and five times the evenly spread matches of a point, at 0.5, 6 and 30 GB of documents."""
    from math import comb

    masks = [(w, sum(comb(w, k) for k in range(r + 1))) for (_, w), r in zip(*simhash.segment_plan(n, 22))]
    assert sum(b + 5 * b * n / 2**w for w, b in masks) < most


def test_fingerprint_is_the_sign_of_summed_hashes():
    from hashlib import md5

    text = " ".join(f"w{i % 700}" for i in range(1500)).encode()
    bits = np.array([np.unpackbits(np.frombuffer(md5(w).digest(), np.uint8)) for w in set(text.split())]).astype(int)
    want = np.packbits(bits.sum(0) * 2 > len(bits)).view(np.uint64)
    assert (simhash.fingerprints([b"", text, b" "])[1] == want).all()


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = groups_of(400, edges)
    assert got == {n: want[n] for e in edges for n in e if e[0] != e[1]}
    u, v = components.forest(np.array([3, 5, 9, 7]), np.array([5, 9, 3, 8]))
    assert dict(zip(u.tolist(), v.tolist())) == {5: 3, 9: 3, 8: 7}


def test_copies_are_found_and_others_kept(spark):
    rng = random.Random(8)
    rows, truth = [], {}
    for g in range(40):
        w = [f"t{rng.randrange(30000)}" for _ in range(150)]
        for c in range(3):
            x = list(w)
            for i in rng.sample(range(150), 4 * c):
                x[i] = f"n{rng.randrange(30000)}"
            truth[len(rows)] = 3 * g
            rows.append((len(rows), " ".join(x)))
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = sum(r.group_id == truth[r.doc_id] for r in out)
    assert hit >= 0.95 * len(rows) and all(truth[r.group_id] == truth[r.doc_id] for r in out)


def test_odd_rows(odd, odd_rows, empty, clashing):
    out = simhash.near_duplicates(odd)
    assert out.count() == len(odd_rows)
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [r.kept for r in sorted(by[0], key=lambda r: not r.kept)] == [True, False, False]
    assert by[20][0].group_id == 0 and not by[20][0].kept and by[21][0].group_id == 1
    assert by[30][0].kept and by[32][0].kept and by[31][0].group_id is None
    assert sorted((r.group_id, r.kept) for r in by[None] if r.group_id is not None) == [(5, False)] and sum(r.kept for r in by[None]) == 1
    assert sorted((r.group_id, r.kept) for r in by[37]) == [(37, True), (37, True)]
    assert simhash.near_duplicates(empty).count() == 0
    assert sorted(map(tuple, simhash.near_duplicates(clashing).collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)


def test_two_texts_of_one_id(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(f"{k}{rng.randrange(9000)}" for _ in range(120)) for k in "abc")
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (3, b + " more", "u"), (4, c, "v"), (4, c, "v"), (4, a, "w"), (None, c, "n"), (None, "alone here", None), (None, "alone here", None), (5, " ", None), (5, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __mark string").withColumn("__nth", F.lit("k")).withColumn("kept", F.lit("k")).repartition(4)
    got = sorted(((r.doc_id, r.text, r["__mark"]) for r in simhash.remove_near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, a, "x"), (2, b, "z"), (4, c, "v"), (None, "alone here", None), (5, " ", None), (5, " ", None)], key=repr)
    assert simhash.remove_near_duplicates(df).columns == df.columns and simhash.remove_near_duplicates(df.limit(0)).count() == 0

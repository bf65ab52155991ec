"""Both substring operators against a brute-force version and against each other."""

import random

import pytest
from pyspark.sql import functions as F

from seqweave.llm import anchors, relative_lz, suffix_sort


def brute(rows, least):
    """Union of windows that an earlier document holds."""
    docs = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None})
    first, out = {}, []
    for n, (none, d, t) in enumerate(docs):
        w, spans = t.encode().split(), []
        for s in range(len(w) - least + 1):
            e, ref = first.setdefault(tuple(w[s : s + least]), (n, None if none else d))
            if e < n:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + least
                else:
                    spans.append([s, s + least, ref])
        out += [(None if none else d, a, b, ref) for a, b, ref in spans]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("operator", [relative_lz, suffix_sort])
def test_random_collages(spark, operator):
    rng = random.Random(11)
    passages = [[f"p{i}_{j}" for j in range(rng.randrange(20, 90))] for i in range(8)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 10)
            w += rng.choice([p, p[a:], p[: a + 10], ["loop"] * rng.randrange(90), [f"u{d}_{i}" for i in range(rng.randrange(40))]])
        if w and rng.random() < 0.3:
            w[rng.randrange(len(w))] = f"edit{d}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for least in (12, 20, 50):
        assert found(operator.duplicate_spans(df, least=least)) == brute(rows, least), least
    for hot in (0, 5, 40):  # picks in more places than that are compared window by window
        assert found(operator.duplicate_spans(df, least=20, hot=hot)) == brute(rows, 20), hot


@pytest.mark.parametrize("operator", [relative_lz, suffix_sort])
def test_odd_rows(odd, odd_rows, empty, clashing, operator):
    want = {(d, a, b) for d, a, b, _ in brute([r for r in odd_rows if r[0] is not None and r[0] != 37], 50)}
    got = operator.duplicate_spans(odd)
    assert got.columns == ["doc_id", "start", "stop", "ref_doc_id"]
    assert {(r.doc_id, r.start, r.stop) for r in got.collect() if r.doc_id is not None} == want
    assert {(r.doc_id, r.start, r.stop, r.ref_doc_id) for r in got.where("doc_id is null").collect()} == {(None, 0, 120, 5)}
    assert found(operator.duplicate_spans(clashing)) == found(got) == found(operator.duplicate_spans(odd, hot=0))
    assert operator.duplicate_spans(empty).count() == 0


def test_removal_keeps_the_rest(spark, odd, odd_rows, empty, clashing):
    out = relative_lz.remove_duplicates(odd)
    assert out.columns == odd.columns
    by = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    text = {r[0]: r[1] for r in odd_rows}
    assert 20 not in by and 23 not in by and by[0].text == text[0]
    assert by[21].text.split() == ["extra"] and by[21].n_chars == len(by[21].text)
    assert by[30].text is None and by[31].text == "" and by[35].text == text[35]
    assert out.where("doc_id = 0").count() == 3
    assert relative_lz.remove_duplicates(empty).count() == 0 and relative_lz.remove_duplicates(clashing).columns == clashing.columns
    named = relative_lz.remove_duplicates(clashing.withColumn("__spans", F.lit("y")))
    assert named.where("__key = 'x' and __spans = 'y' and key = 'x' and spans = 'x'").count() == named.count()
    assert found(named.select(*odd.columns)) == found(out)
    assert relative_lz.cut_spans(b" a  b c\nd ", [{"start": 1, "stop": 3}]) == b" a  d "


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(2)
    rows = [(rng.randrange(3), bytes(rng.randrange(2) for _ in range(4 * rng.randrange(1, 6))), b"", i, i, (0,), 0, 0) for i in range(300)]
    runs = []
    for k in range(7):
        part = sorted(rows[k::7], key=lambda s: (s[0], s[1], s[3]))
        runs.append(suffix_sort.decode_run(suffix_sort.encode_run(part)))
    merged = list(suffix_sort.LoserTree(runs))
    assert [(m[0], m[2]) for _, m in merged] == sorted((r[0], r[1]) for r in rows)
    for (_, a), (shared, b) in zip(merged, merged[1:]):
        want = suffix_sort.common_words(a[2], b[2]) if a[0] == b[0] else 0
        assert shared == want


def test_picks_depend_on_the_window_alone():
    import numpy as np

    rng = np.random.RandomState(1)
    shared = rng.randint(0, 2**32, 60).astype(np.uint32)
    seen = []
    for _ in range(2):
        w = np.concatenate([rng.randint(0, 2**32, 33).astype(np.uint32), shared, rng.randint(0, 2**32, 20).astype(np.uint32)])
        at, first, last, _ = anchors.picks(w, np.array([len(w)]), 50)
        seen.append({(s, a) for a, f, g in zip(at - 33, first - 33, last - 33) for s in range(f, g + 1) if 0 <= s <= 10})
    assert seen[0] == seen[1] and len(seen[0]) == 11
